"""Helpers that the training-data operators share.

Nothing here knows about one operator: table access, the checkpoint folder, shipping this
package to executors, Arrow glue, and vectorised word hashing over raw UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application.

    The zip goes out through Spark's own file server, so no shared disk is needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for folder in (top, os.path.dirname(os.path.abspath(__file__))):
            for f in sorted(os.listdir(folder)):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    folder = tempfile.mkdtemp(prefix="tidemill-")
    path = os.path.join(os.path.realpath(folder), f"{name}_llm.zip")
    with open(path, "wb") as f:
        f.write(blob.getvalue())
    sc.addPyFile(path)
    sc._tidemill_shipped = True


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where all runs on one machine."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_tidemill_local", None):
        sc._tidemill_local = tempfile.mkdtemp(prefix="tidemill-checkpoint-")
    return sc._tidemill_local


def prepare(spark: SparkSession) -> None:
    """Ship the package and name a checkpoint folder (see shared()).

    Texts are long: where the session has Spark's default for the size of Arrow batches, it is
    set to 16 MB, for this session.
    """
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(spark))
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "16m")


def stored(df: DataFrame, name: str) -> str:
    """Writes a table to a new place in the shared folder, and returns the place."""
    at = f"{shared(df.sparkSession)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return at


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with a HOT-th of all rows is hot; there can be no more than HOT of them. Tables of at most SMALL rows of a few dozen bytes may be broadcast.
HOT, SMALL = 2000, 50_000


def is_small(df: DataFrame) -> bool:
    """Whether a table of narrow rows may be broadcast: it is counted."""
    return df.count() <= SMALL


def small_join(left: DataFrame, right: DataFrame, keys: str | list[str]) -> DataFrame:
    """An inner join with a table that is often small: broadcast if it is, else an ordinary join."""
    return left.join(F.broadcast(right) if is_small(right) else right, keys)


def hot_join(left: DataFrame, right: DataFrame, keys: str | list[str], weight: str, total: Callable[[], int], how: str = "inner") -> DataFrame:
    """`left` joined with `right`, without a task that gets all rows of a hot key.

    `right` has one row for each key, with the number of `left` rows that have it in `weight`
    (left out of the result). It is counted: up to SMALL rows are broadcast whole. Beyond that,
    keys with a HOT-th of the total() left rows or more, which are at most HOT, are broadcast,
    and the rest is an ordinary join. how: inner, left or left_anti; a null key matches nothing,
    and rows that have one are not shuffled. Keep both sides cheap to read: they are read twice.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if is_small(right):
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    is_hot = F.col(weight) * HOT >= total()
    hot, cold = right.where(is_hot).drop(weight), right.where(~is_hot).drop(weight)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    out = left.where(whole).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    if how != "left_anti":
        out = out.unionByName(left.join(F.broadcast(hot), keys))
    if how != "inner":
        out = out.unionByName(left.where(~whole), allowMissingColumns=True)
    return out


def fold_of(doc_id: str, mod: int):
    """crc32 of the decimal doc_id, modulo `mod`; the published train/held-out split."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias(col)


def slices(batches: Iterator[pa.RecordBatch], size_of: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `limit` bytes in binary column number `size_of` (one row may exceed it)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(size_of)
        lengths = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i, x in enumerate(lengths):
            if total and total + x > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(x)
        yield batch.slice(start, n - start)


_resident: dict = {}
_owner: list = [None]


def resident(key: tuple, make: Callable):
    """An object that a Python worker keeps between tasks, such as a tokenizer with what it remembers."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def claim(owner: str) -> None:
    """Workers live on from stage to stage: the first task of another operator frees what the one before kept."""
    if _owner[0] != owner:
        _resident.clear()
        _owner[0] = owner
        trim()


def trim() -> None:
    """Give freed memory back to the machine: the executor's limit counts what workers hold."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with the memory of each task given back at its end."""
    owner = f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        try:
            yield from f(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def arrow_groups(f: Callable, owner: str) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow over groups, with the same care."""

    def run(table: pa.Table) -> pa.Table:
        claim(owner)
        out = f(table)
        trim()
        return out

    return run


def arrow_cogroups(f: Callable, owner: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        claim(owner)
        out = f(left, right)
        trim()
        return out

    return run


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# --- 64-bit hashing --------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts, computed over whole blocks of texts at once.

    separators: byte values that end a word; fold: byte value -> byte value applied first.
    A word's hash is a polynomial in its bytes (random byte codes, random odd base), finalised
    with its length, so a word has one hash wherever it stands and in whatever process.
    Memory is a few times PIECE; texts longer than PIECE, single words too, go piece by piece.
    """

    PIECE = 1 << 19

    def __init__(self, separators: bytes, fold: dict[int, int] | None = None, seed: int = 7):
        self.sep = np.zeros(256, dtype=bool)
        self.sep[list(separators)] = True
        codes = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1009 + 1))
        for a, b in (fold or {}).items():
            codes[a] = codes[b]
        self.codes = codes
        base = int(odd_constants(1, seed)[0])
        inverse = pow(base, -1, 1 << 64)
        n = self.PIECE + 64
        self.power, self.inverse = (self._powers(b, n) for b in (base, inverse))
        self.base = base

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:  # doubling: out[done:2*done] = out[:done] * base^done
            step = np.uint64(pow(base, done, 1 << 64))
            end = min(n, 2 * done)
            out[done:end] = out[: end - done] * step
            done = end
        return out

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and unfinished polynomial hashes of the words of one piece."""
        word = ~self.sep[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        if len(word) and word[-1]:
            edge = np.concatenate((edge, [len(word)]))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.power[: len(data)], out=sums[1:])
        return starts, ends - starts, (sums[ends] - sums[starts]) * self.inverse[starts]

    def _finish(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix64(raw + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def one(self, text: bytes) -> np.ndarray:
        """Word hashes of a text of any length, in order."""
        return self.placed(text)[0]

    def placed(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a text of any length, in order, and the byte at which each word begins."""
        if len(text) <= self.PIECE:
            starts, lengths, raw = self._piece(np.frombuffer(text, dtype=np.uint8))
            return self._finish(raw, lengths), starts
        raws, sizes, places, carry = [], [], [], None
        for at in range(0, len(text), self.PIECE):
            data = np.frombuffer(text, dtype=np.uint8, count=min(self.PIECE, len(text) - at), offset=at)
            starts, lengths, raw = self._piece(data)
            lengths, begins = lengths.astype(np.int64), starts.astype(np.int64) + at
            if carry is not None:
                if len(starts) and starts[0] == 0:  # the word goes on from the piece before
                    raw[0] = np.uint64((carry[0] + int(raw[0]) * pow(self.base, carry[1], 1 << 64)) & M64)
                    lengths[0] += carry[1]
                    begins[0] = carry[2]
                    whole = len(starts) == 1 and len(data) == lengths[0] - carry[1]
                else:
                    raws.append(np.array([carry[0]], dtype=np.uint64))
                    sizes.append(np.array([carry[1]]))
                    places.append(np.array([carry[2]]))
                    whole = False
                carry = None
            else:
                whole = False
            if len(starts) and (whole or starts[-1] + lengths[-1] == len(data) or not self.sep[data[-1]]):
                carry = (int(raw[-1]), int(lengths[-1]), int(begins[-1]))
                raw, lengths, begins = raw[:-1], lengths[:-1], begins[:-1]
            raws.append(raw)
            sizes.append(lengths)
            places.append(begins)
        if carry is not None:
            raws.append(np.array([carry[0]], dtype=np.uint64))
            sizes.append(np.array([carry[1]]))
            places.append(np.array([carry[2]]))
        return self._finish(np.concatenate(raws), np.concatenate(sizes)), np.concatenate(places)

    def many(self, texts: list[bytes], placed: bool = False) -> Iterator[tuple]:
        """Blocks (number of the first text, word hashes of the block, first word of each text and the end).

        placed: also the byte of its text at which each word begins.
        """
        glue = bytes([int(np.flatnonzero(self.sep)[0])])
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) + 1 <= self.PIECE):
                total += len(texts[j]) + 1
                j += 1
            if total - 1 > self.PIECE:
                hashes, places = self.placed(texts[i])
                yield (i, hashes, np.array([0, len(hashes)]), places)[: 3 + placed]
            else:
                starts, lengths, raw = self._piece(np.frombuffer(glue.join(texts[i:j]), dtype=np.uint8))
                sizes = np.fromiter((len(t) + 1 for t in texts[i:j]), dtype=np.int64, count=j - i)
                begins = np.concatenate(([0], np.cumsum(sizes)))
                first = np.searchsorted(starts, begins)
                out = i, self._finish(raw, lengths), first
                yield (*out, starts - np.repeat(begins[:-1], np.diff(first))) if placed else out
            i = j


#: The white-space bytes of the word rule [^\x20\x09-\x0D]+.
WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
#: A-Z to a-z, and nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}

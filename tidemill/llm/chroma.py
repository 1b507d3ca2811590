"""Chroma audio fingerprints: packed integers from pitch-class frames, and their alignment.

Audio is cut into overlapping frames; the power of each frame is gathered into twelve pitch
classes, smoothed over time and normalised. Over this image an integral image is kept, so any
rectangle sums in four reads. Sixteen filters compare rectangles inside a sliding window of
frames; each difference is quantised to two bits (Gray-coded, so neighbours differ in one bit),
and the sixteen make one 32-bit integer for each position.

Two recordings are aligned by offset histograms: every integer is posted under each pair of its
four bytes, so two integers of which two bytes agree vote for their offset, and offsets with
VOTES votes or more are decided by their bit errors over the whole overlap. With 15 % of the bits
wrong, by chance and independently, two bytes of an integer survive with probability 0.30, so an
overlap of 16 integers gets two votes with probability 0.98 and longer ones almost always.

Recordings with equal integers are one class, aligned once, and so are equal queries. Classes are
dealt to chunks and query classes to blocks; a task holds one chunk and one block, with the
block's inverted lists. A recording's row appears once for each class it aligns with;
matched_pairs() names every query of a class.

Defined cases: null or empty media, and media shorter than one window, have no integers and
match nothing; so have media that can't be decoded; a recording never matches the query with its
own id; equal recordings match at offset 0 without errors; of the offsets of a pair the one with
the least bit error counts, then the longest overlap, then the least offset. Rows may repeat and
ids too; rows without an id are aligned, but are no queries. A task decodes one recording at a
time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RATE = 11025
FRAME, HOP = 4096, 1365
WIDTH = 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
MAX_ERROR = 0.15
MIN_OVERLAP = 16
VOTES = 2
#: Query classes of a block, recording classes of a chunk, and votes that are counted at a time.
QUERY_BLOCK, CHUNK, AT_ONCE = 4096, 20_000, 2_000_000
#: The pairs of an integer's bytes.
BYTE_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, height, width): kinds in turn, heights and widths from small to large."""
    return [(i % 6, (5 * i) % 12 % (12 - h + 1), h, w) for i in range(16) for h, w in ((3 + 3 * (i % 3), 4 + 4 * (i // 4)),)]


FILTERS = _filters()
STEP = 0.12


def wav_samples(blob: bytes | None) -> np.ndarray:
    """Mono samples of a PCM WAV file of 8, 16, 24 or 32 bits at RATE (channels averaged, other rates interpolated); none if it is no such file."""
    none = np.zeros(0, dtype=np.float32)
    if not blob:
        return none
    try:
        with wave.open(io.BytesIO(blob)) as w:
            size, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return none
    if rate <= 0 or not 1 <= size <= 4:
        return none
    raw = np.frombuffer(data, dtype=np.uint8, count=len(data) // (size * channels) * size * channels).reshape(-1, channels, size)
    wide = np.zeros((*raw.shape[:2], 4), dtype=np.uint8)
    wide[:, :, 4 - size :] = raw ^ np.uint8(128) if size == 1 else raw  # eight bits are unsigned
    samples = (wide.view("<i4")[:, :, 0].astype(np.float32) / 2**31).mean(axis=1)
    if rate != RATE and len(samples):
        samples = np.interp(np.arange(int(len(samples) * RATE / rate)) * (rate / RATE), np.arange(len(samples)), samples).astype(np.float32)
    return samples


def _pitch_classes() -> np.ndarray:
    """FFT bin -> pitch class weights, for bins between 55 Hz and 3520 Hz."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12), dtype=np.float32)
    ok = np.flatnonzero((hz >= 55) & (hz <= 3520))
    out[ok, np.round(12 * np.log2(hz[ok] / 440)).astype(int) % 12] = 1
    return out


_made: dict = {}


def chroma(samples: np.ndarray) -> np.ndarray:
    """Smoothed, normalised pitch-class frames; long audio goes 512 frames at a time."""
    if "classes" not in _made:
        _made["classes"], _made["window"] = _pitch_classes(), np.hanning(FRAME).astype(np.float32)
    n = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    out = np.zeros((max(n, 0), 12), dtype=np.float32)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if n > 0 else None
    for at in range(0, n, 512):
        spectrum = np.fft.rfft(view[at : at + 512] * _made["window"], axis=1)
        out[at : at + 512] = (spectrum.real**2 + spectrum.imag**2) @ _made["classes"]
    if n < len(SMOOTH):
        return np.zeros((0, 12), dtype=np.float32)
    smooth = sum(w * out[i : n - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0)


def codes(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for every window of WIDTH frames."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, low, high, wide in FILTERS:
        top = low + high
        mid_p, mid_t = low + high // 2, wide // 2
        if kind == 0:  # a band against the whole
            a, b = area(0, wide, low, top), area(0, wide, 0, 12) * (high / 12)
        elif kind == 1:  # lower against upper half
            a, b = area(0, wide, low, mid_p), area(0, wide, mid_p, top)
        elif kind == 2:  # before against after
            a, b = area(0, mid_t, low, top), area(mid_t, wide, low, top)
        elif kind == 3:  # diagonals
            a, b = area(0, mid_t, low, mid_p) + area(mid_t, wide, mid_p, top), area(0, mid_t, mid_p, top) + area(mid_t, wide, low, mid_p)
        elif kind == 4:  # middle pitches against outer ones
            third = high // 3
            a, b = area(0, wide, low + third, top - third), (area(0, wide, low, low + third) + area(0, wide, top - third, top)) / 2
        else:  # middle of the time against its ends
            third = wide // 4
            a, b = area(third, wide - third, low, top), area(0, third, low, top) + area(wide - third, wide, low, top)
        value = np.log((1 + a) / (1 + b))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable = wav_samples) -> DataFrame:
    """id and the packed integers (little-endian bytes) of every media row; decode: cell -> samples at RATE."""
    C.prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            blobs = [codes(chroma(decode(x.as_py()))).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(blobs, pa.binary())], names=["id", "codes"])

    return C.arrow_map(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), run, "id long, codes binary")


class Recordings:
    """The integers of some recordings, one after the other, and their postings."""

    def __init__(self, blobs: list[bytes]):
        self.size = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer(b"".join(blobs), dtype="<u4")

    def keys(self, first: int, last: int) -> np.ndarray:
        """A row of keys for every integer of the recordings from `first` to before `last`: each pair of bytes, with its number."""
        codes = self.codes[self.begin[first] : self.begin[last - 1] + self.size[last - 1]] if last > first else self.codes[:0]
        part = [(codes >> np.uint32(8 * i)) & np.uint32(255) for i in range(4)]
        return np.stack([np.uint32(k << 16) | part[i] << np.uint32(8) | part[j] for k, (i, j) in enumerate(BYTE_PAIRS)], axis=1)

    def owners(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The recording and the place of every such integer."""
        size = self.size[first:last]
        return np.repeat(np.arange(first, last), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class Library:
    """Inverted lists over the queries of a block."""

    def __init__(self, blobs: list[bytes]):
        self.of = Recordings(blobs)
        keys = self.of.keys(0, len(blobs)) if blobs else np.zeros((0, len(BYTE_PAIRS)), dtype=np.uint32)
        query, place = self.of.owners(0, len(blobs))
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys = keys.ravel()[order]
        self.query, self.place = (np.repeat(x, len(BYTE_PAIRS))[order] for x in (query, place))

    def align(self, rows: Recordings):
        """(row, query, offset, overlap, bit error) of the best alignment of every pair within MAX_ERROR, in lots of rows."""
        n = len(rows.size)
        each = np.zeros(n, dtype=np.int64)  # votes of each row
        for a in range(0, n, 1000):
            b = min(n, a + 1000)
            keys = rows.keys(a, b).ravel()
            found = np.searchsorted(self.keys, keys, "right") - np.searchsorted(self.keys, keys, "left")
            owner, _ = rows.owners(a, b)
            np.add.at(each, owner, found.reshape(-1, len(BYTE_PAIRS)).sum(axis=1))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(np.cumsum(each[a:]), AT_ONCE, "right")) + a)
            yield self._lot(rows, a, b)
            a = b

    def _lot(self, rows: Recordings, a: int, b: int):
        keys = rows.keys(a, b).ravel()
        owner, place = (np.repeat(x, len(BYTE_PAIRS)) for x in rows.owners(a, b))
        low = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        row, query, offset = np.repeat(owner, count), self.query[at], np.repeat(place, count) - self.place[at]
        # The histogram: votes for each row, query and offset.
        order = np.lexsort((offset, query, row))
        row, query, offset = row[order], query[order], offset[order]
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (query[1:] != query[:-1]) | (offset[1:] != offset[:-1])))) if len(row) else np.zeros(0, dtype=np.int64)
        new = new[np.diff(np.append(new, len(row))) >= VOTES]
        row, query, offset = row[new], query[new], offset[new]
        begin, end = np.maximum(offset, 0), np.minimum(offset + self.of.size[query], rows.size[row])
        ok = end - begin >= MIN_OVERLAP
        row, query, offset, begin, n = row[ok], query[ok], offset[ok], begin[ok], (end - begin)[ok]
        wrong = np.zeros(len(n), dtype=np.int64)
        edges = np.cumsum(n) // AT_ONCE  # bits are compared in lots too
        for lot in np.unique(edges):
            some = np.flatnonzero(edges == lot)
            heads = np.cumsum(n[some]) - n[some]
            step = np.arange(int(n[some].sum())) - np.repeat(heads, n[some])
            mine = rows.codes[np.repeat(rows.begin[row[some]] + begin[some], n[some]) + step]
            theirs = self.of.codes[np.repeat(self.of.begin[query[some]] + begin[some] - offset[some], n[some]) + step]
            wrong[some] = np.add.reduceat(np.bitwise_count(mine ^ theirs).astype(np.int64), heads)
        error = wrong / (32 * n)
        ok = error <= MAX_ERROR
        row, query, offset, n, error = row[ok], query[ok], offset[ok], n[ok], error[ok]
        order = np.lexsort((offset, -n, error, query, row))
        row, query, offset, n, error = row[order], query[order], offset[order], n[order], error[order]
        best = np.concatenate(([True], (row[1:] != row[:-1]) | (query[1:] != query[:-1]))) if len(row) else np.zeros(0, dtype=bool)
        return row[best], query[best], offset[best], n[best], error[best]


_ALIGNED = "cid long, qid long, match_offset int, match_overlap int, bit_error double"


def _meet(classes: pa.Table, queries: pa.Table) -> pa.Table:
    """A chunk of recording classes against a block of query classes."""
    library, rows = Library(queries["codes"].to_pylist()), Recordings(classes["codes"].to_pylist())
    cid, qid = classes["cid"].to_numpy(), queries["qid"].to_numpy()
    found = list(library.align(rows)) if queries.num_rows and classes.num_rows else []
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(5)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    columns[:2] = [cid[columns[0].astype(np.int64)], qid[columns[1].astype(np.int64)]]
    return pa.table([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _ALIGNED.split(", ")])


def align(prints: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """A row for every fingerprint row and every class of equal queries that it aligns with; one without a match if there is none.

    Columns: id, n_codes, codes_sha256; match_id, the least id of the query class other than the
    row's own; match_offset, match_overlap, bit_error, and the class's query_sha256.
    queries: rows of the same form as `prints`.
    """
    spark = prints.sparkSession
    C.prepare(spark)
    name = F.when(F.octet_length("codes") > 0, F.unhex(F.sha2("codes", 256))).alias("name")  # of equal integers; null without any
    rows = prints.select("id", "codes", name, F.xxhash64("id", F.spark_partition_id()).alias("spread")).checkpoint()
    total = rows.count()
    classes = rows.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.first("codes").alias("codes")).withColumn("cid", F.monotonically_increasing_id()).checkpoint()
    asked = queries.select("id", "codes", name).where("id is not null and name is not null").checkpoint()
    least = asked.groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("codes").alias("codes")).checkpoint()
    # The two least ids name a class to every row: to the row with the least id by the other one.
    second = C.hot_join(asked.select("id", "name"), least.select("name", "least", "n"), "name", "n", asked.count).where("id > least").groupBy("name").agg(F.min("id").alias("second"))
    named = least.join(second, "name", "left").select("codes", "least", "second", F.lower(F.hex("name")).alias("query_sha256")).withColumn("qid", F.monotonically_increasing_id()).checkpoint()
    blocks, chunks = -(-named.count() // block), max(C.parts(spark), -(-classes.count() // CHUNK))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not blocks:
        found = spark.createDataFrame([], _ALIGNED)
    else:
        left = classes.select("cid", "codes", spread("cid", chunks).alias("chunk"), every(blocks).alias("block"))
        right = named.select("qid", "codes", spread("qid", blocks).alias("block"), every(chunks).alias("chunk"))
        found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(C.arrow_cogroups(_meet, __name__), _ALIGNED)
    # Rows of a class with many copies meet its matches in several tasks.
    salts = F.least(F.col("n"), F.ceil(F.col("n") * C.HOT / F.lit(max(total, 1)))).cast("int")
    sized = classes.select("name", "cid", "n", salts.alias("salts"))
    mine = C.hot_join(rows, sized, "name", "n", lambda: total, "left").withColumn("salt", F.pmod("spread", "salts").cast("int"))
    matches = found.join(named.drop("codes"), "qid").join(sized.select("cid", "salts"), "cid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "qid").checkpoint()
    out = mine.where("cid is not null").join(matches, ["cid", "salt"]).withColumn("match_id", F.when(F.col("least").eqNullSafe(F.col("id")), F.col("second")).otherwise(F.col("least"))).where("match_id is not null")
    known = ["id", (F.octet_length("codes") / 4).cast("long").alias("n_codes"), F.sha2("codes", 256).alias("codes_sha256")]
    matched = out.select(*known, "match_id", "match_offset", "match_overlap", "bit_error", "query_sha256")
    # A row is without a match if its class has none, or only the query that is the row itself.
    classwise = matches.where("salt = 0").groupBy("cid").agg(F.count("*").alias("m"), F.max(F.when(F.col("second").isNull(), F.col("least"))).alias("only"))
    counted = C.hot_join(mine.where("cid is not null").select("id", "codes", "cid"), classwise.join(classes.select("cid", "n"), "cid").checkpoint(), "cid", "n", lambda: total, "left")
    alone = counted.where("m is null or (m = 1 and only <=> id)").select("id", "codes").union(mine.where("cid is null").select("id", "codes"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("match_id", "long"), ("match_offset", "int"), ("match_overlap", "int"), ("bit_error", "double"), ("query_sha256", "string"))]
    return matched.union(alone.select(*known, *nothing))


def best(aligned: DataFrame) -> DataFrame:
    """One row of align() for every id and codes_sha256: the best match, or the row without one."""
    order = F.struct("bit_error", (-F.col("match_overlap")).alias("o"), "match_id", "match_offset")
    return aligned.groupBy("id", "n_codes", "codes_sha256").agg(F.min(F.when(F.col("match_id").isNotNull(), order)).alias("b")).select(
        "id", "n_codes", "codes_sha256", "b.match_id", "b.match_offset", (-F.col("b.o")).alias("match_overlap"), "b.bit_error",
    )


def matched_pairs(aligned: DataFrame, queries: DataFrame) -> DataFrame:
    """id, query_id, match_offset, match_overlap and bit_error of every recording and query that align: the classes of align() in full."""
    named = queries.where("id is not null").select(F.col("id").alias("query_id"), F.sha2("codes", 256).alias("query_sha256")).distinct()
    each = aligned.where("match_id is not null").select("id", "match_offset", "match_overlap", "bit_error", "query_sha256")
    return each.join(named, "query_sha256").where("not id <=> query_id").select("id", "query_id", "match_offset", "match_overlap", "bit_error")


def tune(vector: list[float] | None) -> np.ndarray:
    """A recording of a vector: one eighth-second note for each number, two octaves from A3 by size.

    The tables hold no audio, so the query over them plays their vectors. Nulls and NaNs are rests.
    """
    if not vector:
        return np.zeros(0, dtype=np.float32)
    if "notes" not in _made:
        t = np.arange(RATE // 8) / RATE
        hz = 220 * 2 ** (np.arange(24) / 12)
        fade = np.minimum(1, np.minimum(t, t[::-1]) / 0.005)
        sound = (np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(4 * np.pi * hz[:, None] * t)) * fade
        _made["notes"] = np.vstack([sound, np.zeros(len(t))]).astype(np.float32)
    v = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    rest = ~np.isfinite(v)
    spread = np.sqrt(len(v)) * np.where(rest, 0, v)
    note = np.clip(np.floor(24 / (1 + np.exp(-1.702 * spread))), 0, 23).astype(int)
    return _made["notes"][np.where(rest, 24, note)].ravel()



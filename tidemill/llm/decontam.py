"""Benchmark decontamination with a distributed positional inverted index.

index() stores the postings of all training tokens as a table: a row holds a term and its
ascending positions, delta-coded, in one block of documents (a few MB of text), so the
postings of a frequent term lie in as many rows as there are blocks. One row of a block has no
term and lists where its documents begin; one position stays free between documents.

search() joins the index with the terms of the test items. A window (13 consecutive item
words, or all words of a shorter item) can only occur in blocks that have its rarest term,
rarest by counts over the whole index; such pairs of item and block are the candidates. Where
a block meets its candidates, the list of the rarest term of each window is shifted by the
term's place and intersected with the shifted lists of the other terms, from rare to common.
Proximity matches look for the other terms near each position of the rarest one.

Both the index and the benchmark are tables of any size: a task holds the needed postings of
one block and at most about SLICE_BYTES of item text; a larger benchmark is dealt to several
such slices. Terms are 64-bit hashes of words: a million different item words meet one wrong
word among ten billion with probability 0.0005, and a window needs all its words.

Defined cases: null or wordless texts have no words and no hits; items without words have no
windows; items with a null id are ignored; an item_id that repeats counts once; document rows
may repeat; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .minhash import text_key

WINDOW = 13
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
#: Rows of a frequent term meet the items that need it in this many tasks.
SALTS = 16
#: Bytes that end a word under [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def hasher() -> C.WordHasher:
    if "h" not in _made:
        _made["h"] = C.WordHasher(ENDS, C.LOWER)
    return _made["h"]


_made: dict = {}


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of some texts in a row, and how many words each text has."""
    words, counts = [np.zeros(0, dtype=np.uint64)], []
    for _, found, first in hasher().many(texts):
        words.append(found)
        counts += np.diff(first).tolist()
    return np.concatenate(words), np.array(counts, dtype=np.int64)


def pack(lists: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending lists, one after the other and each from its place in `heads`, as delta-coded bytes of seven bits; and where each list's bytes begin, and the end."""
    delta = np.diff(lists, prepend=0)
    delta[heads] = lists[heads]
    delta = delta.astype(np.uint32)
    size = 1 + sum((delta >= np.uint32(1 << b)).astype(np.int64) for b in (7, 14, 21, 28))
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(begin[-1], dtype=np.uint8)
    for k in range(5):
        which = np.flatnonzero(size > k)
        if len(which):
            out[begin[which] + k] = (delta[which] >> np.uint32(7 * k)) & np.uint32(127) | (size[which] > k + 1) * np.uint32(128)
    return out, np.append(begin[heads], begin[-1])


def unpack(data: bytes, counts: np.ndarray) -> np.ndarray:
    """The lists of pack(), one after the other, given how many entries each has."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    delta = np.zeros(len(last), dtype=np.int64)
    for k in range(5):
        which = np.flatnonzero(last - first >= k)
        delta[which] |= (raw[first[which] + k].astype(np.int64) & 127) << (7 * k)
    sums = np.cumsum(delta)
    heads = np.cumsum(counts) - counts
    return sums - np.repeat(sums[heads] - delta[heads], counts)


_INDEX = "block long, row int, doc_id long, key binary, term long, n long, at binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The positional index of all texts, written to `path` as Parquet, or else to the checkpoint folder.

    Rows of terms: block, term, n (positions in the block) and at (the positions); the row
    without a term: at has where documents begin. Rows of documents: block, row (its number in
    the block), doc_id, key (256 bits that name the text) and n (words).
    """
    spark = docs.sparkSession
    C.prepare(spark)

    def run(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        for batch in C.slices(batches, 1, BLOCK_BYTES):
            block += 1
            n = batch.num_rows
            words, counts = words_of([t or b"" for t in batch.column(1).to_pylist()])
            begins = np.cumsum(counts) - counts + np.arange(n)
            order = np.argsort(words, kind="stable")
            position = (np.arange(len(words)) + np.repeat(np.arange(n), counts))[order]
            sorted_ = words[order]
            heads = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(words) else np.zeros(0, dtype=np.int64)
            data, bounds = pack(np.concatenate((begins, position)), np.concatenate(([0], n + heads)))
            k = len(heads)
            lists = pa.Array.from_buffers(pa.binary(), k + 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            none = lambda size, kind: pa.nulls(size, kind)
            terms = pa.concat_arrays([none(1, pa.int64()), pa.array(sorted_[heads].view(np.int64))])
            sizes = np.concatenate(([n], np.diff(np.append(heads, len(words)))))
            yield _batch(block, k + 1, none(k + 1, pa.int32()), none(k + 1, pa.int64()), none(k + 1, pa.binary()), terms, pa.array(sizes, pa.int64()), lists)
            yield _batch(block, n, pa.array(np.arange(n), pa.int32()), batch.column(0), batch.column(2), none(n, pa.int64()), pa.array(counts, pa.int64()), none(n, pa.binary()))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"), text_key(text_col).alias("key"))
    made = C.arrow_map(picked, run, _INDEX)
    if path is None:
        return made.checkpoint()
    made.write.parquet(path)
    return spark.read.parquet(path)


def _batch(block: int, size: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, block, dtype=np.int64)), *columns], names=["block", "row", "doc_id", "key", "term", "n", "at"])


def _windows(words: np.ndarray, window: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(words, min(window, len(words)))


class Postings:
    """The needed lists of one block, as one ascending array of term number and position."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, data: bytes, begins: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.terms, self.count = terms[order], counts[order]
        self.begin = np.cumsum(self.count) - self.count
        lists = unpack(data, counts) if len(counts) else np.zeros(0, dtype=np.int64)
        at = np.cumsum(counts) - counts
        take = np.repeat(at[order] - self.begin, self.count) + np.arange(len(lists))
        self.positions = lists[take]
        self.flat = np.repeat(np.arange(len(terms)) << 32, self.count) + self.positions
        self.begins = begins

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for those that the block lacks."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = (term << 32) + position
        at = np.minimum(np.searchsorted(self.flat, wanted), len(self.flat) - 1)
        return (position >= 0) & (self.flat[at] == wanted)

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of rows of term numbers."""
        live = np.flatnonzero(windows.min(axis=1) >= 0) if len(windows) else np.zeros(0, dtype=np.int64)
        if not len(live):
            return live, live
        count = self.count[windows[live]]
        order = np.argsort(count, axis=1, kind="stable")  # rare terms first
        place = order[:, 0]
        term = windows[live, place]
        length = self.count[term]
        which = np.repeat(np.arange(len(live)), length)
        offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        start = self.positions[self.begin[term][which] + offset] - place[which]
        for j in range(1, windows.shape[1]):
            if not len(which):
                break
            at = order[which, j]
            ok = self.has(windows[live[which], at], start + at)
            which, start = which[ok], start[ok]
        return live[which], start

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) where all terms of a window, in any order, lie within its length plus `slop` in one document.

        `start` is where the rarest term stands, less its place in the window.
        """
        found = []
        n = windows.shape[1]
        for w in np.flatnonzero(windows.min(axis=1) >= 0).tolist():
            count = self.count[windows[w]]
            order = np.argsort(count, kind="stable")
            at = self.positions[self.begin[windows[w, order[0]]] :][: count[order[0]]]
            doc = self.row(at)
            low = np.maximum(at - order[0] - slop, self.begins[doc])
            high = np.minimum(at - order[0] + n + slop, np.append(self.begins, np.iinfo(np.int64).max)[doc + 1])
            ok = np.ones(len(at), dtype=bool)
            for j in order[1:]:
                own = self.positions[self.begin[windows[w, j]] :][: count[j]]
                ok &= np.searchsorted(own, high) > np.searchsorted(own, low)
            found += [(w, int(x)) for x in (at - order[0])[ok]]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)

    def row(self, position: np.ndarray) -> np.ndarray:
        """The number of the document that holds each position."""
        return np.searchsorted(self.begins, position, side="right") - 1


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """iid, item and words (hashes) of every item that has words."""

    def run(batches):
        for batch in C.slices(batches, 2):
            words, counts = words_of(batch.column(2).to_pylist())
            ends = np.cumsum(counts)
            blobs = [words[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["iid", "item", "words"])

    some = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    picked = some.select(F.monotonically_increasing_id().alias("iid"), F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("body"))
    return C.arrow_map(picked, run, "iid long, item string, words binary").where("octet_length(words) > 0").checkpoint()


def _terms(items: DataFrame) -> DataFrame:
    """iid and term: the different words of every item."""

    def run(batches):
        for batch in batches:
            terms = [np.unique(np.frombuffer(b, dtype=np.int64)) for b in batch.column(1).to_pylist()]
            if terms:
                iid = np.repeat(batch.column(0).to_numpy(), [len(t) for t in terms])
                yield pa.RecordBatch.from_arrays([pa.array(iid, pa.int64()), pa.array(np.concatenate(terms), pa.int64())], names=["iid", "term"])

    return C.arrow_map(items.select("iid", "words"), run, "iid long, term long").checkpoint()


def _rarest(items: DataFrame, window: int) -> DataFrame:
    """iid and term: the rarest terms of the windows whose terms all occur, of items (iid, words, known: terms with counts)."""

    def run(batches):
        for batch in batches:
            iids, terms = [], []
            for iid, blob, known in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(blob, dtype=np.int64)
                pairs = np.array(sorted((k["term"], k["df"]) for k in known), dtype=np.int64)
                at = np.minimum(np.searchsorted(pairs[:, 0], words), len(pairs) - 1)
                df = np.where(pairs[at, 0] == words, pairs[at, 1], 0)
                views, own = _windows(df, window), _windows(words, window)
                live = np.flatnonzero(views.min(axis=1) > 0)
                rare = np.unique(own[live, views[live].argmin(axis=1)])
                iids += [iid] * len(rare)
                terms.append(rare)
            if iids:
                yield pa.RecordBatch.from_arrays([pa.array(iids, pa.int64()), pa.array(np.concatenate(terms), pa.int64())], names=["iid", "term"])

    return C.arrow_map(items.select("iid", "words", "known"), run, "iid long, term long").checkpoint()


_HITS = "block long, row int, item string, kind string, start long, length long"
_SPANS = "block long, row int, spans array<struct<a: long, b: long>>, items array<string>"


def _meet(postings: pa.Table, items: pa.Table, window: int, slop: int | None) -> pa.Table:
    """What the items of one slice hit in one block: a row for each match if slop is given, else for each document."""
    names = ["block", "row", "item", "kind", "start", "length"] if slop is not None else ["block", "row", "spans", "items"]
    terms = postings["term"].to_pylist()
    if None not in terms or not items.num_rows:
        return pa.table([pa.array([], t) for t in _arrow(slop)], names=names)
    counts, lists = postings["n"].to_pylist(), postings["at"].to_pylist()
    docs = terms.index(None)
    block, begins = postings["block"][0].as_py(), unpack(lists[docs], np.array([counts[docs]]))
    for x in (terms, counts, lists):
        del x[docs]
    own = Postings(np.array(terms, dtype=np.int64), np.array(counts, dtype=np.int64), b"".join(lists), begins)
    matches: list[tuple] = []
    by_length: dict[int, list] = {}
    for item, blob in zip(items["item"].to_pylist(), items["words"].to_pylist()):
        views = _windows(own.numbers(np.frombuffer(blob, dtype=np.int64)), window)
        by_length.setdefault(views.shape[1], []).append((item, views))
    for n, some in by_length.items():
        windows = np.concatenate([v for _, v in some])
        owner = np.repeat(np.arange(len(some)), [len(v) for _, v in some])
        for kind in ("exact", "proximity")[: 2 if slop else 1]:
            which, start = own.exact(windows) if kind == "exact" else own.near(windows, slop)
            if kind == "proximity":
                fresh = [k for k, pair in enumerate(zip(which.tolist(), start.tolist())) if pair not in known]
                which, start = which[fresh], start[fresh]
            known = set(zip(which.tolist(), start.tolist())) if slop else set()
            matches += [(some[o][0], kind, int(s), n) for o, s in zip(owner[which].tolist(), start.tolist())]
    start = np.array([m[2] for m in matches], dtype=np.int64)
    row = own.row(np.maximum(start, 0))
    if slop is not None:
        got = [(block, r, i, k, s - int(begins[r]), n) for r, (i, k, s, n) in zip(row.tolist(), matches)]
        return pa.table([pa.array([g[c] for g in got], t) for c, t in enumerate(_arrow(slop))], names=names)
    found: dict[int, tuple[set, set]] = {}
    for r, (item, _, s, n) in zip(row.tolist(), matches):
        spans, owners = found.setdefault(r, (set(), set()))
        spans.add((s, s + n))
        owners.add(item)
    spans = [[{"a": a, "b": b} for a, b in _merged(sorted(x))] for x, _ in found.values()]
    columns = [[block] * len(found), list(found), spans, [sorted(x) for _, x in found.values()]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _arrow(slop))], names=names)


def _arrow(slop: int | None) -> list[pa.DataType]:
    if slop is not None:
        return [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return [pa.int64(), pa.int32(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(table: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """What the items hit in the documents of an index: block, row, spans (words hit) and items of every document hit.

    With slop given, a row for every match instead: block, row, item, kind (exact, or proximity
    within `slop` extra words), start and length.
    """
    C.prepare(table.sparkSession)
    own = _items(items, item_id, item_text)
    terms = _terms(own)
    size = own.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    wanted = terms.groupBy("term").agg(F.count("*").alias("items"))
    lists = table.where("term is not null").select("block", "term", "n", "at")
    known = C.small_join(lists, wanted, "term").groupBy("term").agg(F.sum("n").alias("df"), F.first("items").alias("items")).checkpoint()
    counts = C.hot_join(terms, known, "term", "items", terms.count).groupBy("iid").agg(F.collect_list(F.struct("term", "df")).alias("known"))
    rare = _rarest(own.join(counts, "iid"), window)
    # Candidates: items and the blocks that have the rarest term of one of their windows.
    holders = lists.select("block", "term")
    if C.is_small(rare):
        found = holders.join(F.broadcast(rare), "term")
    else:
        salted = rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = holders.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    pairs = found.select("block", "iid").distinct().checkpoint()
    slice_ = F.pmod(F.xxhash64("iid"), F.lit(slices)).cast("int").alias("slice")
    if size <= SLICE_BYTES:
        named = pairs.join(F.broadcast(own), "iid")
    else:  # an item that is a candidate everywhere meets its blocks in several tasks
        named = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["iid", "salt"])
    asked = named.select(F.col("block").alias("block"), slice_, "item", "words")
    # The lists that these blocks need, once for each slice.
    needs = terms.select("term", slice_).distinct()
    begins = table.where("term is null and row is null").select("block", "term", "n", "at")
    every = C.small_join(lists, needs, "term").select("block", "slice", "term", "n", "at").union(begins.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "term", "n", "at"))
    sent = every.join(pairs.select("block", slice_).distinct(), ["block", "slice"], "left_semi")
    meet = lambda p, i: _meet(p, i, window, slop)
    return sent.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInArrow(C.arrow_cogroups(meet, __name__), _SPANS if slop is None else _HITS)


def _documents(table: DataFrame) -> DataFrame:
    return table.where("row is not null").select("block", "row", "doc_id", "key", F.col("n").alias("n_words"))


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """doc_id, n_words, n_hit, the sorted ids of the items that occur, and the text's key, for every document row."""
    table = index(docs, id_col, text_col)
    hits = search(table, items, item_id, item_text, window)
    # The slices of a large benchmark may hit the same words.
    joined = hits.groupBy("block", "row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"],
    )
    found = joined.select("block", "row", covered.alias("n_hit"), "items")
    out = _documents(table).join(found, ["block", "row"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "key")


def contaminated():
    """The contamination rule over the columns of scan()."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns. The text alone decides, so texts are told apart by their keys."""
    found = scan(docs, items, text_col=text_col, **names)
    gone = found.where(contaminated()).groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).checkpoint()
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = named.withColumn("_key", text_key(f"c{docs.columns.index(text_col)}"))
    return C.hot_join(own, gone, "_key", "_n", docs.count, "left_anti").drop("_key").toDF(*docs.columns)


def matches(docs: DataFrame, items: DataFrame, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every match as a row: doc_id, item_id, kind (exact, or proximity within `slop` extra words), start, length."""
    table = index(docs, id_col, text_col)
    hits = search(table, items, item_id, item_text, window, slop)
    return hits.join(_documents(table), ["block", "row"]).select("doc_id", F.col("item").alias("item_id"), "kind", "start", "length").distinct()

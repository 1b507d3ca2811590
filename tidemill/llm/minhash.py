"""MinHash near-duplicate detection with circulant permutations.

Words are the runs of non-white-space bytes after A-Z are lower-cased; a document's set holds
its distinct 5-word shingles (the whole sequence if it has fewer words). One permutation
(sigma) scatters shingles over a circle of 2^22 places; a second one (pi), read from a table
and shifted by k, gives signature coordinate k = min over shingles of pi[sigma(s) + k]. The
shifted readings of one shingle are neighbours in the table, so a signature is the minimum of
a few contiguous rows.

Bands of the signature only propose. The sets that share a band value are a bucket; each is
compared, as a full set, with the first one of its bucket, and what is linked so far is joined
into components. Only buckets whose other members still lie in several components need more:
their members are compared across components, cut by set size (linked sets differ in size by
the threshold at most) and, when large, into tiles of bounded memory that different tasks
compare. Links are reported as spanning forests, never as all pairs, and long chains of near
copies cost no more than their buckets.

Defined cases: null or wordless text has an empty set, is linked with nothing and is kept;
equal sets are one node from the start, however many rows carry them; rows may repeat; a null
doc_id counts as a row but is never a component's name unless nothing else is there. Dropping
keeps one row of each component, whatever the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE = 5
CIRCLE_BITS = 22
BANDS, ROWS = 32, 6
TILE_DOCS, TILE_SHINGLES = 1024, 500_000
#: Members of a bucket that one task compares with its first one.
STAR = 64
_SIZE_CLASSES = 1.0


class Sketcher:
    """Shingle sets and circulant signatures; one per Python process."""

    def __init__(self, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.k, self.bands, self.rows = shingle, bands, rows
        self.hasher = C.WordHasher(C.WHITE, C.LOWER)
        self.factors = C.odd_constants(shingle, seed)
        n = bands * rows
        pi = np.random.default_rng(seed).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        self.table = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: n - 1])), n)
        self.band_factors = C.odd_constants(rows, seed + 1)
        self.band_salt = C.odd_constants(bands, seed + 2)

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        k = self.k
        for _, words, first in self.hasher.many(texts):
            n = max(0, len(words) - k + 1)
            runs = np.zeros(n, dtype=np.uint64)
            for j in range(k):
                runs += words[j : j + n] * self.factors[j]
            runs = C.mix64(runs)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= k:
                    yield np.unique(runs[a : b - k + 1])
                elif b > a:
                    whole = (words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                    yield C.mix64(np.array([whole]))
                else:
                    yield np.zeros(0, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All coordinates from two permutations: sigma picks the place, pi is read on from there."""
        place = (C.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
        best = None
        for at in range(0, len(place), 256):
            low = self.table[place[at : at + 256]].min(axis=0)
            best = low if best is None else np.minimum(best, low)
        return best

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        return C.mix64((s * self.band_factors).sum(axis=2, dtype=np.uint64) * self.band_salt + self.band_salt)


def _sketcher(*args) -> Sketcher:
    return C.resident(("sketcher", *args), lambda: Sketcher(*args))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_key(text_col: str):
    """256 bits that name a text; null for null."""
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, set key (null for empty sets) and band keys of every document; by_row: its text key too."""

    def run(batches):
        s = _sketcher(shingle, bands, rows)
        recent: dict[bytes, np.ndarray] = {}
        for batch in C.slices(batches, 1):
            texts = batch.column(1).to_pylist()
            sizes, keys, sigs = [], [], []
            for one in s.sets(texts):
                sizes.append(len(one))
                if not len(one):
                    keys.append(None)
                    continue
                key = set_key(one)
                keys.append(key)
                if (sig := recent.get(key)) is None:
                    if len(recent) > 2000:
                        recent.clear()
                    sig = recent[key] = s.signature(one)
                sigs.append(sig)
            flat = s.band_keys(np.array(sigs)).view(np.int64).ravel() if sigs else np.zeros(0, dtype=np.int64)
            counts = np.array([0 if k is None else s.bands for k in keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), C.list_array(flat, counts, pa.int64()), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "set_key", "bands", *batch.schema.names[2:]],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_bytes(text_col), *([text_key(text_col).alias("text_key")] if by_row else []))
    return C.arrow_map(picked, run, "doc_id long, n_shingles long, set_key binary, bands array<long>" + ", text_key binary" * by_row)


def forest(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between `sets` of different groups: pairs with 100*|A and B| >= percent*|A or B|.

    side: 0 or 1 for the two halves of a tile; if both occur only pairs across are compared.
    Counts intersections through one inverted list per shingle, so pairs without a common
    shingle cost nothing.
    """
    n = len(sets)
    across = bool(side.any() and not side.all())
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    values, owners = flat[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    length = np.diff(np.concatenate((head, [len(values)])))
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.repeat(np.arange(len(head)), length)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    _, parent = np.unique(group, return_inverse=True)
    parent = np.unique(parent, return_index=True)[1][parent].tolist()  # the first of each group

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in range(n):
        mine = rank[begin[x] : begin[x + 1]]
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        lens = length[mine]
        at = np.repeat(head[mine] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
        common = np.bincount(owners[at], minlength=n)[:x]  # earlier members only
        union = sizes[x] + sizes[:x] - common
        hit = (common > 0) & (100 * common >= percent * union) & (group[:x] != group[x])
        if across:
            hit &= side[:x] != side[x]
        for y in np.flatnonzero(hit).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((x, y))
    return edges


_EDGES = "u long, v long"


def _edges(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def linked_to_first(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (nid, first) of the rows (tile, first, side, nid, shingles) that are linked to their `first`, the row of side 0.

    Rows are dealt by tile and sorted, so a task holds one set at a time.
    """

    def run(batches):
        first, name = None, None
        for batch in batches:
            u, v = [], []
            for _, of, side, nid, blob in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(blob, dtype=np.uint64)
                if side == 0:
                    first, name = own, nid
                elif of == name:
                    common = int((first[np.minimum(np.searchsorted(first, own), len(first) - 1)] == own).sum())
                    if common and 100 * common >= percent * (len(own) + len(first) - common):
                        u.append(nid)
                        v.append(name)
            if u:
                yield _edges(u, v)

    dealt = rows.select("tile", "first", "side", "nid", "shingles").repartition(C.parts(rows.sparkSession), "tile").sortWithinPartitions("tile", "first", "side")
    return C.arrow_map(dealt, run, _EDGES)


def linked_across(rows: DataFrame, percent: int) -> DataFrame:
    """Edges between groups that span, within each tile, the links of rows (tile, side, nid, grp, shingles).

    Rows are dealt and sorted by tile, so a task holds one tile at a time.
    """

    def run(batches):
        held: list[tuple] = []
        at = None

        def flush():
            if len(held) < 2:
                return None
            sets = [np.frombuffer(x[3], dtype=np.uint64) for x in held]
            side, nid, group = (np.array([x[i] for x in held]) for i in range(3))
            found = forest(np.array([len(s) for s in sets]), sets, side, group, percent)
            return _edges(*np.array([(nid[x], nid[y]) for x, y in found]).T) if found else None

        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != at:
                    if (out := flush()) is not None:
                        yield out
                    held.clear()
                    at = tile
                held.append(row)
        if (out := flush()) is not None:
            yield out

    dealt = rows.select("tile", "side", "nid", "grp", "shingles").repartition(C.parts(rows.sparkSession), "tile").sortWithinPartitions("tile")
    return C.arrow_map(dealt, run, _EDGES)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    sketch, labels = _components(docs, id_col, text_col, percent, shingle, bands, rows)
    out = C.hot_join(sketch.select("doc_id", "n_shingles", "set_key"), labels, "set_key", "copies", sketch.count, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def candidates(nodes: DataFrame, bands: int) -> DataFrame:
    """h, nid, first, size: the members of every band bucket of several sets, with its first member and its size."""
    bucket = nodes.select(F.explode("bands").alias("h"), "nid")
    several = bucket.groupBy("h").agg(F.min("nid").alias("first"), F.count("*").alias("size"), F.count("*").alias("_size")).where("size > 1").checkpoint()
    return C.hot_join(bucket, several, "h", "_size", lambda: bands * nodes.count()).checkpoint()


def star_tiles(member: DataFrame) -> DataFrame:
    """tile, first, side, nid: every member of a bucket with the bucket's first one (side 0), at most about STAR members a tile."""
    pair = member.where("nid <> first").groupBy("first", "nid").agg(F.max("size").alias("size"))
    tiles = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("size") / STAR)))).cast("long")
    pair = pair.withColumn("tiles", tiles).withColumn("tile", F.xxhash64("first", "tiles", F.pmod(F.xxhash64("nid"), F.col("tiles"))))
    return pair.select("tile", "first", F.lit(1).alias("side"), "nid").union(pair.select("tile", "first", F.lit(0), F.col("first").alias("nid")).distinct())


def cross_tiles(member: DataFrame, nodes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """tile, side, nid, grp: members of buckets that still lie in several components, to be compared across them.

    A bucket's first member was compared with all others; so only the others count. Buckets of
    several bands with the same members are one.
    """
    others = member.where("size > 2 and nid <> first").join(joined.withColumnRenamed("node", "nid"), "nid", "left").select("h", "nid", F.coalesce("root", "nid").alias("grp")).checkpoint()
    same = [F.count("*").alias("n"), F.sum(F.xxhash64("nid").cast("decimal(38,0)")).alias("x"), F.expr("bit_xor(xxhash64(nid, 1))").alias("y")]
    open_ = others.groupBy("h").agg(F.min("grp").alias("a"), F.max("grp").alias("z"), *same).where("a <> z").groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h", F.col("n").alias("_n")).checkpoint()
    inside = C.hot_join(others, open_, "h", "_n", others.count)
    # Linked sets lie within one size class or in neighbouring ones.
    step = float(np.log(100.0 / percent)) if percent < 100 else _SIZE_CLASSES
    at = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    placed = inside.join(nodes.select("nid", "n"), "nid").withColumn("c", at).select(
        "h", "nid", "grp", "n", F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("c").alias("c")), F.struct(F.lit(0).alias("own"), (F.col("c") + 1).alias("c")))).alias("p"),
    ).select("h", "nid", "grp", "n", "p.own", "p.c").checkpoint()
    cut = (
        placed.groupBy("h", "c")
        .agg(F.sum("own").alias("own_n"), F.count("*").alias("_n"), F.sum("n").alias("sh"), F.min("grp").alias("a"), F.max("grp").alias("z"))
        .where("own_n > 0 and a <> z")
        .select("h", "c", "_n", F.greatest(F.ceil(F.col("_n") / TILE_DOCS), F.ceil(F.col("sh") / TILE_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
        .checkpoint()
    )
    rows = C.hot_join(placed, cut, ["h", "c"], "_n", placed.count).withColumn("b", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    tiles = rows.select("nid", "grp", "h", "c", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return tiles.select(F.xxhash64("h", "c", F.least("b", "o"), F.greatest("b", "o")).alias("tile"), (F.col("b") > F.col("o")).cast("int").alias("side"), "nid", "grp")


def _components(
    docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, bands: int, rows: int, by_row: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The sketches; and set_key, component_id and the number of rows (copies) of every set.

    by_row: also `keeper`, the doc_id and text key of the one row that stays of the component if
    it is a row of this set, else null. It has the least id, then the least set and text key.
    """
    C.prepare(docs.sparkSession)
    sketch = sketches(docs, id_col, text_col, shingle, bands, rows, by_row).checkpoint()
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")] if by_row else []
    nodes = (
        sketch.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *first)
        .withColumn("nid", F.monotonically_increasing_id())
        .checkpoint()
    )
    member = candidates(nodes, bands)
    wanted = member.select("nid").distinct().join(nodes.select("nid", F.col("label").alias("_label"), F.col("set_key").alias("_key")), "nid")
    sets = shingle_sets(docs, wanted, id_col, text_col, shingle).checkpoint()
    found = components(linked_to_first(star_tiles(member).join(sets, "nid"), percent)).checkpoint()
    more = linked_across(cross_tiles(member, nodes, found, percent).join(sets, "nid"), percent).checkpoint()
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)).checkpoint()
    least = [F.min(F.struct(F.col("label").isNull().alias("no_id"), "label", "set_key"))["set_key"].alias("stays")] if by_row else []
    name = found.withColumnRenamed("node", "nid").join(nodes.select("nid", "label", "set_key"), "nid").groupBy("root").agg(F.min("label").alias("top"), F.count("*").alias("_n"), *least).checkpoint()
    named = C.hot_join(found, name, "root", "_n", found.count).select(F.col("node").alias("nid"), "top", *(["stays"] if by_row else []))
    keeper = [F.when(F.coalesce("stays", "set_key") == F.col("set_key"), F.struct("first.doc_id", "first.text_key")).alias("keeper")] if by_row else []
    labels = nodes.join(named, "nid", "left").select("set_key", F.coalesce("top", "label").alias("component_id"), "copies", *keeper).checkpoint()
    return sketch, labels


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row of `docs` of each component: one with its smallest id, null ids last; and all rows with an empty set.

    Rows are told apart by id and text, so rows that share an id, or have none, are decided each
    by its own text; of rows equal in both any one stays.
    """
    sketch, labels = _components(docs, id_col, text_col, percent, shingle, bands, rows, True)
    stays = F.col("keeper").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))
    decided = (
        C.hot_join(sketch.where("set_key is not null"), labels, "set_key", "copies", sketch.count)
        .groupBy("doc_id", "text_key")
        .agg(F.count("*").alias("n"), F.first(stays).alias("stays"))
        .where("not stays or n > 1")
        .select(_row_key("doc_id", F.col("text_key")).alias("_row"), F.col("n").alias("_n"), F.col("stays").alias("_stays"))
        .checkpoint()
    )
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = lambda c: f"c{docs.columns.index(c)}"
    own = named.withColumn("_row", _row_key(at(id_col), text_key(at(text_col))))
    out = C.hot_join(own, decided.select("_row", "_n"), "_row", "_n", sketch.count, "left_anti").drop("_row")
    again = decided.where("_stays").select("_row", "_n")
    if not again.isEmpty():
        out = out.union(C.hot_join(own, again, "_row", "_n", sketch.count).dropDuplicates(["_row"]).drop("_row"))
    return out.toDF(*docs.columns)


def _row_key(id_col: str, key):
    """One string that names a row by its id, which may be null, and its text; null for a null text."""
    return F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.hex(key))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """nid and the full set (sorted 64-bit shingle hashes) of each wanted node, read again from its text."""

    def run(batches):
        s = _sketcher(shingle, BANDS, ROWS)
        for batch in C.slices(batches, 2):
            keys, nids, sets = [], batch.column(0).to_pylist(), []
            for one, want in zip(s.sets(batch.column(2).to_pylist()), batch.column(1).to_pylist()):
                keys.append(set_key(one) == want)
                sets.append(one.tobytes())
            keep = [i for i, ok in enumerate(keys) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([nids[i] for i in keep], pa.int64()), pa.array([sets[i] for i in keep], pa.binary())], names=["nid", "shingles"])

    # A label may be null; such a node's rows all have a null id, and any of them will do.
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))).alias("_id"), C.text_bytes(text_col).alias("_text"))
    some = wanted.withColumn("_id", F.coalesce("_label", F.lit(-(2**62))))
    picked = texts.join(some.hint("shuffle_hash"), "_id").select("nid", "_key", "_text")
    return C.arrow_map(picked, run, "nid long, shingles binary").dropDuplicates(["nid"])

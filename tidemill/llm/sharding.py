"""Sharding by vector bin packing over bytes, tokens and rows.

Documents with equal texts form a group. Every group is packed as a vector (bytes, tokens,
rows): taken from the largest, each goes to the shard whose residual capacity has the highest
dot product with it, among the shards where it still fits; near the end, where nothing fits, to
the shard with most room for bytes. The law kept is `bytes`: shard sizes come out near equal,
and swaps at the end even them out without undoing the balance of tokens and rows.

Packing is distributed. Groups fall into levels by their share of the corpus, each level 64
times lighter than the one before, and the levels are packed one after the other, each into the
room that the ones before left. The groups of a level are dealt to slices of about SLICE groups;
a slice is one task, which packs its groups into its share of every shard's room. So each group
is placed by the rule, no task holds more than a slice, and only loads of shards (one row for
each) reach the driver. A group that outweighs a whole shard (copies may be a third of all rows)
is split by rows into the least number of pieces that fit; all other groups stay whole.

Slots: a shard's rows are dealt to BUCKETS buckets and numbered inside them; a bucket starts
where the ones before it in its shard end, so no shard is sorted in one task.

Tokens are words (runs of non-white-space) unless a column with better counts is named. Groups
are told apart by a 64-bit hash of the text; texts that share one by chance are placed together.

Defined cases: null text has size 1, no tokens, CRC 0 and forms one group with empty texts;
equal rows are rows of their own; rows without an id are rows like others; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
#: Groups with a TOP-th of all bytes, tokens or rows are packed first; each level after that holds groups up to STEP times lighter, LEVELS at most.
TOP, STEP, LEVELS = 4096, 64, 5
SLICE = 50_000
BUCKETS = 4096


def pack(weights: np.ndarray, shards: int, room: np.ndarray | None = None) -> np.ndarray:
    """The shard of each unit: weights is units x dimensions, room is shards x dimensions (equal shares if not given).

    Dimensions are scaled to the mean load of a shard.
    """
    mean = np.maximum(weights.sum(axis=0) / shards, 1e-9)
    scaled = weights / mean
    order = np.lexsort((np.arange(len(scaled)), -scaled[:, 0], -scaled.max(axis=1)))
    residual = np.ones((shards, weights.shape[1])) if room is None else room / mean
    out = np.zeros(len(scaled), dtype=np.int32)
    for i in order.tolist():
        w = scaled[i]
        fits = (residual >= w).all(axis=1)
        if fits.any():
            at = int(np.argmax(np.where(fits, residual @ w, -np.inf)))
        else:  # sizes are the law: the shard with most room for bytes, then for the rest
            at = int(np.lexsort((-(residual @ w), -residual[:, 0]))[0])
        residual[at] -= w
        out[i] = at
    return settle(scaled, out, residual)


#: How much a gap in bytes, tokens and rows counts.
WORTH = np.array([16.0, 1.0, 1.0])


def settle(scaled: np.ndarray, out: np.ndarray, residual: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Move or swap units between the fullest and the emptiest shard, by bytes, else by rows or tokens, while that evens all out."""
    room = residual.copy()
    size = np.concatenate((scaled, np.zeros((1, scaled.shape[1]))))  # the last one: a move without a swap
    worth = WORTH[: scaled.shape[1]]
    for _ in range(rounds):
        for d in (0, *range(scaled.shape[1] - 1, 0, -1)):
            full, empty = int(np.argmin(room[:, d])), int(np.argmax(room[:, d]))
            a, b = np.flatnonzero(out == full), np.append(np.flatnonzero(out == empty), len(scaled))
            if full == empty or not len(a):
                continue
            gap = room[empty] - room[full]
            b = b[np.argsort(size[b, d], kind="stable")]
            near = np.searchsorted(size[b, d], size[a, d] - gap[d] / 2)
            i, j = (x.ravel() for x in np.broadcast_arrays(a[:, None], b[np.clip(near[:, None] + np.arange(-3, 3), 0, len(b) - 1)]))
            gain = ((gap**2 - (gap - 2 * (size[i] - size[j])) ** 2) * worth).sum(axis=1)
            k = int(np.argmax(gain))
            if gain[k] <= 1e-15:
                continue
            change = size[i[k]] - size[j[k]]
            out[i[k]] = empty
            if j[k] < len(scaled):
                out[j[k]] = full
            room[full] += change
            room[empty] -= change
            break
        else:
            break
    return out


_PLACED = "g long, piece int, n long, shard int"


def _pack_slice(table: pa.Table, shards: int, room: np.ndarray) -> pa.Table:
    """One slice: its groups into its share of the room of each shard."""
    weights = np.column_stack([table[c].to_numpy().astype(np.float64) for c in ("b", "t", "r")])
    total = weights.sum(axis=0)
    share = np.maximum(room, 0)
    share = share / np.maximum(share.sum(axis=0), 1e-9) * total
    order = np.lexsort((table["piece"].to_numpy(), table["g"].to_numpy()))  # ties don't depend on partitioning
    shard = np.empty(len(weights), dtype=np.int32)
    shard[order] = pack(weights[order], shards, share)
    return pa.table([table["g"], table["piece"], table["r"], pa.array(shard)], names=["g", "piece", "n", "shard"])


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tokens_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens, shard and slot of every document row."""
    spark = docs.sparkSession
    C.prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("n_tokens"),
        F.xxhash64(text).alias("g"),
        F.xxhash64(F.col(id_col), F.spark_partition_id()).alias("spread"),  # tells apart rows that are equal
    ).checkpoint()
    total = rows.agg(F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")).first()
    if not total.r:
        return rows.select("doc_id", "size", "text_crc32", "n_tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = np.array([total.b, total.t or 1, total.r], dtype=np.float64)
    share = F.greatest(*[F.col(c) / F.lit(float(x)) for c, x in zip("btr", whole)])
    sums = F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")
    # Groups over a shard's capacity: at most 3 * shards, so they may be broadcast.
    split = rows.groupBy("g").agg(*sums).where(share * shards > 1).select("g", F.least(F.ceil(share * shards), F.col("r")).cast("int").alias("pieces"))
    placed = rows.join(F.broadcast(split), "g", "left").withColumn("piece", F.pmod("spread", F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log(F.lit(1.0 / TOP) / share) / F.lit(float(np.log(STEP))))))
    units = placed.groupBy("g", "piece").agg(*sums).withColumn("level", level.cast("int")).checkpoint()
    room = np.tile(whole / shards, (shards, 1))
    done = None
    for at, n in sorted((r.level, r.n) for r in units.groupBy("level").agg(F.count("*").alias("n")).collect()):
        slices = -(-n // SLICE)
        f = lambda t, room=room: _pack_slice(t, shards, room)
        some = units.where(F.col("level") == at)
        packed = some.groupBy(F.pmod(F.xxhash64("g", "piece"), F.lit(slices))).applyInArrow(C.arrow_groups(f, __name__), _PLACED).checkpoint()
        load = packed.join(some.select("g", "piece", "b", "t", "r"), ["g", "piece"]).groupBy("shard").agg(F.sum("b"), F.sum("t"), F.sum("r")).collect()
        room = room.copy()
        for r in load:
            room[r[0]] -= np.array(r[1:], dtype=np.float64)
        done = packed if done is None else done.union(packed)
    out = C.hot_join(placed, done, ["g", "piece"], "n", lambda: total.r).withColumn("bucket", F.pmod(F.xxhash64("spread", "g"), F.lit(BUCKETS)).cast("int")).checkpoint()
    sizes = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g", "spread")) - 1
    return out.withColumn("inside", inside).join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))

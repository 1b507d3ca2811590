"""Connected components of an edge table, by DataFrame rounds only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _with_least(edges: DataFrame, total: Callable[[], int]) -> tuple[DataFrame, DataFrame]:
    """(u, m: the least neighbour, deg) of every u; and the edges with m. Hubs don't meet their m in one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).checkpoint()
    return least, C.hot_join(edges, least, "u", "deg", total)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long): root is the smallest node reachable.

    Alternates two star contractions until only stars are left: each node hands its larger
    neighbours to the smallest node it knows, then itself and its smaller neighbours. The number
    of rounds grows with the logarithm of the longest path. Every minimum is a hash aggregate
    with map-side combining and every hand-over a join whose hot keys are split off, so no
    neighbour list is gathered in one task; each step is cut off by a checkpoint. Loops and
    repeated edges do no harm.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, met = _with_least(both, both.count)
        # A node without smaller neighbours is a centre; if each other node has one neighbour, all is stars.
        if least.where("m < u and deg > 1").isEmpty():
            break
        large = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().checkpoint()
        _, met = _with_least(large, large.count)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

"""Item lineage as columns: an id per source row, the path it took, and its outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import DEAD_LETTER, FAIL, SKIP, Policy, Rule, failure

ID, PATH = "_lineage_id", "_lineage_path"
#: Outcomes of a row at a node.
EMITTED, CONSUMED, FILTERED, DEAD_LETTERED, ERROR, JOINED, AGGREGATED = "Emitted", "ConsumedWithoutEmission", "FilteredOut", "DeadLettered", "Error", "Joined", "Aggregated"
#: How many rows a node gives for each row it takes.
CARDINALITIES = ("1:1", "1:0..1", "1:n", "n:1", "n:m")
_OUTCOME = {FAIL: ERROR, SKIP: FILTERED, DEAD_LETTER: DEAD_LETTERED}


def sampled(key: Column, every: int = 100) -> Column:
    """True for about one in `every` ids, always the same ones: by the first 60 bits of the id's MD5, which every engine has."""
    if every < 1:
        raise ValueError("every must be at least 1")
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(every)) == 0


def start(df: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Adds the id, made of the source's name and the row's key, so it is the same in every run."""
    name = F.sha2(F.concat_ws("\x1f", F.lit(source), *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    return df.withColumns({ID: F.substring(name, 1, 32), PATH: F.array(F.lit(source))})


def through(df: DataFrame, node: str) -> DataFrame:
    return df.withColumn(PATH, F.concat(PATH, F.array(F.lit(node))))


def contributors() -> Column:
    """For aggregates: the sorted ids that went into a result."""
    return F.sort_array(F.collect_set(ID)).alias("_lineage_ids")


def outcomes(df: DataFrame, node: str, rules: Sequence[Rule], policy: Policy, keep_as: str = EMITTED) -> DataFrame:
    """The rows with _outcome: what becomes of each row at a node with rules, one projection over the rows that reach it.

    Rows that share an id have each their own outcome. A row whose failure stops the job is an Error.
    """
    kind = failure(rules)["kind"]
    out = F.lit(keep_as)
    for k in dict.fromkeys(r.kind for r in rules):
        out = F.when(kind == k, F.lit(_OUTCOME[policy.action(k)])).otherwise(out)
    return df.withColumn("_outcome", out)


def hop(node: str, outcome: Column | str, cardinality: str = "1:1", took_in: Column | None = None, gave: Column | None = None) -> Column:
    """A hop record: node, outcome, declared cardinality, and how many rows went in and came out of it."""
    if cardinality not in CARDINALITIES:
        raise ValueError(f"a cardinality is one of {CARDINALITIES}")
    result = F.lit(outcome) if isinstance(outcome, str) else outcome
    count = lambda c: (F.lit(1) if c is None else c).cast("long")
    return F.struct(F.lit(node).alias("node"), result.alias("outcome"), F.lit(cardinality).alias("cardinality"), count(took_in).alias("took_in"), count(gave).alias("gave"))


def exploded(before: DataFrame, after: DataFrame, node: str) -> DataFrame:
    """id and a hop record for every id that reached a 1:n node: Emitted with its number of rows, or ConsumedWithoutEmission."""
    gave = after.groupBy(ID).agg(F.count("*").alias("_gave"))
    took = before.groupBy(ID).agg(F.count("*").alias("_took"))
    n = F.coalesce("_gave", F.lit(0))
    return took.join(gave, ID, "left").select(ID, hop(node, F.when(n > 0, EMITTED).otherwise(CONSUMED), "1:n", F.col("_took"), n).alias("hop"))


def merged_ids(joined: DataFrame, *columns: str) -> DataFrame:
    """After a join: the ids of both sides as contributors, and Joined as the outcome."""
    return joined.withColumns({"_lineage_ids": F.array_sort(F.array_compact(F.array(*columns))), "_outcome": F.lit(JOINED)})

"""Windowed and plain aggregation with a library of named aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import end_of, tumbling, windows_of

#: Named aggregates over one column. median and count_distinct hold a group's different values, collect all of them;
#: for groups of any size take approx_median, approx_count_distinct, or exact_percentile().
NAMED = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "stddev": lambda c: F.stddev(c),
    "median": lambda c: F.percentile(c, 0.5),
    "approx_median": lambda c: F.approx_percentile(c, 0.5),
    "count_distinct": lambda c: F.countDistinct(c),
    "approx_count_distinct": lambda c: F.approx_count_distinct(c),
    "collect": lambda c: F.sort_array(F.collect_list(c)),
}


def percentile(p: float, accuracy: int = 10_000):
    """The p-th percentile of a column by a sketch of fixed size, which suits groups of any size."""
    return lambda c: F.approx_percentile(c, p, accuracy)


def exact_percentile(df: DataFrame, keys: Sequence[str], column: str, p: float, name: str = "percentile") -> DataFrame:
    """keys and the exact p-th percentile, between neighbours by distance, for groups too large for memory.

    Equal values are counted before the shuffle; a group's distinct values are then read in
    order, from sorted runs that may spill, and never held together.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_v")
    whole = Window.partitionBy(*keys)
    at = (F.sum("_c").over(whole) - 1) * F.lit(p)
    seen = counts.withColumns({"_upto": F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_at": at})
    low = F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_v")))
    share = F.first("_at") - F.floor(F.first("_at"))
    return seen.groupBy(*keys).agg((low + (high - low) * share).alias(name))


def first_by(value: str, order: str) -> Column:
    """The value of the earliest row."""
    return F.min_by(value, order)


def last_by(value: str, order: str) -> Column:
    return F.max_by(value, order)


def exact_sum(c: str | Column, kind: str = "decimal(18,4)") -> Column:
    """A sum of doubles that does not depend on order: added as decimals, given as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(kind)).cast("double")


def aggregate(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def tumbling_aggregate(df: DataFrame, time: str, size: timedelta, keys: Sequence[str], **measures: Column) -> DataFrame:
    """window_start, window_end, keys and measures for every (window, key) that has rows."""
    return _windowed(df.withColumn("window_start", tumbling(F.col(time), size)), size, keys, measures)


def sliding_aggregate(df: DataFrame, time: str, size: timedelta, slide: timedelta, keys: Sequence[str], **measures: Column) -> DataFrame:
    """As above for overlapping windows; a row counts in each window that holds it.

    If the slide divides the size, rows are not multiplied before the shuffle for measures
    that combine; see sliding_sums().
    """
    return _windowed(df.withColumn("window_start", F.explode(windows_of(F.col(time), size, slide))), size, keys, measures)


def sliding_sums(df: DataFrame, time: str, size: timedelta, slide: timedelta, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Sliding sums by panes: rows are summed once per slide, then whole panes are added up."""
    if size % slide:
        raise ValueError("the slide must divide the size")
    panes = df.groupBy(tumbling(F.col(time), slide).alias("_pane"), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    spread = panes.withColumn("window_start", F.explode(windows_of(F.col("_pane"), size, slide)))
    return _windowed(spread, size, keys, {n: F.sum(n) for n in sums})


def _windowed(df: DataFrame, size: timedelta, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    out = df.groupBy("window_start", *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select("window_start", end_of(F.col("window_start"), size).alias("window_end"), *keys, *measures)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], **what: str) -> DataFrame:
    """Analytic columns {name: rank | dense_rank | row_number} inside each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    kinds = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}
    return df.withColumns({n: kinds[k]().over(w) for n, k in what.items()})


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, back: int = 1, ahead: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{column}_lag": F.lag(column, back).over(w), f"{column}_lead": F.lead(column, ahead).over(w)})


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], **measures: Column) -> DataFrame:
    """Measures over all rows of the group up to and including this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: c.over(w) for n, c in measures.items()})


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark trims groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")

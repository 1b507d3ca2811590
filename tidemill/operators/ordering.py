"""Global row numbers without one global sort task, and what builds on them: batches and sampling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_checkpoints
from .windows import tumbling


def ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows dealt by range and sorted: _p is the range's number, _i the row's place in it from 1.

    The bounds of ranges come from a sample and may differ when they are computed again, so
    the result is checkpointed: every later use, also after a lost executor, sees one dealing.
    """
    spark = df.sparkSession
    with_checkpoints(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id counts rows inside each partition in its lower 33 bits.
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return dealt.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_m").checkpoint()


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1, 2, 3 ... over the whole dataset in the given order.

    Rows are dealt to partitions by range and sorted there; the counts of the partitions, one
    row each, give every partition its offset. No task sees more than its range. The order
    must be total for reproducible numbers.
    """
    dealt = ranges(df, order)
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_c"))  # one row for each partition
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return dealt.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def batches(df: DataFrame, size: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows gathered `size` at a time, in order: batch (from 0), n, and items, an array of structs.

    keys: batches within each key. The last batch may be smaller; no rows, no batch.
    """
    if size <= 0:
        raise ValueError("the batch size must be positive")
    if keys:
        row = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        row = numbered(df, order, "_r")
    row = row.withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("long"))
    item = F.struct("_r", *df.columns)
    out = row.groupBy(*keys, "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("_items"))
    return out.withColumn("items", F.transform("_items", lambda x: F.struct(*[x[c].alias(c) for c in df.columns]))).drop("_items")


def timed_batches(df: DataFrame, size: int, every: timedelta, time: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows gathered by size or time, whichever is full first: batches of at most `size` rows that never cross a multiple of `every`.

    Time is the rows' own, so the outcome can be repeated. Columns: keys, window_start, batch (from 0 in its window), n and items.
    """
    if size <= 0:
        raise ValueError("the batch size must be positive")
    put = df.withColumn("window_start", tumbling(F.col(time), every))
    return batches(put, size, order, [*keys, "window_start"])


def unbatch(df: DataFrame, column: str = "items") -> DataFrame:
    """The elements of each batch as rows, with their position; empty and null batches give none."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("position", "item")).select("*", "item.*").drop("item")


def sampled(df: DataFrame, rate: int, order: Sequence[str], name: str = "sampled") -> DataFrame:
    """All rows, marked: the first `rate` and then each `rate`-th. Nothing is removed."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return numbered(df, order, "_r").withColumn(name, (F.col("_r") <= rate) | (F.col("_r") % rate == 0)).drop("_r")


def late_marks(df: DataFrame, time: str, order: Sequence[str], delay_us: int, keys: Sequence[str] = (), name: str = "late") -> DataFrame:
    """Marks rows below the watermark at their arrival: the greatest time of all rows before, less the delay.

    With keys the watermark is kept for each key, which is the scalable form. Without, the
    running maximum is taken by range partitions, as in numbered().
    """
    micros = F.unix_micros(F.col(time))
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(micros < F.max(micros).over(w) - delay_us, F.lit(False)))
    dealt = ranges(df, order).withColumn("_t", micros)
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    marked = dealt.withColumn("_m", F.max("_t").over(inside))
    highest = dealt.groupBy("_p").agg(F.max("_t").alias("_h"))  # one row for each partition
    before = highest.withColumn("_b", F.max("_h").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_b")
    mark: Column = F.greatest("_m", "_b") - delay_us
    return marked.join(F.broadcast(before), "_p").withColumn(name, F.coalesce(F.col("_t") < mark, F.lit(False))).drop("_p", "_i", "_t", "_m", "_b")

"""Time windows [start, end), aligned to 0001-01-01, and sessions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import EPOCH_OFFSET_US, floor_to


def micros(size: timedelta) -> int:
    us = size // timedelta(microseconds=1)
    if us <= 0:
        raise ValueError("a window must have a positive size")
    return us


def interval(size: timedelta) -> str:
    return f"{micros(size)} microseconds"


def start_offset(step: timedelta) -> str:
    """startTime for F.window(), so that windows of this step align to 0001-01-01."""
    return f"{-EPOCH_OFFSET_US % micros(step)} microseconds"


def tumbling(time: Column, size: timedelta) -> Column:
    """Start of the window that holds `time`."""
    return floor_to(time, size)


def windows_of(time: Column, size: timedelta, slide: timedelta) -> Column:
    """Starts of all windows that hold `time`, the latest first; none if the slide leaves gaps there."""
    last = floor_to(time, slide)
    n = -(-micros(size) // micros(slide))
    starts = F.array(*[F.timestamp_micros(F.unix_micros(last) - F.lit(i * micros(slide))) for i in range(n)])
    return F.filter(starts, lambda s: F.unix_micros(s) + F.lit(micros(size)) > F.unix_micros(time))


def end_of(start: Column, size: timedelta) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.lit(micros(size)))


def spark_window(time: Column, size: timedelta, slide: timedelta | None = None) -> Column:
    """F.window() with the alignment used here; works on streams with watermarks (slide not above size)."""
    return F.window(time, interval(size), interval(slide or size), start_offset(slide or size))


def sessions(df: DataFrame, keys: list[str], time: str, gap: timedelta, cap: int | None = None, name: str = "session") -> DataFrame:
    """Numbers the sessions of each key: a pause of `gap` or more starts a new one, and so does every `cap` events.

    Rows with equal times are ordered by the other columns, so numbers are reproducible.
    """
    others = [c for c in df.columns if c not in (*keys, time)]
    order = Window.partitionBy(*keys).orderBy(time, *others)
    pause = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(order))
    numbered = df.withColumn(name, F.sum((pause >= micros(gap)).cast("int")).over(order)).withColumn(name, F.coalesce(name, F.lit(0)))
    if cap:
        inside = Window.partitionBy(*keys, name).orderBy(time, *others)
        part = F.floor((F.row_number().over(inside) - 1) / F.lit(cap))
        numbered = numbered.withColumn("_part", part).withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(name, "_part")) - 1).drop("_part")
    return numbered

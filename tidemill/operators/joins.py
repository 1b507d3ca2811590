"""Keyed, time-windowed and self joins, and lookups.

The keyed join is one-to-one, not relational. The left side arrives first and waits, one row
for each key (the first); a right row takes the row that waits under its key and both are gone;
a right row that finds none waits itself, the first of its key again. So with L and R the rows
of a key in arrival order, the match is (L1, R1); unmatched are L1 if R is empty, and R1 if L
is empty, else R2 if there is one. Null keys are left out. Arrival is a column, since rows of a
DataFrame have no order of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import tumbling, windows_of

INNER, LEFT, RIGHT, FULL = "inner", "left", "right", "full"
_HOW = (INNER, LEFT, RIGHT, FULL)


def _first(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key, with their rank; two aggregates with map-side combining, no sort of whole groups."""
    row = F.struct(*arrival, *[c for c in names if c not in arrival])
    best = df.groupBy(*keys).agg(F.min(row).alias("_1"))
    if n == 1:
        return best.select(*keys, F.lit(1).alias("_n"), "_1")
    # The second is the least row above the first; ties in arrival fall to the other columns.
    rank = Window.partitionBy(*keys).orderBy(*arrival, *[c for c in names if c not in arrival])
    return df.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= n).select(*keys, "_n", row.alias("_1"))


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_arrival: Sequence[str], right_arrival: Sequence[str],
    how: str = INNER, max_capacity: int | None = None,
) -> DataFrame:
    """One-to-one join on `keys`; returns keys, then struct columns l and r (null on the side without a row).

    max_capacity: a side stops keeping new keys once that many wait; the first by arrival stay.
    Columns a row consists of must be orderable.
    """
    if how not in _HOW:
        raise ValueError(f"how must be one of {_HOW}")
    present = lambda df: df.where(F.coalesce(F.expr(" and ".join(f"`{k}` is not null" for k in keys)), F.lit(False)))
    lv = [c for c in left.columns if c not in keys]
    rv = [c for c in right.columns if c not in keys]
    first_left = _first(present(left), keys, left_arrival, lv, 1).select(*keys, F.col("_1").alias("l"))
    if max_capacity is not None:
        first_left = first_left.orderBy(*[F.col(f"l.{a}") for a in left_arrival]).limit(max_capacity)
    rows = _first(present(right), keys, right_arrival, rv, 1 if how in (INNER, LEFT) else 2).select(*keys, "_n", F.col("_1").alias("r"))
    if how in (INNER, LEFT):
        out = first_left.join(rows.drop("_n"), list(keys), "inner" if how == INNER else "left")
        return out.select(*keys, *_ordered("l", lv), *_ordered("r", rv))
    joined = first_left.join(rows, list(keys), "full" if how == FULL else "right")
    matched = F.col("l").isNotNull() & (F.col("_n") == 1)
    lonely_left = F.col("_n").isNull()
    parked = F.when(F.col("l").isNull(), F.col("_n") == 1).otherwise(F.col("_n") == 2)
    out = joined.where(matched | lonely_left | parked).withColumn("_parked", F.coalesce(parked, F.lit(False)))
    if max_capacity is not None:
        waiting = out.where("_parked").orderBy(*[F.col(f"r.{a}") for a in right_arrival]).limit(max_capacity)
        out = out.where("not _parked").unionByName(waiting)
    return out.withColumn("l", F.when(~F.col("_parked"), F.col("l"))).select(*keys, *_ordered("l", lv), *_ordered("r", rv))


def _ordered(side: str, names: Sequence[str]) -> list[Column]:
    """A side's struct with its columns in their own order."""
    return [F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{c}") for c in names])).alias(side)]


def projected(joined: DataFrame, keys: Sequence[str], both: dict[str, Column], left_only: dict[str, Column] | None = None, right_only: dict[str, Column] | None = None) -> DataFrame:
    """The result of keyed_join() through projections of its own for matches and for unmatched rows of either side; a row without one for its case is left out."""
    cases = [(F.col("l").isNotNull() & F.col("r").isNotNull(), both), (F.col("r").isNull(), left_only), (F.col("l").isNull(), right_only)]
    given = [(test, columns) for test, columns in cases if columns is not None]
    out = []
    for name in both:
        value = None
        for test, columns in given:
            value = F.when(test, columns[name]) if value is None else value.when(test, columns[name])
        out.append(value.alias(name))
    kept = None
    for test, _ in given:
        kept = test if kept is None else kept | test
    return joined.where(kept).select(*keys, *out)


def flat(joined: DataFrame, keys: Sequence[str], left_prefix: str = "", right_prefix: str = "") -> DataFrame:
    """The structs of keyed_join as plain columns; unmatched sides are null by name."""
    names = lambda s: joined.schema[s].dataType.names
    return joined.select(*keys, *[F.col(f"l.{c}").alias(left_prefix + c) for c in names("l")], *[F.col(f"r.{c}").alias(right_prefix + c) for c in names("r")])


def windowed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, size: timedelta, slide: timedelta | None = None,
    left_arrival: Sequence[str] | None = None, right_arrival: Sequence[str] | None = None, how: str = INNER, max_capacity: int | None = None,
) -> DataFrame:
    """The keyed join inside every time window: a pair comes once for each window both rows lie in. max_capacity counts pairs of window and key."""
    def put(df: DataFrame, time: str) -> DataFrame:
        if slide is None:
            return df.withColumn("window_start", tumbling(F.col(time), size))
        return df.withColumn("window_start", F.explode(windows_of(F.col(time), size, slide)))

    return keyed_join(put(left, left_time), put(right, right_time), ["window_start", *keys], left_arrival or [left_time], right_arrival or [right_time], how, max_capacity)


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = INNER) -> DataFrame:
    """The relational join: every pair with equal keys."""
    return left.join(right, list(on), how)


def self_join(df: DataFrame, left_key: str, right_key: str | None = None, how: str = INNER, other: DataFrame | None = None) -> DataFrame:
    """Every pair with equal keys as structs l and r, a row with itself too; keys may differ by side."""
    if how not in _HOW:
        raise ValueError(f"how must be one of {_HOW}")
    other = df if other is None else other
    l = df.select(F.struct(*df.columns).alias("l"), F.col(left_key).alias("_lk"))  # noqa: E741
    r = other.select(F.struct(*other.columns).alias("r"), F.col(right_key or left_key).alias("_rk"))
    return l.join(r, F.col("_lk") == F.col("_rk"), how).select("l", "r")


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, values: dict[str, str], hit: str | None = None, small: bool = False) -> DataFrame:
    """Every row of df with values {new name: dim column} of the first dim row under its key, null without one.

    The dim is made unique by key first (the least row wins), so rows never multiply. small:
    the caller knows that dim has a fixed small size; then it is broadcast. Otherwise Spark
    decides by measured size.
    """
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(values.values())])
    unique = dim.where(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias("_key")).agg(F.min(row).alias("_row"))
    unique = unique.select("_key", F.lit(True).alias("_hit"), *[F.col(f"_row._{i}").alias(f"_new_{n}") for i, n in enumerate(values)])
    joined = df.join(F.broadcast(unique) if small else unique, F.col(key) == F.col("_key"), "left")
    kept = [c for c in df.columns if c not in values]
    extra = [F.coalesce("_hit", F.lit(False)).alias(hit)] if hit else []
    return joined.select(*kept, *[F.col(f"_new_{n}").alias(n) for n in values], *extra)


def lookup_map(column: Column | str, table: dict) -> Column:
    """A lookup in a literal table: null for keys it does not have."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column) if isinstance(column, str) else column)

"""Array cleansing. A null array stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import is_blank


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count(n: int) -> int:
    if n < 0:
        raise ValueError("the count must not be negative")
    return n


def remove_nulls(c: Column | str) -> Column:
    return F.array_compact(_c(c))


def remove_duplicates(c: Column | str) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(_c(c))


def remove_empty(c: Column | str) -> Column:
    """Drops null and empty strings."""
    return F.filter(_c(c), lambda x: x.isNotNull() & (x != ""))


def remove_blank(c: Column | str) -> Column:
    """Drops null and white-space-only strings."""
    return F.filter(_c(c), lambda x: ~is_blank(x))


def sort(c: Column | str) -> Column:
    """Ascending, nulls first."""
    return F.sort_array(_c(c))


def reverse(c: Column | str) -> Column:
    return F.reverse(_c(c))


def take(c: Column | str, n: int) -> Column:
    return F.slice(_c(c), 1, _count(n))


def skip(c: Column | str, n: int) -> Column:
    c = _c(c)
    return F.slice(c, F.lit(_count(n) + 1), F.greatest(F.size(c) - n, F.lit(0)))

"""Numeric cleansing. A null stays null unless said otherwise."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low: Any, high: Any) -> Column:
    if low > high:
        raise ValueError("low must not exceed high")
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def at_least(c: Column | str, low: Any) -> Column:
    """A lower bound: smaller values become `low`."""
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def at_most(c: Column | str, high: Any) -> Column:
    """An upper bound: greater values become `high`."""
    c = _c(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    if digits < 0:
        raise ValueError("digits must not be negative")
    return F.bround(_c(c), digits)


def floor(c: Column | str) -> Column:
    return F.floor(_c(c)).cast("double")


def ceiling(c: Column | str) -> Column:
    return F.ceil(_c(c)).cast("double")


def absolute(c: Column | str) -> Column:
    return F.abs(_c(c))


def zero_if_negative(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def scale(c: Column | str, factor: Any, as_type: str | None = None) -> Column:
    """c times factor; name the source type to keep a decimal's scale."""
    out = _c(c) * F.lit(factor)
    return out.cast(as_type) if as_type else out


def default_if_null(c: Column | str, default: Any) -> Column:
    return F.coalesce(_c(c), F.lit(default))


def default_if_zero(c: Column | str, default: Any) -> Column:
    c = _c(c)
    return F.when(c == 0, F.lit(default)).otherwise(c)

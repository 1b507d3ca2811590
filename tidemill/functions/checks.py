"""Validation predicates: boolean columns that are never null.

Each says what it yields on null, as `null passes` or `null fails`, through its last argument.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import convert
from .strings import is_blank


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _on_null(test: Column, passes: bool) -> Column:
    return F.coalesce(test, F.lit(passes))


# --- strings: null passes, but for the first two ------------------------------------------------


def is_not_empty(c):
    return _on_null(_c(c) != "", False)


def is_not_blank(c):
    return ~is_blank(c)


def has_min_length(c, n: int):
    return _on_null(F.length(_c(c)) >= n, True)


def has_max_length(c, n: int):
    return _on_null(F.length(_c(c)) <= n, True)


def has_length_between(c, low: int, high: int):
    return _on_null(F.length(_c(c)).between(low, high), True)


def is_email(c):
    return matches(c, r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z")


def is_url(c):
    """An absolute http or https address with a host."""
    return _on_null(_c(c).rlike(r"(?i)\Ahttps?://[^/?#\s]+[^\s]*\z"), True)


def is_guid(c):
    """Digits alone, with hyphens, in braces or parentheses, or the hexadecimal structure form."""
    plain, hyphens = r"[0-9a-fA-F]{32}", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    nested = r"\{0x[0-9a-fA-F]{1,8},(?:0x[0-9a-fA-F]{1,4},){2}\{(?:0x[0-9a-fA-F]{1,2},){7}0x[0-9a-fA-F]{1,2}\}\}"
    return matches(c, rf"\A(?:{plain}|{hyphens}|\{{{hyphens}\}}|\({hyphens}\)|{nested})\z")


def is_alphanumeric(c):
    return matches(c, r"\A[\p{L}\p{Nd}]*\z")


def is_alphabetic(c):
    return matches(c, r"\A\p{L}*\z")


def is_digits_only(c):
    return matches(c, r"\A\p{Nd}*\z")


def is_numeric(c):
    return _c(c).isNull() | convert.to_double(c).isNotNull()


def matches(c, pattern: str):
    """Unanchored."""
    return _on_null(_c(c).rlike(pattern), True)


def contains(c, text: str, ignore_case: bool = False):
    c = _c(c)
    return _on_null(F.lower(c).contains(text.lower()) if ignore_case else c.contains(text), True)


def starts_with(c, text: str, ignore_case: bool = False):
    c = _c(c)
    return _on_null(F.lower(c).startswith(text.lower()) if ignore_case else c.startswith(text), True)


def ends_with(c, text: str, ignore_case: bool = False):
    c = _c(c)
    return _on_null(F.lower(c).endswith(text.lower()) if ignore_case else c.endswith(text), True)


def is_in_list(c, values: Sequence[Any]):
    return _on_null(_c(c).isin(*values), True)


# --- numbers: null passes; NaN passes no comparison ---------------------------------------------


def _number(c, test: Callable[[Column], Column]) -> Column:
    c = _c(c)
    return _on_null(test(c) & ~F.isnan(c.cast("double")), True)


def is_positive(c):
    return _number(c, lambda x: x > 0)


def is_negative(c):
    return _number(c, lambda x: x < 0)


def is_zero_or_positive(c):
    return _number(c, lambda x: x >= 0)


is_not_negative = is_zero_or_positive


def is_non_zero(c):
    """NaN differs from zero, so it passes."""
    return _on_null(_c(c) != 0, True)


def is_number_between(c, low, high):
    return _number(c, lambda x: x.between(low, high))


def is_even(c):
    return _on_null(_c(c) % 2 == 0, True)


def is_odd(c):
    return _on_null(_c(c) % 2 != 0, True)


def is_finite(c):
    return _number(c, lambda x: F.abs(x) != float("inf"))


def is_integer_value(c):
    return _number(c, lambda x: x == F.floor(x))


def is_greater_than(c, bound):
    return _number(c, lambda x: x > bound)


def is_less_than(c, bound):
    return _number(c, lambda x: x < bound)


def is_not_null(c):
    return _c(c).isNotNull()


# --- dates: null passes ---------------------------------------------------------------------------


def _now(now: datetime | None) -> Column:
    """One instant for the whole query, as a literal."""
    return F.lit(now or datetime.now(timezone.utc))


def is_in_future(c, now: datetime | None = None):
    return _on_null(_c(c) > _now(now), True)


def is_in_past(c, now: datetime | None = None):
    return _on_null(_c(c) < _now(now), True)


def is_today(c, now: datetime | None = None):
    return _on_null(F.to_date(_c(c)) == F.to_date(_now(now)), True)


def is_weekday(c):
    return _on_null(F.weekday(_c(c)) < 5, True)


def is_weekend(c):
    return _on_null(F.weekday(_c(c)) >= 5, True)


def is_not_min_value(c):
    return _on_null(_c(c) != F.expr("timestamp'0001-01-01 00:00:00'"), True)


def is_not_max_value(c):
    return _on_null(_c(c) < F.expr("timestamp'9999-12-31 23:59:59.999999'"), True)


def is_before(c, bound: datetime):
    return _on_null(_c(c) < F.lit(bound), True)


def is_after(c, bound: datetime):
    return _on_null(_c(c) > F.lit(bound), True)


def is_date_between(c, low: datetime, high: datetime):
    if low > high:
        raise ValueError("low must not exceed high")
    return _on_null(_c(c).between(F.lit(low), F.lit(high)), True)


def is_day_of_week(c, day: int):
    """0 is Sunday."""
    return _on_null(F.dayofweek(_c(c)) == day + 1, True)


def is_in_year(c, year: int):
    return _on_null(F.year(_c(c)) == year, True)


def is_in_month(c, month: int):
    if not 1 <= month <= 12:
        raise ValueError("month must be between 1 and 12")
    return _on_null(F.month(_c(c)) == month, True)


def is_utc_type(schema, name: str) -> bool:
    """Whether a column holds instants (UTC) rather than zone-less times: a fact of its type."""
    return schema[name].dataType.typeName() == "timestamp"


def is_local_type(schema, name: str) -> bool:
    return schema[name].dataType.typeName() == "timestamp_ntz"


# --- arrays -----------------------------------------------------------------------------------------


def has_min_count(c, n: int):
    return _on_null(F.size(_c(c)) >= n, False) & _c(c).isNotNull()


def has_max_count(c, n: int):
    return _on_null(F.size(_c(c)) <= n, False) & _c(c).isNotNull()


def has_count_between(c, low: int, high: int):
    """Null counts as empty."""
    return F.when(_c(c).isNull(), F.lit(0)).otherwise(F.size(_c(c))).between(low, high)


def array_is_not_empty(c):
    return has_min_count(c, 1)


def all_match(c, test: Callable[[Column], Column]):
    """Empty passes, null fails."""
    return _on_null(F.forall(_c(c), lambda x: F.coalesce(test(x), F.lit(False))), False)


def any_match(c, test: Callable[[Column], Column]):
    return _on_null(F.exists(_c(c), lambda x: F.coalesce(test(x), F.lit(False))), False)


def none_match(c, test: Callable[[Column], Column]):
    return _on_null(~F.exists(_c(c), lambda x: F.coalesce(test(x), F.lit(False))), True)


def array_contains(c, value):
    return _on_null(F.exists(_c(c), lambda x: x.eqNullSafe(F.lit(value))), False)


def does_not_contain(c, value):
    return _on_null(~F.exists(_c(c), lambda x: x.eqNullSafe(F.lit(value))), True)


def all_unique(c):
    return _on_null(F.size(F.array_distinct(_c(c))) == F.size(_c(c)), True)


def is_subset_of(c, allowed: Sequence[Any]):
    return _on_null(F.size(F.array_except(_c(c), F.array(*[F.lit(v) for v in allowed]))) == 0, True)

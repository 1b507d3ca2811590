"""Date and time cleansing over UTC timestamps. A null stays null unless said otherwise.

Intervals count from 0001-01-01, which is a Monday; EPOCH_OFFSET_US is its distance to 1970.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_OFFSET_US = 719_162 * 86_400_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _us(size: timedelta) -> int:
    us = size // timedelta(microseconds=1)
    if us <= 0:
        raise ValueError("the interval must be positive")
    return us


def floor_to(c: Column | str, size: timedelta) -> Column:
    """Down to a multiple of `size` since 0001-01-01."""
    us = F.lit(_us(size))
    shifted = F.unix_micros(_c(c)) + F.lit(EPOCH_OFFSET_US)
    return F.timestamp_micros(shifted - F.pmod(shifted, us) - F.lit(EPOCH_OFFSET_US))


truncate = floor_to


def as_utc_instant(c: Column | str) -> Column:
    """Label a zone-less time as UTC, without a shift."""
    return _c(c).cast("timestamp")


def as_zoneless(c: Column | str) -> Column:
    """Drop the UTC label, without a shift (session zone UTC)."""
    return _c(c).cast("timestamp_ntz")


def to_utc(c: Column | str, zone: str) -> Column:
    """A local time of `zone` to UTC."""
    return F.to_utc_timestamp(_c(c), zone)


def to_local(c: Column | str, zone: str) -> Column:
    """A UTC time to the local time of `zone`."""
    return F.from_utc_timestamp(_c(c), zone)


def strip_time(c: Column | str) -> Column:
    return F.date_trunc("DAY", _c(c))


def _round(c: Column | str, unit: str, half: timedelta) -> Column:
    return F.date_trunc(unit, F.timestamp_micros(F.unix_micros(_c(c)) + F.lit(_us(half))))


def round_to_minute(c: Column | str) -> Column:
    """Half a minute goes up."""
    return _round(c, "MINUTE", timedelta(seconds=30))


def round_to_hour(c: Column | str) -> Column:
    return _round(c, "HOUR", timedelta(minutes=30))


def round_to_day(c: Column | str) -> Column:
    return _round(c, "DAY", timedelta(hours=12))


def clamp(c: Column | str, low: datetime, high: datetime) -> Column:
    if low > high:
        raise ValueError("low must not exceed high")
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def is_min_value(c: Column | str) -> Column:
    return _c(c) == F.expr("timestamp'0001-01-01 00:00:00'")


def is_max_value(c: Column | str) -> Column:
    return _c(c) >= F.expr("timestamp'9999-12-31 23:59:59.999999'")


def default_if_min_value(c: Column | str, default: Any) -> Column:
    return F.when(is_min_value(c), F.lit(default)).otherwise(_c(c))


def default_if_max_value(c: Column | str, default: Any) -> Column:
    return F.when(is_max_value(c), F.lit(default)).otherwise(_c(c))


def default_if_null(c: Column | str, default: Any) -> Column:
    return F.coalesce(_c(c), F.lit(default))

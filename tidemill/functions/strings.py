"""String cleansing. White space means Unicode white space; a null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY_SPACE = r"(?U)\s+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only strings."""
    c = _c(c)
    return c.isNull() | ~c.rlike(r"(?U)\S")


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\A\s+|\s+\z", "")


def trim_start(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\A\s+", "")


def trim_end(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"(?U)\s+\z", "")


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of white space to one space, ends trimmed; blank strings stay as they are."""
    c = _c(c)
    return F.when(is_blank(c), c).otherwise(F.trim(F.regexp_replace(c, _ANY_SPACE, " ")))


def remove_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), _ANY_SPACE, "")


def to_lower(c: Column | str) -> Column:
    return F.lower(_c(c))


def to_upper(c: Column | str) -> Column:
    return F.upper(_c(c))


def to_title_case(c: Column | str) -> Column:
    """Lower case, then a capital at the start of each word; hyphens start words too, apostrophes don't."""
    words = F.split(F.lower(_c(c)), r"(?<=[^\p{L}\p{N}\p{M}'’])|(?=[^\p{L}\p{N}\p{M}'’])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def remove_special_characters(c: Column | str) -> Column:
    """Keeps letters and decimal digits only; spaces go too."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{Nd}]", "")


def remove_digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\p{Nd}", "")


def remove_non_ascii(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")


def truncate(c: Column | str, length: int) -> Column:
    if length < 0:
        raise ValueError("length must not be negative")
    return F.substring(_c(c), 1, length)


def ensure_prefix(c: Column | str, prefix: str) -> Column:
    c = _c(c)
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def ensure_suffix(c: Column | str, suffix: str) -> Column:
    c = _c(c)
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def replace(c: Column | str, old: str, new: str) -> Column:
    """Every literal occurrence."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def default_if_blank(c: Column | str, default: str) -> Column:
    c = _c(c)
    return F.when(is_blank(c), F.lit(default)).otherwise(c)


def default_if_empty(c: Column | str, default: str) -> Column:
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def null_if_blank(c: Column | str) -> Column:
    c = _c(c)
    return F.when(~is_blank(c), c)

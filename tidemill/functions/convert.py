"""Type conversion. Every converter gives a value or null; null and unparsable input count as failures.

Pair a converter with failed() to send the failures to a reject frame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import is_blank, trim


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _try(c: Column, kind: str) -> Column:
    return F.when(~is_blank(c), trim(c)).try_cast(kind)


def _whole(c: Column | str, kind: str) -> Column:
    text = trim(_c(c))
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text).try_cast(kind)


def to_int(c: Column | str) -> Column:
    """An optional sign and digits, blanks around them allowed."""
    return _whole(c, "int")


def to_long(c: Column | str) -> Column:
    return _whole(c, "bigint")


def to_double(c: Column | str) -> Column:
    """Thousands separators are allowed."""
    return _try(F.replace(_c(c), F.lit(","), F.lit("")), "double")


def to_decimal(c: Column | str, precision: int = 38, scale: int = 18) -> Column:
    text = trim(F.replace(_c(c), F.lit(","), F.lit("")))
    return F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), text).try_cast(f"decimal({precision},{scale})")


#: The words read as booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def to_bool(c: Column | str) -> Column:
    word = F.lower(trim(_c(c)))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


#: Custom date letters whose meaning is another in Spark's patterns.
LETTERS = {"dddd": "EEEE", "ddd": "EEE", "tt": "a", "t": "a", "fffffff": "SSSSSS", "ffffff": "SSSSSS", "fffff": "SSSSS", "ffff": "SSSS", "fff": "SSS", "ff": "SS", "f": "S", "FFF": "SSS", "zzz": "xxx", "zz": "x", "K": "XXX", "gg": "G"}


def spark_pattern(pattern: str) -> str:
    """A custom date pattern (yyyy-MM-dd HH:mm:ss.fff tt, quoted text, escaped letters) as Spark writes it."""
    out, rest = [], pattern
    while rest:
        if m := re.match(r"'([^']*)'|\"([^\"]*)\"|\\\\(.)", rest):
            text = next(x for x in m.groups() if x is not None)
            out.append("'" + text.replace("'", "''") + "'")
        else:
            m = re.match(r"([A-Za-z])\1*|[^A-Za-z]", rest)
            letters = m[0]
            out.append(LETTERS.get(letters, letters) if not letters.isalpha() or letters in LETTERS or letters[0] in "yMdHhms" else f"'{letters}'")
        rest = rest[m.end() :]
    return "".join(out)


def to_timestamp(c: Column | str, pattern: str | None = None) -> Column:
    """By an exact Spark pattern (see spark_pattern() for others), or ISO forms without one."""
    text = F.when(~is_blank(_c(c)), trim(_c(c)))
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def to_enum(c: Column | str, names: Sequence[str], ignore_case: bool = True) -> Column:
    """The canonical name of an enumeration's member."""
    text = trim(_c(c))
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when((F.lower(text) == n.lower()) if ignore_case else (text == n), F.lit(n)).otherwise(out)
    return out


def number_to_string(c: Column | str, pattern: str | None = None) -> Column:
    """Plain text, or a printf pattern such as '%.2f'."""
    return F.format_string(pattern, _c(c)) if pattern else _c(c).cast("string")


def timestamp_to_string(c: Column | str, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.date_format(_c(c), pattern)


def bool_to_string(c: Column | str, true: str = "True", false: str = "False") -> Column:
    c = _c(c)
    return F.when(c, F.lit(true)).when(~c, F.lit(false))


def enum_to_string(c: Column | str) -> Column:
    return _c(c).cast("string")


def failed(source: Column | str, converted: Column) -> Column:
    """True where a conversion has no value: null, blank or unparsable input."""
    return _c(source).isNull() | converted.isNull()

"""Access to JSON held in string columns, by dotted paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_value(c: Column | str, path: str, kind: str = "string", ignore_case: bool = False) -> Column:
    """The value at a dotted path, cast to `kind`; null if it is absent or of another kind.

    ignore_case compares property names without case, level by level, the first match winning.
    """
    if not ignore_case:
        dotted = "".join(f"['{p}']" for p in path.split("."))
        return F.get_json_object(_c(c), "$" + dotted).try_cast(kind)
    at = _c(c)
    for part in path.split("."):
        entries = F.from_json(at, "map<string,string>")
        names = F.filter(F.map_keys(entries), _named(part))
        at = F.when(F.size(names) > 0, F.try_element_at(entries, F.get(names, F.lit(0))))
    return at.try_cast(kind)


def _named(part: str):
    return lambda k: F.lower(k) == part.lower()


def has_path(c: Column | str, path: str) -> Column:
    """Whether the path exists, a JSON null included."""
    *parents, last = path.split(".")
    at = F.get_json_object(_c(c), "$" + "".join(f"['{p}']" for p in parents)) if parents else _c(c)
    return F.coalesce(F.array_contains(F.json_object_keys(at), last), F.lit(False))

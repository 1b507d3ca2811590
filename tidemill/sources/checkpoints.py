"""Progress of incremental batch reads, kept as small JSON files in shared storage."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordering import numbered
from ..session import shared_folder

NONE, OFFSET, KEY, CURSOR, MEMORY, CDC = "none", "offset", "key", "cursor", "memory", "cdc"
STRATEGIES = (NONE, OFFSET, KEY, CURSOR, MEMORY, CDC)


class Checkpoints:
    """The last value read for each source; memory: nothing is written.

    offset: how many rows of a total order were read; key: the greatest value of a growing
    column; cursor: the opaque token of a paged source; cdc: the place in a change feed.
    every_rows, every_s: note() writes only after so many rows, or so much time, since the
    last write; flush() writes what it holds back.
    """

    def __init__(self, spark: SparkSession, folder: str, strategy: str = KEY, every_rows: int = 0, every_s: float = 0.0, clock: Callable[[], float] = time.monotonic):
        if strategy not in STRATEGIES:
            raise ValueError(f"a strategy is one of {STRATEGIES}")
        self.spark, self.folder, self.strategy = spark, folder.rstrip("/"), strategy
        self.every_rows, self.every_s, self.clock = every_rows, every_s, clock
        self.held: dict[str, Any] = {}
        self.waiting: dict[str, tuple[Any, int]] = {}
        self.written: dict[str, float] = {}

    def note(self, source: str, value: Any, rows: int = 1) -> bool:
        """Remembers progress, and says whether it was written now."""
        rows += self.waiting.get(source, (None, 0))[1]
        self.waiting[source] = (value, rows)
        since = self.clock() - self.written.setdefault(source, self.clock())
        if (self.every_rows and rows < self.every_rows) and not (self.every_s and since >= self.every_s) or (not self.every_rows and self.every_s and since < self.every_s):
            return False
        self.flush(source)
        return True

    def flush(self, source: str | None = None) -> None:
        for s in [source] if source else list(self.waiting):
            if s in self.waiting:
                self.save(s, self.waiting.pop(s)[0])
                self.written[s] = self.clock()

    def _path(self, source: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{source}.json")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self, source: str) -> Any:
        if self.strategy in (NONE, MEMORY):
            return self.held.get(source) if self.strategy == MEMORY else None
        p, fs = self._path(source)
        if not fs.exists(p):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(p.toString()).collect()))["value"]

    def save(self, source: str, value: Any) -> None:
        if self.strategy == MEMORY:
            self.held[source] = value
        elif self.strategy != NONE:
            p, fs = self._path(source)
            out = fs.create(p, True)
            out.write(bytearray(json.dumps({"value": value}).encode()))
            out.close()


def read_new(df: DataFrame, column: str, checkpoints: Checkpoints, source: str) -> tuple[DataFrame, Any]:
    """Rows above the saved value of a growing column, and the value to save once they are processed."""
    last = checkpoints.load(source)
    new = df if last is None else df.where(F.col(column) > F.lit(last).cast(df.schema[column].dataType))
    top = new.agg(F.max(column).cast("string")).first()[0]
    return new, last if top is None else top


def skip_read(df: DataFrame, order: list[str], checkpoints: Checkpoints, source: str) -> tuple[DataFrame, int]:
    """The offset strategy: rows after the first N in a total order, N being what was read before, and the new N.

    Prefer read_new() where a growing column exists: it filters at the source.
    """
    done = int(checkpoints.load(source) or 0)
    rows = numbered(df, order, "_n").where(F.col("_n") > done).drop("_n")
    return rows, done + rows.count()


def read_pages(spark: SparkSession, page: Callable[[str | None], tuple[list[dict], str | None]], schema: str, checkpoints: Checkpoints, source: str, most: int | None = None, held: int = 10_000) -> tuple[DataFrame, str | None]:
    """The cursor strategy: pages from the saved token on, and the token to save once the rows are processed.

    page(token) gives (items, next token); a cursor leads from page to page, so the driver walks
    it: to the last page, or for at most `most` pages, after which the token leads to the next
    one. The last page has no token after it, so its own is given and a later read begins with it
    again (None if it is the first). From `held` rows on, rows go to the checkpoint folder.
    """
    names = StructType.fromDDL(schema).names
    token, rows, at = checkpoints.load(source), [], None
    for _ in count() if most is None else range(most):
        items, following = page(token)
        rows += [[i.get(n) for n in names] for i in items]
        if following and following == token:
            raise ValueError(f"{source}: cursor {token} leads to itself")
        token = following or token
        if len(rows) >= held:
            at = at or shared_folder(spark)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
            rows = []
        if not following:
            break
    rest = spark.createDataFrame(rows, schema)
    return (rest if at is None else spark.read.schema(schema).parquet(at).unionByName(rest)), token

"""Routing rows by rules, branching to several consumers, and merging datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_MATCH, ALL_MATCHES = "first", "all"
DROP, THROW = "drop", "throw"
COLLECT_AND_THROW, LOG_AND_CONTINUE = "collect", "log"


class Router:
    """Ordered rules, each naming an output; a row without a match goes to `otherwise`, or is dropped, or fails the job."""

    def __init__(self, mode: str = FIRST_MATCH, otherwise: str | None = None, no_match: str = DROP):
        if mode not in (FIRST_MATCH, ALL_MATCHES):
            raise ValueError("unknown routing mode")
        self.mode, self.otherwise, self.no_match = mode, otherwise, no_match
        self.rules: list[tuple[str, Column]] = []

    def when(self, output: str, test: Column) -> Router:
        if any(o == output for o, _ in self.rules):
            raise ValueError(f"output {output} has a rule already")
        self.rules.append((output, test))
        return self

    def outputs(self) -> list[str]:
        return [o for o, _ in self.rules] + ([self.otherwise] if self.otherwise and self.otherwise not in dict(self.rules) else [])

    def route(self, df: DataFrame, name: str = "route") -> DataFrame:
        """The rows with the output they go to; once for each match in the all-matches mode."""
        rest = F.lit(self.otherwise).cast("string")
        if not self.otherwise and self.no_match == THROW:
            rest = F.raise_error(F.lit("no route matches a row")).cast("string")
        if self.mode == FIRST_MATCH:
            out = rest
            for output, test in reversed(self.rules):
                out = F.when(test, F.lit(output)).otherwise(out)
            return df.withColumn(name, out).where(F.col(name).isNotNull())
        hits = F.array_compact(F.array(*[F.when(test, F.lit(output)) for output, test in self.rules]))
        return df.withColumn(name, F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array_compact(F.array(rest)))))

    def split(self, df: DataFrame) -> dict[str, DataFrame]:
        """One dataset for each output."""
        routed = self.route(df, "_route")
        return {o: routed.where(F.col("_route") == o).drop("_route") for o in self.outputs()}

    def check(self, connected: Sequence[str]) -> None:
        missing = [o for o in self.outputs() if o not in connected]
        if missing:
            raise ValueError(f"outputs without a consumer: {missing}")


def branch(df: DataFrame, handlers: Sequence[Callable[[DataFrame], object]], errors: str | Callable[[Exception, DataFrame], object] = COLLECT_AND_THROW, log: Callable[[str], None] = print) -> DataFrame:
    """Runs each handler (an action such as a write) on the dataset and returns the dataset unchanged.

    errors: collect (all handlers run, then their errors are raised together), log, or a
    function that gets each error with the dataset.
    """
    found = []
    for h in handlers:
        try:
            h(df)
        except Exception as e:  # handlers are user code; the mode decides
            if callable(errors):
                errors(e, df)
            elif errors == LOG_AND_CONTINUE:
                log(f"branch handler failed: {e}")
            else:
                found.append(e)
    if found:
        raise ExceptionGroup("branch handlers failed", found)
    return df


def concatenate(*sources: DataFrame, index: str | None = None) -> DataFrame:
    """All rows of all sources; index: adds the source's number, which orders the sources."""
    _same(sources)
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn(index, F.lit(i)) if index else s
        out = s if out is None else out.unionByName(s)
    return out


def interleave(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, in no order."""
    return concatenate(*sources)


def priority_merge(keys: Sequence[str], order: Sequence[str], *sources: DataFrame) -> DataFrame:
    """One row for each key: from the earliest source that has it, the first by `order` there."""
    rank = Window.partitionBy(*keys).orderBy("_source", *order)
    return concatenate(*sources, index="_source").withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_source", "_rank")


def custom_merge(f: Callable[[list[DataFrame]], DataFrame], *sources: DataFrame) -> DataFrame:
    return f(list(sources))


def _same(sources: Sequence[DataFrame]) -> None:
    first = dict(sources[0].dtypes)
    for s in sources[1:]:
        if dict(s.dtypes) != first:
            raise ValueError("merged datasets must have the same columns and types")

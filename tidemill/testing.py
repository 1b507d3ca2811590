"""Helpers for testing pipelines: in-memory sources, capturing sinks, and comparisons without order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

from .plans.pipeline import Context, Pipeline


def memory_source(rows: Iterable[tuple], schema: str) -> Callable[[Context], DataFrame]:
    held = list(rows)
    return lambda context: context.spark.createDataFrame(held, schema)


class Capture:
    """A sink that keeps what it gets."""

    def __init__(self):
        self.rows: list[tuple] = []

    def __call__(self, df: DataFrame) -> None:
        self.rows = [tuple(r) for r in df.collect()]


def run(pipeline: Pipeline, context: Context) -> dict[str, Any]:
    return pipeline.build().run(context)


def assert_rows(df: DataFrame, expected: Iterable[tuple]) -> None:
    """Equal rows, equally often, in any order."""
    got, want = Counter(map(repr, map(tuple, df.collect()))), Counter(map(repr, expected))
    if got != want:
        raise AssertionError(f"missing: {list((want - got).elements())[:10]}; not expected: {list((got - want).elements())[:10]}")

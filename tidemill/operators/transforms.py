"""Element-wise and whole-dataset transforms."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .rules import DEAD_LETTER, FAIL, RETRY, SKIP, Policy


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """Exactly the named outputs, one row for each row."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def set_properties(df: DataFrame, steps: Sequence[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Column setters in order; later ones see what earlier ones wrote. One projection if Catalyst can merge them."""
    for name, f in steps:
        df = df.withColumn(name, f(F.col(name)))
    return df


def opaque(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A transform that only Python can express: batches of rows in, any number of rows out."""
    return df.mapInPandas(f, schema)


def tap(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, object]:
    """The same rows, with named measures gathered while they pass; read them with observation.get after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in (measures or {"rows": F.count(F.lit(1))}).items()]), seen


def composite(df: DataFrame, child: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A child pipeline as one step."""
    return df.transform(child)


def fold(key: Sequence[str], order: str, value: str, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """An order-dependent user aggregate: step(accumulator, item) over each group's values in order.

    It gathers a group's values in one row, so it is for groups of bounded size; use built-in
    aggregates for all that don't depend on order.
    """

    def run(df: DataFrame) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
        return df.groupBy(*key).agg(F.aggregate(items, start, step, finish).alias("result"))

    return run


def per_item(
    df: DataFrame, f: Callable[[dict], dict], schema: str, retries: int = 0, on_error: str = FAIL, policy: Policy | None = None,
    backoff: Callable[[int], float] | None = None, jitter: Callable[[float], float] | None = None,
) -> DataFrame:
    """A Python function from row to row, for work such as calls to services.

    policy: the action for each class of error (by its name, or that of a base class). Retry
    tries up to `retries` more times, after the delays that backoff(1), backoff(2), ... and
    jitter give (see plans.resilience), and then stops the job; Fail stops it at once; Skip
    leaves the row out; DeadLetter gives null columns, the error and the row as JSON: the result
    then has the columns _error and _item, both null for good rows. Without a policy every error
    is retried, and on_error says what becomes of a row that still fails.
    """
    if on_error not in (FAIL, SKIP, DEAD_LETTER):
        raise ValueError(f"unknown action {on_error}")
    names = StructType.fromDDL(schema).names
    letters = on_error == DEAD_LETTER if policy is None else DEAD_LETTER in (*policy.actions.values(), policy.otherwise)

    def tried(row: dict) -> list | None:
        for attempt in range(retries + 1):
            try:
                got = f(row)
                return [*[got.get(n) for n in names], None, None]
            except Exception as e:  # the policy decides about user code
                action = RETRY if policy is None else policy.action_for(e)
                if action == RETRY and attempt < retries:
                    if backoff:
                        time.sleep((jitter or float)(backoff(attempt + 1)))
                    continue
                if policy is None:
                    action = on_error
                if action in (FAIL, RETRY):
                    raise
                return None if action == SKIP else [*[None] * len(names), f"{type(e).__name__}: {e}", json.dumps(row, default=str)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [x for x in map(tried, frame.to_dict("records")) if x is not None]
            made = pd.DataFrame(out, columns=[*names, "_error", "_item"], dtype=object)
            yield made if letters else made[names]

    return df.mapInPandas(run, f"{schema}, _error string, _item string" if letters else schema)


def dead_letters(rejected: DataFrame, most: int = 1000) -> list[dict]:
    """The first rejected rows for a person to look at; write the frame itself to keep them all."""
    return [r.asDict(recursive=True) for r in rejected.limit(most).collect()]

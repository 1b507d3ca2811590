"""Model-backed transforms with an injected Python callable; no model or network is part of this package.

The callable gets a list of prompts and returns as many results, dicts that become columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .routing import Router

Model = Callable[[list[str]], list[dict]]


def ask(model: Model, prompts: list[str]) -> list[dict]:
    """Results for prompts; a wrong number of results is asked for once more, then it is an error."""
    for _ in range(2):
        out = model(prompts)
        if len(out) == len(prompts):
            return out
    raise ValueError(f"the model gave {len(out)} results for {len(prompts)} prompts")


def ai_transform(df: DataFrame, prompt: str, model: Model, schema: str, batch: int = 16) -> DataFrame:
    """The model's results instead of the rows; prompt: the column with the prompt."""
    return df.mapInPandas(_runner(prompt, model, batch, False, _names(df, schema)), schema)


def ai_enrich(df: DataFrame, prompt: str, model: Model, schema: str, batch: int = 16) -> DataFrame:
    """The rows with the model's results as further columns."""
    fields = StructType.fromDDL(schema)
    clash = set(fields.names) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return df.mapInPandas(_runner(prompt, model, batch, True, fields.names), StructType(df.schema.fields + fields.fields))


def ai_route(df: DataFrame, prompt: str, model: Model, schema: str, router: Router, batch: int = 16) -> dict[str, DataFrame]:
    """Enriches, then routes on the enriched columns."""
    return router.split(ai_enrich(df, prompt, model, schema, batch))


def _names(df: DataFrame, schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def _runner(prompt: str, model: Model, batch: int, keep: bool, names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame[prompt].tolist()
            results = [r for i in range(0, len(prompts), batch) for r in ask(model, prompts[i : i + batch])]
            found = pd.DataFrame([[r.get(n) for n in names] for r in results], columns=names, index=frame.index)
            yield pd.concat([frame, found], axis=1) if keep else found

    return run

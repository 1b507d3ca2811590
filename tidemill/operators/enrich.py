"""Enrichment: computed, looked-up and default values, applied in the order they are added."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import is_blank
from .joins import lookup

#: What a column of each type holds by default; other types are null.
TYPE_DEFAULTS = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False}


class Enricher:
    def __init__(self):
        self.steps: list[Callable[[DataFrame], DataFrame]] = []

    def _add(self, f: Callable[[DataFrame], DataFrame]) -> Enricher:
        self.steps.append(f)
        return self

    def compute(self, name: str, value: Column) -> Enricher:
        return self._add(lambda df: df.withColumn(name, value))

    def lookup(self, name: str, key: str, dim: DataFrame, dim_key: str, dim_value: str, small: bool = False) -> Enricher:
        """A hit sets the column, even to null; a miss keeps the old value."""
        return self._add(lambda df: self._from(df, name, key, dim, dim_key, dim_value, small, F.col(name)))

    def set(self, name: str, key: str, dim: DataFrame, dim_key: str, dim_value: str, small: bool = False) -> Enricher:
        """A hit sets the column; a miss sets the default of its type."""

        def run(df: DataFrame) -> DataFrame:
            kind = dict(dim.dtypes)[dim_value]
            default = 0 if kind.startswith("decimal") else TYPE_DEFAULTS.get(kind)
            return self._from(df, name, key, dim, dim_key, dim_value, small, F.lit(default).cast(kind))

        return self._add(run)

    @staticmethod
    def _from(df, name, key, dim, dim_key, dim_value, small, miss) -> DataFrame:
        order = df.columns if name in df.columns else [*df.columns, name]
        found = lookup(df, dim, key, dim_key, {"_found": dim_value}, hit="_hit", small=small)
        return found.withColumn(name, F.when(F.col("_hit"), F.col("_found")).otherwise(miss)).select(*order)

    def default_when(self, name: str, test: Column, default: Any) -> Enricher:
        return self._add(lambda df: df.withColumn(name, F.when(test, F.lit(default)).otherwise(F.col(name))))

    def default_if_null(self, name: str, default: Any) -> Enricher:
        return self.default_when(name, F.col(name).isNull(), default)

    def default_if_empty(self, name: str, default: str) -> Enricher:
        return self.default_when(name, F.col(name).isNull() | (F.col(name) == ""), default)

    def default_if_blank(self, name: str, default: str) -> Enricher:
        return self.default_when(name, is_blank(name), default)

    def default_if_zero(self, name: str, default: Any) -> Enricher:
        return self.default_when(name, F.col(name) == 0, default)

    def default_if_type_default(self, name: str, default: Any) -> Enricher:
        """Null, or zero, or false."""

        def run(df: DataFrame) -> DataFrame:
            zero = TYPE_DEFAULTS.get(dict(df.dtypes)[name])
            test = F.col(name).isNull() if zero is None else (F.col(name).isNull() | (F.col(name) == F.lit(zero)))
            return df.withColumn(name, F.when(test, F.lit(default)).otherwise(F.col(name)))

        return self._add(run)

    def default_if_empty_array(self, name: str, default: Column) -> Enricher:
        return self._add(lambda df: df.withColumn(name, F.when(F.col(name).isNull() | (F.size(name) <= 0), default).otherwise(F.col(name))))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

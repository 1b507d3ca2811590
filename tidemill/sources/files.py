"""CSV, JSON, Parquet and Excel files.

Rows that do not fit the schema go to a quarantine frame or stop the job; they never become
nulls unnoticed. Always pass a schema: reading a file twice to guess one does not scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .storage import StorageUri

CORRUPT = "_corrupt_record"
FAIL, SKIP, QUARANTINE = "fail", "skip", "quarantine"
_MODES = {FAIL: "FAILFAST", SKIP: "DROPMALFORMED", QUARANTINE: "PERMISSIVE"}


def _schema(schema: StructType | str, errors: str) -> StructType:
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType([*s.fields, StructField(CORRUPT, StringType())]) if errors == QUARANTINE else s


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, delimiter: str = ",", errors: str = FAIL, match_header: bool = True, **options) -> DataFrame:
    """match_header: columns are found by their header names without case, blank headers skipped; the order is free.

    All files of a folder must have the header of the first one: another one stops the job
    rather than fill columns with each other's values.
    """
    where = StorageUri.parse(path).spark_path()
    wanted = _schema(schema, errors)
    reader = spark.read.options(header=header, sep=delimiter, mode=_MODES[errors], columnNameOfCorruptRecord=CORRUPT, **options)
    if not (header and match_header):
        return reader.schema(wanted).csv(where)
    names = spark.read.options(header=True, sep=delimiter, **options).csv(where).columns  # first line only
    own = {f.name.lower(): f for f in wanted.fields}
    read = StructType([StructField(n, own[n.strip().lower()].dataType if n.strip().lower() in own else StringType()) for n in names] + [f for f in wanted.fields if f.name == CORRUPT])
    named = all(n.strip() and not n.startswith("_c") for n in names)  # blank headers can't be checked by name
    df = reader.option("enforceSchema", not named).schema(read).csv(where)
    at = {n.strip().lower(): n for n in names if n.strip()} | {CORRUPT: CORRUPT}
    return df.select(*[(F.col(f"`{at[f.name.lower()]}`") if f.name.lower() in at else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False, errors: str = FAIL, **options) -> DataFrame:
    """lines: one record a line; otherwise each file is an array or a record. Names match without case."""
    return spark.read.schema(_schema(schema, errors)).options(multiLine=not lines, mode=_MODES[errors], columnNameOfCorruptRecord=CORRUPT, **options).json(StorageUri.parse(path).spark_path())


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None, schema: StructType | str | None = None,
    merge: bool = False, recursive: bool = True, strict: bool = False,
) -> DataFrame:
    """columns and where reach the scan. strict: fail if the files' columns differ from `schema`."""
    reader = spark.read.options(mergeSchema=merge, recursiveFileLookup=recursive)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict and wanted is not None:
        found = {f.name: f.dataType for f in reader.parquet(StorageUri.parse(path).spark_path()).schema}
        wrong = [f.name for f in wanted if found.get(f.name) != f.dataType] + [n for n in found if n not in wanted.names]
        if wrong:
            raise ValueError(f"schema mismatch in {path}: {sorted(set(wrong))}")
    df = (reader.schema(wanted) if wanted is not None else reader).parquet(StorageUri.parse(path).spark_path())
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_excel(spark: SparkSession, path: str, schema: StructType | str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """One sheet of a local workbook. Workbooks are bounded by their format (1,048,576 rows a sheet), so the driver reads them."""
    import pandas as pd

    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    frame = pd.read_excel(path, sheet_name=sheet, header=0 if header else None, names=None if header else s.names, dtype=object)
    frame = frame[[c for c in frame.columns if str(c) in s.names]] if header else frame
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema=s)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of bad ones, of a frame read with errors='quarantine'."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def rename(df: DataFrame, policy: str) -> DataFrame:
    """Column names by policy: lower, camel, snake, pascal, or as_is."""
    import re

    def words(n: str) -> list[str]:
        return [w for w in re.split(r"[_\s-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", n) if w]

    makers = {
        "lower": str.lower,
        "snake": lambda n: "_".join(w.lower() for w in words(n)),
        "camel": lambda n: "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(words(n))),
        "pascal": lambda n: "".join(w[:1].upper() + w[1:].lower() for w in words(n)),
        "as_is": lambda n: n,
    }
    return df.toDF(*[makers[policy](c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True, delimiter: str = ",", **options) -> None:
    df.write.mode(mode).options(header=header, sep=delimiter, **options).csv(StorageUri.parse(path).spark_path())


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", naming: str = "as_is", lines: bool = True, **options) -> None:
    """One record a line; with lines=False each file is one JSON array, written row by row."""
    named, where = rename(df, naming), StorageUri.parse(path).spark_path()
    if lines:
        named.write.mode(mode).options(**options).json(where)
        return
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in named.columns]), options) if options else F.to_json(F.struct(*[F.col(f"`{c}`") for c in named.columns]))
    named.select(record.alias("value")).mapInArrow(_as_array, "value string").write.mode(mode).text(where)


def _as_array(batches):
    """The records of a task with what makes them one array; each line but the first begins with a comma."""
    import pyarrow as pa
    import pyarrow.compute as pc

    began = False
    for batch in batches:
        if batch.num_rows:
            value = pc.binary_join_element_wise(pa.scalar(","), batch.column(0), "")
            if not began:
                value = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("["), batch.column(0).slice(0, 1), ""), value.slice(1)])
            began = True
            yield pa.RecordBatch.from_arrays([value], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if began else "[]"])], names=["value"])


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy", partition_by: Sequence[str] = (), max_rows_per_file: int = 0, row_group_bytes: int = 128 << 20) -> None:
    """Files appear when the job commits, all or none."""
    w = df.write.mode(mode).options(compression=compression, maxRecordsPerFile=max_rows_per_file, **{"parquet.block.size": row_group_bytes})
    (w.partitionBy(*partition_by) if partition_by else w).parquet(StorageUri.parse(path).spark_path())


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", header: bool = True, most_rows: int = 1_048_575) -> None:
    """A local workbook; more rows than a sheet holds are refused, not cut."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too many rows for one sheet")
    df.toPandas().to_excel(path, sheet_name=sheet, header=header, index=False)

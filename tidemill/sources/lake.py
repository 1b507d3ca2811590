"""Lake tables: partitioned Parquet files listed in a manifest, with snapshots and time travel.

Every append writes its files below a folder of its own and then one manifest file, so readers
see all of a snapshot or nothing of it. All access goes through Spark's file systems. The
manifest of a snapshot lists its files with row counts, sizes and partition values; compaction
adds a snapshot whose entries also name the files they replace, and reading leaves those out.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Sequence
from datetime import datetime, timezone
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
ENTRY = "path string, row_count long, written_at string, file_size_bytes long, partition_values map<string,string>, snapshot_id string, format_version int, file_format string, compression string, replaces array<string>"
SMALL_FILE, MIN_FILES, MAX_FILES = 32 << 20, 5, 100


def snake_case(name: str) -> str:
    import re

    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def partition_text(c: str, kind: str, enum: bool = False) -> Column:
    """A partition value as text: null, dates, times, lower-case enumerations, else the text itself.

    Spark escapes what a path cannot hold; the manifest has the value in URI form.
    """
    col = F.col(c)
    if kind == "date":
        text = F.date_format(col, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        text = F.date_format(col, "yyyy-MM-dd-HH-mm-ss")
    elif kind == "string":
        text = F.lower(col) if enum else col
    else:
        text = F.lower(col.cast("string"))
    return F.coalesce(text, F.lit("null"))


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str] = (), enums: Sequence[str] = ()):
        self.spark, self.path, self.partitions, self.enums = spark, path.rstrip("/"), list(partitions), set(enums)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write_text(self, path: str, text: str) -> None:
        """Under another name first, then renamed, so no reader meets half a manifest."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path
        out = fs.create(at(path + ".tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(at(path + ".tmp"), at(path)):
            fs.delete(at(path + ".tmp"), False)
            raise OSError(f"{path} could not be put in place; the snapshot is not committed")

    @staticmethod
    def new_snapshot_id(now: datetime) -> str:
        return now.strftime("%Y%m%d%H%M%S") + f"{now.microsecond // 1000:03d}-" + secrets.token_hex(4)

    def append(self, df: DataFrame, max_rows_per_file: int = 0, compression: str = "snappy", now: datetime | None = None, replaces: Sequence[str] = ()) -> str:
        """Adds the rows as one snapshot and returns its id.

        Rows are dealt by partition first, so that each goes to few files; a partition larger
        than the advisory size is written by several tasks.
        """
        now = now or datetime.now(timezone.utc)
        snapshot = self.new_snapshot_id(now)
        folder = f"{self.path}/data/{snapshot}"
        kinds = dict(df.dtypes)
        names = {c: f"p_{snake_case(c)}" for c in self.partitions}
        out = df.withColumns({n: partition_text(c, kinds[c], c in self.enums) for c, n in names.items()}) if names else df
        if names:
            out = out.hint("rebalance", *names.values())
        w = out.write.options(maxRecordsPerFile=max_rows_per_file, compression=compression)
        (w.partitionBy(*names.values()) if names else w).parquet(folder)
        kinds = {n: F.col(n).cast("string").alias(n) for n in names.values()}
        reader = self.spark.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` string" for n in names.values())]))
        files = reader.parquet(folder).select("_metadata.file_path", "_metadata.file_size", *kinds.values())
        rows = files.groupBy("file_path", "file_size", *names.values()).agg(F.count("*").alias("n")).collect()
        entries = [
            {"path": unquote(r.file_path), "row_count": r.n, "written_at": now.isoformat(timespec="microseconds"), "file_size_bytes": r.file_size, "partition_values": {snake_case(c): quote(str(r[n]), safe="") for c, n in names.items()},
             "snapshot_id": snapshot, "format_version": 1, "file_format": "parquet", "compression": compression, "replaces": list(replaces)}
            for r in sorted(rows, key=lambda r: r.file_path)
        ]
        if not entries and replaces:  # a snapshot without rows may still replace files
            entries = [{"path": "", "row_count": 0, "written_at": now.isoformat(timespec="microseconds"), "file_size_bytes": 0, "partition_values": {}, "snapshot_id": snapshot, "format_version": 1, "file_format": "parquet", "compression": compression, "replaces": list(replaces)}]
        self._write_text(f"{self.path}/{MANIFEST}/{snapshot}.ndjson", "".join(json.dumps(e) + "\n" for e in entries))
        return snapshot

    def manifest(self) -> DataFrame:
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MANIFEST}/*.ndjson"))
        files = [f.getPath().toString() for f in found or []]
        return self.spark.read.schema(ENTRY).json(files) if files else self.spark.createDataFrame([], ENTRY)

    def snapshots(self) -> list[str]:
        """Newest first."""
        return [r[0] for r in self.manifest().select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).collect()]

    def _entries(self, as_of: datetime | None = None, snapshot: str | None = None, partition: dict[str, str] | None = None) -> list:
        m = self.manifest()
        if snapshot:
            m = m.where(F.col("snapshot_id") == snapshot)
        if as_of:
            m = m.where(F.to_timestamp("written_at") <= F.lit(as_of))
        gone = m.select(F.explode("replaces").alias("path")).distinct() if not snapshot else None
        for k, v in (partition or {}).items():
            m = m.where(F.col("partition_values")[k] == v)
        live = m.where(F.col("path") != "").join(gone, "path", "left_anti") if gone is not None else m.where(F.col("path") != "")
        return live.orderBy("path").collect()

    def read(self, as_of: datetime | None = None, snapshot: str | None = None, partition: dict[str, str] | None = None, schema=None) -> DataFrame:
        """The latest state; or as of a time, cumulative; or only what one snapshot wrote.

        partition: {snake-case column: text}; files of other partitions are never opened.
        """
        return self._read([e.path for e in self._entries(as_of, snapshot, partition)], schema)

    def _read(self, paths: list[str], schema=None) -> DataFrame:
        if not paths:
            if schema is None:
                raise ValueError("no files and no schema")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*paths)

    def upsert(self, df: DataFrame, keys: Sequence[str], order: str) -> str:
        """The table with new rows winning over old ones of their key: the latest by `order`, new before old in ties.

        Only files that hold a key of the new rows are rewritten; the others are looked at by
        their key columns alone. Rows with a null key match nothing and are added.
        """
        whole = " and ".join(f"`{k}` is not null" for k in keys)
        old = [e.path for e in self._entries()]
        new = df.where(whole)
        touched: list[str] = []
        if old:
            held = self._read(old).select(*keys, F.col("_metadata.file_path").alias("_path"))
            touched = [unquote(r[0]) for r in held.join(new.select(*keys).distinct(), list(keys), "left_semi").select("_path").distinct().collect()]
        now = self._read(touched, df.schema).select(*df.columns)
        both = now.where(whole).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        best = both.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(order), F.col("_new"))).alias("r")).select("r.*")
        rest = now.unionByName(df).where(f"not ({whole})")
        return self.append(best.unionByName(rest), replaces=touched)

    def compact(self, small: int = SMALL_FILE, at_least: int = MIN_FILES, at_most: int = MAX_FILES, dry_run: bool = False) -> dict[str, int]:
        """Rewrites the small files of each partition as few; returns {partition: number of files}.

        The files replaced stay, so that earlier states can be read, until expire().
        """
        groups: dict[str, list] = {}
        for e in self._entries():
            if e.file_size_bytes < small:
                groups.setdefault(json.dumps(e.partition_values, sort_keys=True), []).append(e)
        chosen = {k: v[:at_most] for k, v in groups.items() if len(v) >= at_least}
        if not dry_run:
            for files in chosen.values():
                total = sum(e.file_size_bytes for e in files)
                merged = self._read([e.path for e in files])
                if not self.partitions:
                    merged = merged.coalesce(max(1, total // (4 * small)))
                self.append(merged, replaces=[e.path for e in files])
        return {k: len(v) for k, v in chosen.items()}

    def expire(self, before: datetime) -> int:
        """Deletes the files that snapshots written before a time have replaced; states before them can't be read any more."""
        old = self.manifest().where(F.to_timestamp("written_at") < F.lit(before)).select(F.explode("replaces").alias("path")).distinct()
        jvm, fs = self._fs()
        return sum(bool(fs.delete(jvm.org.apache.hadoop.fs.Path(r.path), False)) for r in old.toLocalIterator())

"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime re-planning, UTC, and Arrow for the few operators that need Python.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for one machine; on a cluster pass SETTINGS to the builder instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone become UTC instants, which watermarks and windows need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}) if any(t == "timestamp_ntz" for _, t in df.dtypes) else df


#: Settings for long-running bulk jobs, over SETTINGS: larger scans and shuffles per task, fewer files.
HIGH_THROUGHPUT = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.parquet.filterPushdown": "true",
}


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where all runs on one machine."""
    import tempfile

    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemill-")


def with_checkpoints(spark: SparkSession) -> None:
    """Name a checkpoint folder: spark.checkpoint.dir, or a local one in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(spark))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one in local mode."""
    import uuid

    return f"{_shared(spark)}/tidemill-{uuid.uuid4().hex}"

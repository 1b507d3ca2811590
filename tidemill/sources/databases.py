"""Databases over JDBC, document stores over their Spark connectors, and an in-process SQL file reader.

Drivers and connectors are not part of this package; these functions build checked options and
statements, which is what can be tested without a server.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, with_checkpoints
from .storage import StorageUri

#: Kind -> (JDBC address, driver class).
JDBC = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
}


@dataclass(frozen=True)
class Database:
    kind: str
    host: str
    database: str
    user: str = ""
    password: str = ""
    port: int | None = None

    def options(self) -> dict[str, str]:
        url, driver, port = JDBC[self.kind]
        out = {"url": url.format(host=self.host, port=self.port or port, database=self.database), "driver": driver}
        return out | ({"user": self.user, "password": self.password} if self.user else {})


def read_options(db: Database, query: str | None = None, table: str | None = None, fetch_size: int = 1000, split: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of a JDBC read; split: (numeric column, lowest, highest, partitions) reads in parallel."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    out = db.options() | {"fetchsize": str(fetch_size)}
    if split:
        column, low, high, n = split
        out |= {"dbtable": table or f"({query}) q", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    else:
        out |= {"query": query} if query else {"dbtable": table}
    return out


def read(spark: SparkSession, db: Database, **how) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(db, **how)).load()


def resume_query(query: str, column: str, after: object | None) -> str:
    """The query from where a checkpoint stopped, by a growing column rather than by skipping rows."""
    if after is None:
        return f"SELECT * FROM ({query}) q ORDER BY {column}"
    text = str(after) if isinstance(after, (int, float)) else "'" + str(after).replace("'", "''") + "'"
    return f"SELECT * FROM ({query}) q WHERE {column} > {text} ORDER BY {column}"


def write_options(db: Database, table: str, batch: int = 100, exactly_once: bool = False) -> dict[str, str]:
    return db.options() | {"dbtable": table, "batchsize": str(batch), "isolationLevel": "SERIALIZABLE" if exactly_once else "READ_COMMITTED"}


def write(df: DataFrame, db: Database, table: str, mode: str = "append", **how) -> None:
    df.write.format("jdbc").mode(mode).options(**write_options(db, table, **how)).save()


def _quoted(kind: str, name: str) -> str:
    a, b = {"mysql": "``", "sqlserver": "[]"}.get(kind, '""')
    return a + name.replace(b, b + b) + b


def upsert_statement(kind: str, table: str, columns: Sequence[str], keys: Sequence[str], update: bool = True) -> str:
    """One parameterised insert-or-update; update=False leaves existing rows alone."""
    q = lambda c: _quoted(kind, c)
    names, marks = ", ".join(map(q, columns)), ", ".join("?" for _ in columns)
    rest = [c for c in columns if c not in keys] if update else []
    if kind == "postgres":
        action = "DO UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest) if rest else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) VALUES ({marks}) ON CONFLICT ({', '.join(map(q, keys))}) {action}"
    if kind == "mysql":
        if not rest:
            return f"INSERT IGNORE INTO {table} ({names}) VALUES ({marks})"
        return f"INSERT INTO {table} ({names}) VALUES ({marks}) AS n ON DUPLICATE KEY UPDATE " + ", ".join(f"{q(c)} = n.{q(c)}" for c in rest)
    source = ", ".join(f"? AS {q(c)}" for c in columns)
    matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    return f"MERGE INTO {table} t USING (SELECT {source}) s ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})" + (";" if kind == "sqlserver" else "")


def upsert(df: DataFrame, connect: Callable[[], object], statement: str, batch: int = 100, on_error: Callable[[dict, str], None] | None = None) -> None:
    """Runs the statement for every row from the executors, one transaction a batch; connect: a DB-API connection factory.

    on_error: go on after errors. A batch that fails is rolled back and sent row by row, and
    each row that fails alone is handed to on_error(row, message) instead of stopping the job.
    """
    columns = df.columns

    def send(rows: Iterator) -> None:
        connection = connect()
        try:
            cursor, held = connection.cursor(), []

            def flush() -> None:
                try:
                    cursor.executemany(statement, held)
                    connection.commit()
                except Exception:  # the driver's own error classes are not known here
                    connection.rollback()
                    if on_error is None:
                        raise
                    for row in held:
                        try:
                            cursor.execute(statement, row)
                            connection.commit()
                        except Exception as e:
                            connection.rollback()
                            on_error(dict(zip(columns, row)), f"{type(e).__name__}: {e}")
                held.clear()

            for r in rows:
                held.append(tuple(r[c] for c in columns))
                if len(held) == batch:
                    flush()
            if held:
                flush()
        finally:
            connection.close()

    df.foreachPartition(send)


#: The statement that loads a file of comma-separated rows, by kind of database.
BULK_LOAD = {
    "postgres": "COPY {table} ({columns}) FROM STDIN WITH (FORMAT csv, NULL '\\N')",
    "mysql": "LOAD DATA LOCAL INFILE '{file}' INTO TABLE {table} FIELDS TERMINATED BY ',' OPTIONALLY ENCLOSED BY '\"' ESCAPED BY '' ({columns})",
    "snowflake": "PUT file://{file} @%{table}",
    "sqlserver": "BULK INSERT {table} FROM '{file}' WITH (FORMAT = 'CSV')",
}


def bulk_load(df: DataFrame, kind: str, table: str, load: Callable[[str, object], None]) -> None:
    """Each task writes its rows as one CSV file of its own and hands (statement, file object) to load(), which runs it.

    load opens the connection; it runs on the executor. Values are text as Spark casts them to
    strings, nulls are \\N; a task that is retried loads its rows again, so load into a staging
    table and merge from there where that matters.
    """
    import csv
    import tempfile

    statement, names = BULK_LOAD[kind], ", ".join(_quoted(kind, c) for c in df.columns)

    def send(rows: Iterator) -> None:
        with tempfile.NamedTemporaryFile("w+", suffix=".csv", newline="", encoding="utf-8") as f:
            out, any_row = csv.writer(f), False
            for r in rows:
                out.writerow(["\\N" if v is None else v for v in r])
                any_row = True
            f.flush()
            f.seek(0)
            if any_row:
                load(statement.format(table=table, columns=names, file=f.name), f)

    df.select(*[df[f"`{c}`"].cast("string").alias(c) for c in df.columns]).foreachPartition(send)


def read_duckdb(spark: SparkSession, query: str, database: str = ":memory:", folder: str | None = None) -> DataFrame:
    """The result of a DuckDB query. DuckDB writes it to Parquet files in `folder`, which must be shared, and Spark reads those; the driver never holds the rows.

    Without a folder: a new one below the shared folder of the session.
    """
    import duckdb

    where = folder or shared_folder(spark)
    with duckdb.connect(database, read_only=database != ":memory:") as c:
        os.makedirs(local_path(where), exist_ok=True)
        c.execute(f"COPY ({query}) TO '{local_path(where)}' (FORMAT parquet, PER_THREAD_OUTPUT true, OVERWRITE_OR_IGNORE true)")
    return spark.read.parquet(where)


def local_path(folder: str) -> str:
    """A shared folder as the driver's own file system sees it."""
    uri = StorageUri.parse(folder)
    if uri.scheme != "file":
        raise ValueError(f"DuckDB writes to file systems only, not to {folder}")
    return uri.path


def write_duckdb(df: DataFrame, database: str, table: str, folder: str, mode: str = "create") -> None:
    """Rows go to Parquet in `folder`, which DuckDB then loads: the driver never holds them."""
    import duckdb

    df.write.mode("overwrite").parquet(folder)
    verb = {"create": "CREATE TABLE", "replace": "CREATE OR REPLACE TABLE"}.get(mode)
    name = _quoted("duckdb", table)
    with duckdb.connect(database) as c:
        c.execute(f"{verb} {name} AS SELECT * FROM read_parquet(?)" if verb else f"INSERT INTO {name} SELECT * FROM read_parquet(?)", [f"{folder}/*.parquet"])


def mongo_options(uri: str, database: str, collection: str, pipeline: str | None = None, write_mode: str | None = None, keys: Sequence[str] = ()) -> dict[str, str]:
    """Options of the MongoDB Spark connector; write_mode: insert, replace or update."""
    out = {"connection.uri": uri, "database": database, "collection": collection}
    if pipeline:
        out["aggregation.pipeline"] = pipeline
    if write_mode:
        out["operationType"] = write_mode
    if keys:
        out["idFieldList"] = ",".join(keys)
    return out


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str, **how) -> DataFrame:
    """A collection, or the result of an aggregation pipeline. Needs MongoDB's Spark connector."""
    return spark.read.format("mongodb").options(**mongo_options(uri, database, collection, **how)).load()


def write_mongo(df: DataFrame, uri: str, database: str, collection: str, write_mode: str = "insert", keys: Sequence[str] = (), mode: str = "append") -> None:
    df.write.format("mongodb").mode(mode).options(**mongo_options(uri, database, collection, None, write_mode, keys)).save()


#: The Spark format of each Cosmos API.
COSMOS_FORMATS = {"sql": "cosmos.oltp", "mongo": "mongodb", "cassandra": "org.apache.spark.sql.cassandra"}


def read_cosmos(spark: SparkSession, *place: str, api: str = "sql", change_feed: bool = False, **how) -> DataFrame:
    """A container, a query over it, or its change feed. Needs the connector of the API."""
    name = "cosmos.oltp.changeFeed" if change_feed and api == "sql" else COSMOS_FORMATS[api]
    return spark.read.format(name).options(**cosmos_options(*place, api=api, change_feed=change_feed, **how)).load()


def write_cosmos(df: DataFrame, *place: str, api: str = "sql", upsert: bool = True, mode: str = "append") -> None:
    more = {"spark.cosmos.write.strategy": "ItemOverwrite" if upsert else "ItemAppend"} if api == "sql" else {}
    df.write.format(COSMOS_FORMATS[api]).mode(mode).options(**cosmos_options(*place, api=api), **more).save()


def cosmos_options(endpoint: str, key: str, database: str, container: str, change_feed: bool = False, query: str | None = None, api: str = "sql") -> dict[str, str]:
    """Options for the Cosmos DB APIs: sql (with change feed), mongo and cassandra."""
    if api == "mongo":
        return mongo_options(endpoint, database, container)
    if api == "cassandra":
        if change_feed:
            raise NotImplementedError("the Cassandra API has no change feed here")
        return {"spark.cassandra.connection.host": endpoint, "keyspace": database, "table": container}
    out = {"spark.cosmos.accountEndpoint": endpoint, "spark.cosmos.accountKey": key, "spark.cosmos.database": database, "spark.cosmos.container": container}
    if change_feed:
        out |= {"spark.cosmos.changeFeed.mode": "Incremental", "spark.cosmos.changeFeed.startFrom": "Beginning"}
    if query:
        out["spark.cosmos.read.customQuery"] = query
    return out


#: Kinds of change, as document stores name them.
INSERT, UPDATE, REPLACE, DELETE = "insert", "update", "replace", "delete"
CHANGE = "operation string, key string, document string, at long, token string"


def read_changes(spark: SparkSession, watch: Callable[[str | None], Iterator[dict]], saved, source: str, most: int | None = 10_000, held: int = 10_000) -> DataFrame:
    """Up to `most` changes after the saved resume token, as rows of CHANGE, written to the checkpoint folder.

    watch(token) is called in one task and gives dictionaries with these fields (key and document
    as JSON text), in order; a change feed is one ordered log, so one task reads it, and holds
    `held` changes at a time. most=None: all until watch() ends, for feeds that do. Save
    the last token (see last_token) with the Checkpoints `saved` once the rows are processed.
    """
    import pandas as pd

    token = saved.load(source)
    names = [c.split()[0] for c in CHANGE.split(", ")]

    def run(frames):
        for _ in frames:
            got = []
            for i, change in enumerate(watch(token)):
                got.append([change.get(n) for n in names])
                if i + 1 == most:
                    break
                if len(got) == held:
                    yield pd.DataFrame(got, columns=names)
                    got = []
            yield pd.DataFrame(got, columns=names)

    with_checkpoints(spark)
    return spark.range(1).repartition(1).mapInPandas(run, CHANGE).checkpoint()


def last_token(changes: DataFrame) -> str | None:
    return changes.agg(F.max_by("token", "at")).first()[0]


def apply_changes(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, operation: str = "operation") -> DataFrame:
    """The table after a change feed: of each key the latest change wins, by `order`, and a deleted key goes.

    changes: the columns of `current`, `operation` and `order`. One aggregate with map-side
    combining and one join; keys without changes keep their rows.
    """
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(operation, *[c for c in current.columns if c not in keys]), order).alias("_last"))
    kept = current.join(last.select(*keys), list(keys), "left_anti")
    new = last.where(F.col(f"_last.{operation}") != DELETE).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in current.columns])
    return kept.unionByName(new)

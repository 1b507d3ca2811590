"""Streams: watermarks, windowed aggregates, late rows, stateful one-to-one joins, and batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.rules import Policy, Rule, apply_rules
from ..operators.windows import interval, spark_window
from ..sources.brokers import kafka_options, kafka_sink_options

#: Fixed value: how far rows may be out of order unless said otherwise.
OUT_OF_ORDER = timedelta(minutes=5)


def read_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    """Messages of a topic; options as for sources.brokers.kafka_options(). Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**kafka_options(**options)).load()


def write_kafka(df: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Rows with key and value columns to a topic; options as for sources.brokers.kafka_sink_options()."""
    return df.writeStream.format("kafka").options(**kafka_sink_options(**options)).option("checkpointLocation", checkpoint).start()


def with_watermark(df: DataFrame, time: str, delay: timedelta = OUT_OF_ORDER) -> DataFrame:
    return df.withWatermark(time, interval(delay) if delay else "0 seconds")


def windowed_aggregate(df: DataFrame, time: str, size: timedelta, keys: Sequence[str], measures: dict[str, Column], slide: timedelta | None = None, delay: timedelta = OUT_OF_ORDER) -> DataFrame:
    """Aggregates by window and key; a window is final once the watermark passes its end, later rows are dropped."""
    w = spark_window(F.col(time), size, slide)
    out = with_watermark(df, time, delay).groupBy(w.alias("_w"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *measures)


def session_aggregate(df: DataFrame, time: str, gap: timedelta, keys: Sequence[str], measures: dict[str, Column], delay: timedelta = OUT_OF_ORDER) -> DataFrame:
    w = F.session_window(F.col(time), interval(gap))
    out = with_watermark(df, time, delay).groupBy(w.alias("_w"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *measures)


def drop_late(df: DataFrame, time: str, key: str, delay: timedelta = OUT_OF_ORDER) -> DataFrame:
    """Leaves out rows below their key's watermark: the greatest time seen before, less the delay. Rows at it stay.

    State is one number for each key.
    """
    us = delay // timedelta(microseconds=1)
    schema = df.schema

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("_arrival", kind="stable") if "_arrival" in frame else frame
            times = frame[time].astype("datetime64[us]").astype("int64")
            before = times.cummax().shift(1)
            if top is not None:
                before = before.fillna(top).clip(lower=top)
            yield frame[before.isna() | (times >= before - us)]
            if len(times):
                top = int(max(times.max(), top if top is not None else times.max()))
        if top is not None:
            state.update((top,))

    return df.groupBy(key).applyInPandasWithState(run, schema, "top long", "append", GroupStateTimeout.NoTimeout)


def keyed_join(df: DataFrame, key: str, left_columns: Sequence[str], right_columns: Sequence[str], side: str = "side", expire: timedelta | None = None) -> DataFrame:
    """The one-to-one inner join over a merged stream whose `side` column says left or right.

    Per key at most one row waits, of either side; a row of the other side takes it and both
    are gone; a second waiting row of the same side is dropped. Output: key, left columns,
    right columns. The waiting row is kept as an Arrow record, so every column keeps its type.
    expire: a row that waits longer (by the clock) is forgotten, which bounds the state. Such a
    stream goes on to look after its clocks, so it is for streams that run until they are
    stopped, not for write_batches(once=True).
    """
    kinds = dict(zip(df.columns, df.schema.fields))
    fields = [kinds[key], *[kinds[c] for c in left_columns], *[kinds[c] for c in right_columns]]

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = _thawed(state.get[0]) if state.exists else None
        for frame in frames:
            rows = frame.reset_index(drop=True) if held is None else pd.concat([held, frame], ignore_index=True)
            sides, waiting, pairs = rows[side].tolist(), None, []
            for i, s in enumerate(sides):
                if waiting is None:
                    waiting = i
                elif s != sides[waiting]:
                    pairs.append((waiting, i) if s == "right" else (i, waiting))
                    waiting = None
            held = rows.iloc[[waiting]] if waiting is not None else None
            if pairs:
                left, right = ([p[i] for p in pairs] for i in (0, 1))
                taken = [(left, key), *((left, c) for c in left_columns), *((right, c) for c in right_columns)]
                yield pd.concat([rows[c].iloc[i].reset_index(drop=True) for i, c in taken], axis=1, keys=[f.name for f in fields])
        if held is not None:
            state.update((_frozen(held),))
            if expire:
                state.setTimeoutDuration(expire // timedelta(milliseconds=1))
        elif state.exists:
            state.remove()

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, StructType(fields), "waiting binary", "append", timeout)


def _frozen(rows: pd.DataFrame) -> bytes:
    import pyarrow as pa

    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _thawed(data: bytes) -> pd.DataFrame:
    import pyarrow as pa

    with pa.ipc.open_stream(pa.py_buffer(bytes(data))) as r:
        return r.read_all().to_pandas()


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str | None = None, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Starts the stream into a batch function. once: all that is there, then stop."""
    w = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every or "0 seconds")).start()


def write_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly once, by the file sink's log."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)


def idempotent(write: Callable[[DataFrame], None], done: Callable[[int], bool], mark: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that skips batches already marked as done, so retries do not write twice."""

    def run(df: DataFrame, batch_id: int) -> None:
        if not done(batch_id):
            write(df)
            mark(batch_id)

    return run


def with_watermark_known(handle: Callable[[DataFrame, int, datetime | None], None], time: str, delay: timedelta = OUT_OF_ORDER, top: datetime | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that hands each batch on with the watermark at its beginning: the greatest time of all batches before, less the delay.

    It never goes back. top: the greatest time known from an earlier run (None: none yet).
    """
    held = [top]

    def run(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            handle(df, batch_id, held[0] - delay if held[0] is not None else None)
            last = df.agg(F.max(time)).first()[0]
            if last is not None and (held[0] is None or last > held[0]):
                held[0] = last
        finally:
            df.unpersist()

    return run


def with_dead_letters(rules: Sequence[Rule], policy: Policy, good: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that applies rules and sends both outcomes on; the batch is read once."""

    def run(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            kept, letters = apply_rules(df, rules, policy)
            good(kept, batch_id)
            dead(letters, batch_id)
        finally:
            df.unpersist()

    return run

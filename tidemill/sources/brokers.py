"""Message brokers: checked options for Spark's sources, and idempotent sinks for the rest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_checkpoints

AT_LEAST_ONCE, AT_MOST_ONCE, EXACTLY_ONCE = "at_least_once", "at_most_once", "exactly_once"
#: When a source may forget a message.
ACK_ON_SINK_SUCCESS, ACK_MANUAL, ACK_DELAYED, ACK_NONE = "auto_on_sink_success", "manual", "delayed", "none"


def kafka_options(servers: str, topic: str | None = None, pattern: str | None = None, start: str = "latest", group: str | None = None, max_per_trigger: int | None = None, fail_on_loss: bool = True) -> dict[str, str]:
    if (topic is None) == (pattern is None):
        raise ValueError("give a topic or a pattern")
    out = {"kafka.bootstrap.servers": servers, "startingOffsets": start, "failOnDataLoss": str(fail_on_loss).lower()}
    out |= {"subscribe": topic} if topic else {"subscribePattern": pattern}
    if group:
        out["kafka.group.id"] = group
    if max_per_trigger:
        out["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return out


def kafka_sink_options(servers: str, topic: str, delivery: str = AT_LEAST_ONCE) -> dict[str, str]:
    """Spark's Kafka sink repeats messages after failures; consumers drop repeats by key when asked for exactly-once."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "0" if delivery == AT_MOST_ONCE else "all", "kafka.enable.idempotence": str(delivery == EXACTLY_ONCE).lower()}


def decode_json(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Messages as columns; what does not parse has a null in `parsed` and stays for dead letters."""
    return df.withColumn("parsed", F.from_json(F.col(column).cast("string"), schema))


def encode_json(df: DataFrame, key: str | None = None) -> DataFrame:
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def decode(df: DataFrame, kind: str, schema: str, column: str = "value", message: str | None = None) -> DataFrame:
    """Messages as columns, by kind: json (schema as DDL), avro (schema as JSON), protobuf (schema: path of a descriptor file, message: its name).

    What does not parse has a null in `parsed`. Avro and Protobuf need Spark's packages of those names.
    """
    if kind == "json":
        return decode_json(df, schema, column)
    if kind == "avro":
        from pyspark.sql.avro.functions import from_avro

        return df.withColumn("parsed", from_avro(F.col(column), schema, {"mode": "PERMISSIVE"}))
    if kind == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        return df.withColumn("parsed", from_protobuf(F.col(column), message, schema, {"mode": "PERMISSIVE"}))
    raise ValueError(f"unknown format {kind}")


def encode(df: DataFrame, kind: str, key: str | None = None, schema: str | None = None, message: str | None = None) -> DataFrame:
    """Rows as messages with a value, and a key column if one is named; kinds as for decode()."""
    if kind == "json":
        return encode_json(df, key)
    row = F.struct(*df.columns)
    if kind == "avro":
        from pyspark.sql.avro.functions import to_avro

        value = to_avro(row, schema) if schema else to_avro(row)
    elif kind == "protobuf":
        from pyspark.sql.protobuf.functions import to_protobuf

        value = to_protobuf(row, message, schema)
    else:
        raise ValueError(f"unknown format {kind}")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value.alias("value"))


def queue_sink(publish: Callable[[], Callable[[list[dict]], None]], batch: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for queues without a Spark connector.

    publish: makes a sender on the executor; it gets lists of messages. Each message carries
    message_id, made of its content, so a broker or consumer can drop the repeats that a
    retried batch sends.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        body = F.to_json(F.struct(*df.columns))
        out = df.select(body.alias("body"), F.sha2(body, 256).alias("message_id"))

        def send(rows: Iterator) -> None:
            sender, held = publish(), []
            for r in rows:
                held.append({"body": r.body, "message_id": r.message_id, "batch_id": batch_id})
                if len(held) == batch:
                    sender(held)
                    held = []
            if held:
                sender(held)

        out.foreachPartition(send)

    return write


def rabbitmq_options(host: str, queue: str, exchange: str = "", routing_key: str | None = None, confirm: bool = True, prefetch: int = 100) -> dict:
    return {"host": host, "queue": queue, "exchange": exchange, "routing_key": routing_key or queue, "publisher_confirms": confirm, "prefetch": prefetch}


def sqs_options(url: str, region: str, wait_s: int = 20, batch: int = 10, visibility_s: int = 30, ack: str = ACK_ON_SINK_SUCCESS) -> dict:
    if not 1 <= batch <= 10:
        raise ValueError("a batch holds 1 to 10 messages")
    if not 0 <= wait_s <= 20:
        raise ValueError("the wait is 0 to 20 seconds")
    return {"queue_url": url, "region": region, "wait_seconds": wait_s, "batch_size": batch, "visibility_seconds": visibility_s, "ack": ack}


def service_bus_options(namespace: str, queue: str | None = None, topic: str | None = None, subscription: str | None = None, sessions: bool = False) -> dict:
    if (queue is None) == (topic is None):
        raise ValueError("give a queue or a topic")
    return {"namespace": namespace, "entity": queue or (f"{topic}/subscriptions/{subscription}" if subscription else topic), "sessions": sessions}


# --- queues that are read -----------------------------------------------------------------------------

MESSAGE = "consumer int, place long, message_id string, body string, receipt string, session string, sequence long"


class SqsQueue:
    """A queue behind a client with the calls of the SQS API."""

    def __init__(self, client, url: str, wait_s: int = 20, visibility_s: int = 30):
        self.client, self.url, self.wait_s, self.visibility_s = client, url, wait_s, visibility_s

    def receive(self, n: int) -> list[dict]:
        got = self.client.receive_message(QueueUrl=self.url, MaxNumberOfMessages=min(n, 10), WaitTimeSeconds=self.wait_s, VisibilityTimeout=self.visibility_s, AttributeNames=["All"])
        out = []
        for m in got.get("Messages", []):
            more = m.get("Attributes", {})
            out.append({"message_id": m["MessageId"], "body": m["Body"], "receipt": m["ReceiptHandle"], "session": more.get("MessageGroupId"), "sequence": more.get("SequenceNumber")})
        return out

    def ack(self, receipts: list[str]) -> None:
        for at in range(0, len(receipts), 10):
            self.client.delete_message_batch(QueueUrl=self.url, Entries=[{"Id": str(i), "ReceiptHandle": r} for i, r in enumerate(receipts[at : at + 10])])


class RabbitQueue:
    """A queue behind a channel with the calls of an AMQP client. Delivery tags belong to the channel, so messages are acknowledged by whom they were received."""

    def __init__(self, channel, queue: str):
        self.channel, self.queue = channel, queue

    def receive(self, n: int) -> list[dict]:
        out = []
        for _ in range(n):
            method, properties, body = self.channel.basic_get(self.queue)
            if method is None:
                break
            out.append({"message_id": getattr(properties, "message_id", None), "body": body.decode(), "receipt": str(method.delivery_tag), "session": None, "sequence": method.delivery_tag})
        return out

    def ack(self, receipts: list[str]) -> None:
        for r in receipts:
            self.channel.basic_ack(int(r))


class ServiceBusQueue:
    """A queue or subscription behind a receiver with the calls of the Service Bus client; a session receiver gives the messages of one session in order."""

    def __init__(self, receiver, wait_s: float = 5):
        self.receiver, self.wait_s, self.held = receiver, wait_s, {}

    def receive(self, n: int) -> list[dict]:
        got = self.receiver.receive_messages(max_message_count=n, max_wait_time=self.wait_s)
        self.held |= {str(m.lock_token): m for m in got}
        return [{"message_id": m.message_id, "body": str(m), "receipt": str(m.lock_token), "session": m.session_id, "sequence": m.sequence_number} for m in got]

    def ack(self, receipts: list[str]) -> None:
        for r in receipts:
            self.receiver.complete_message(self.held.pop(r))


def receive(spark: SparkSession, connect: Callable[[int], object], consumers: int = 1, most: int = 1000, at_once: int = 10, ack: bool = False) -> DataFrame:
    """Up to `most` messages for each of some competing consumers, as rows of MESSAGE, written to the checkpoint folder.

    connect(i) makes consumer i's queue on the executor: an object with receive(n) and
    ack(receipts), such as the ones above. The rows of a session are in order of `sequence`.
    ack: acknowledge at once, before anything is processed (at most once).
    """
    names = [c.split()[0] for c in MESSAGE.split(", ")]

    def run(frames):
        for frame in frames:
            for i in frame["id"]:
                queue, rows = connect(int(i)), []
                while len(rows) < most and (got := queue.receive(min(at_once, most - len(rows)))):
                    rows += [[int(i), len(rows) + k, *[m.get(n) for n in names[2:5]], m.get("session"), int(m["sequence"]) if m.get("sequence") is not None else None] for k, m in enumerate(got)]
                    if ack:
                        queue.ack([m["receipt"] for m in got])
                made = pd.DataFrame(rows, columns=names, dtype=object)
                yield made.sort_values(["session", "sequence", "place"], na_position="first") if made["session"].notna().any() else made

    with_checkpoints(spark)
    return spark.range(consumers).repartition(consumers, "id").mapInPandas(run, MESSAGE).checkpoint()


def process(spark: SparkSession, connect: Callable[[int], object], write: Callable[[DataFrame], object], ack: str = ACK_ON_SINK_SUCCESS, consumers: int = 1, most: int = 1000, delay_s: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Reads a round of messages (see receive(); drain() empties a queue), writes them, and acknowledges by strategy.

    auto_on_sink_success: after write() has returned, so a failed round is delivered again (at
    least once). delayed: the same, `delay_s` later. none: on receipt (at most once). manual:
    never here; hand the rows returned to acknowledge(). Repeats can be told by message_id.
    """
    if ack not in (ACK_ON_SINK_SUCCESS, ACK_MANUAL, ACK_DELAYED, ACK_NONE):
        raise ValueError(f"unknown acknowledgement strategy {ack}")
    rows = receive(spark, connect, consumers, most, ack=ack == ACK_NONE)
    write(rows)
    if ack in (ACK_ON_SINK_SUCCESS, ACK_DELAYED):
        if ack == ACK_DELAYED:
            sleep(delay_s)
        acknowledge(rows, connect)
    return rows


def drain(spark: SparkSession, connect: Callable[[int], object], write: Callable[[DataFrame], object], ack: str = ACK_ON_SINK_SUCCESS, consumers: int = 1, most: int = 1000, delay_s: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Rounds of process() until one finds no message; returns how many messages were written.

    write() gets the rows of each round, and those of the last, which are none. A round holds at
    most `most` messages for a consumer, however many the queue has. Messages that stay in the
    queue would come again, so they can't be acknowledged by hand.
    """
    if ack == ACK_MANUAL:
        raise ValueError("a queue isn't emptied without acknowledgements")
    n = 0
    while got := process(spark, connect, write, ack, consumers, most, delay_s, sleep).count():
        n += got
    return n


def acknowledge(rows: DataFrame, connect: Callable[[int], object], batch: int = 100) -> None:
    """Tells the queues that messages are done; consumers are called under the numbers that received them."""

    def send(part: Iterator) -> None:
        held: dict[int, list[str]] = {}
        for r in part:
            mine = held.setdefault(r.consumer, [])
            mine.append(r.receipt)
            if len(mine) == batch:
                connect(r.consumer).ack(mine)
                held[r.consumer] = []
        for i, receipts in held.items():
            if receipts:
                connect(i).ack(receipts)

    rows.select("consumer", "receipt").foreachPartition(send)

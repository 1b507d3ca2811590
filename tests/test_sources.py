import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemill import queries
from tidemill.operators import rules
from tidemill.sources import brokers, checkpoints, databases, files, http
from tidemill.sources.lake import LakeTable
from tidemill.sources.storage import StorageUri
from tidemill.streaming import streams


def test_storage():
    u = StorageUri.parse("s3://bucket/a%20b?region=eu")
    assert (u.spark_path(), u.options) == ("s3a://bucket/a b", {"region": "eu"})
    assert StorageUri.parse("/x/y").spark_path() == "file:///x/y"
    assert StorageUri.parse("sftp://u@h/x").spark_path() == "sftp://u@h/x"
    with pytest.raises(ValueError):
        StorageUri.parse("ftp://h/x").spark_path()


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("NAME, ,id\nann,zz,1\nbob,zz,x\n")
    good, bad = files.quarantine(files.read_csv(spark, str(p), "id int, name string", errors=files.QUARANTINE).cache())
    assert [(r.id, r.name) for r in good.collect()] == [(1, "ann")] and bad.count() == 1
    assert files.read_csv(spark, str(p), "id string, name string").columns == ["id", "name"]
    j = tmp_path / "a.json"
    j.write_text('[{"id": 1},\n {"id": 2}]')
    assert files.read_json(spark, str(j), "id int").count() == 2
    df = spark.createDataFrame([(1, "x")], "orderId int, itemName string")
    files.write_json(df, str(tmp_path / "out"), naming="snake")
    assert spark.read.json(str(tmp_path / "out")).columns == ["item_name", "order_id"]
    files.write_parquet(df, str(tmp_path / "pq"))
    assert files.read_parquet(spark, str(tmp_path / "pq"), ["orderId"], F.col("itemName") == "x").first()[0] == 1
    with pytest.raises(ValueError):
        files.read_parquet(spark, str(tmp_path / "pq"), schema="orderId long, itemName string", strict=True)
    assert files.rename(df, "pascal").columns == ["OrderId", "ItemName"]


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), "x int, y int").collect()
    (tmp_path / "b.csv").write_text("x,y\n10,20\n")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path), "Y int, x int").collect())) == [(2, 1), (20, 10)]


def test_json_arrays(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, None if i == 2 else f'a "{i}",\n') for i in range(5)], "id int, name string").coalesce(2)
    files.write_json(df, str(tmp_path / "out"), lines=False)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(x["id"] for p in parts for x in p) == list(range(5)) and all(isinstance(p, list) for p in parts)
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "out"), "id int, name string").collect())) == sorted(map(tuple, df.collect()))
    files.write_json(df.limit(0), str(tmp_path / "none"), lines=False)
    assert files.read_json(spark, str(tmp_path / "none"), "id int").count() == 0


def test_lake(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "lake"), ["Region"])
    rows = lambda a, b: spark.createDataFrame([(i, "EU west" if i % 2 else None) for i in range(a, b)], "id long, Region string")
    now = datetime.now(timezone.utc)
    s1 = t.append(rows(0, 2), now=now - timedelta(hours=2))
    s2 = t.append(rows(2, 5), now=now - timedelta(hours=1))
    assert t.read().count() == 5 and t.snapshots() == [s2, s1]
    assert t.read(snapshot=s2).count() == 3 and t.read(as_of=now - timedelta(minutes=90)).count() == 2
    assert t.read(partition={"region": "EU%20west"}).count() == 2
    assert any("p_region=EU west" in e.path for e in t._entries())
    assert len(t.compact(at_least=2, dry_run=True)) == 2
    t.compact(at_least=2)
    assert t.read(as_of=now - timedelta(minutes=30)).count() == 5  # the state before the compaction
    assert sorted(r.id for r in t.read().select("id").collect()) == [0, 1, 2, 3, 4]
    t.upsert(spark.createDataFrame([(1, "new"), (9, "new")], "id long, Region string"), ["id"], "id")
    got = {r.id: r.Region for r in t.read().collect()}
    assert got[1] == "new" and got[9] == "new" and len(got) == 6
    kept = {e.path for e in t._entries()}
    t.upsert(spark.createDataFrame([(9, "newer"), (None, "no key"), (None, "no key")], "id long, Region string"), ["id"], "id")
    assert len(kept - {e.path for e in t._entries()}) == 1  # only the file with key 9 was written again
    assert sorted(((r.id, r.Region) for r in t.read().collect() if r.id in (None, 9)), key=str) == [(9, "newer"), (None, "no key"), (None, "no key")]
    assert t.expire(datetime.now(timezone.utc) + timedelta(hours=1)) >= 3 and t.read().count() == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        t.read(as_of=now - timedelta(minutes=30)).count()


def test_a_manifest_that_is_not_put_in_place_is_an_error(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "lake"))
    os.makedirs(tmp_path / "lake" / "_manifest")
    target = tmp_path / "lake" / "_manifest" / "x.ndjson"
    os.makedirs(target / "in the way")
    with pytest.raises(Exception):
        t._write_text(str(target), "text")
        assert target.is_file()


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "lake"), ["p"])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t.append(spark.range(0, 200_000, 1, 4).select(F.lit("hot").alias("p"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("x")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(t._entries()) > 1 and t.read().count() == 200_000


def test_upsert_goes_on_after_errors(spark, tmp_path):
    import sqlite3

    at = str(tmp_path / "own.db")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL)")
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "a int, b string").coalesce(1)
    statement = databases.upsert_statement("postgres", "t", ["a", "b"], ["a"])
    with pytest.raises(Exception, match="NOT NULL"):
        databases.upsert(df, lambda: sqlite3.connect(at), statement)
    failed = spark.sparkContext.accumulator(0)
    databases.upsert(df, lambda: sqlite3.connect(at), statement, on_error=lambda row, message: failed.add(row["a"]))
    with sqlite3.connect(at) as c:
        assert c.execute("SELECT a FROM t ORDER BY a").fetchall() == [(1,), (3,)] and failed.value == 2


def test_bulk_load(spark, tmp_path):
    at = str(tmp_path)

    def load(statement, file):
        with open(f"{at}/{os.path.basename(file.name)}.loaded", "w") as f:
            f.write(statement + "\n" + file.read())

    databases.bulk_load(spark.createDataFrame([(1, 'a "q", b'), (2, None)], "a int, b string").coalesce(1), "postgres", "t", load)
    (done,) = tmp_path.glob("*.loaded")
    assert done.read_text() == 'COPY t ("a", "b") FROM STDIN WITH (FORMAT csv, NULL \'\\N\')\n1,"a ""q"", b"\n2,\\N\n'


def test_changes(spark, tmp_path):
    log = [("insert", 1, "a"), ("update", 1, "b"), ("insert", 2, "c"), ("delete", 2, None), ("insert", 3, "d")]
    feed = [{"operation": o, "key": str(k), "document": v, "at": i, "token": str(i)} for i, (o, k, v) in enumerate(log)]
    saved = checkpoints.Checkpoints(spark, str(tmp_path), checkpoints.CDC)
    watch = lambda token: iter(feed[int(token) + 1 if token else 0 :])
    first = databases.read_changes(spark, watch, saved, "s", 2)
    assert databases.last_token(first) == "1"
    saved.save("s", databases.last_token(first))
    rest = databases.read_changes(spark, watch, saved, "s")
    table = spark.createDataFrame([("1", "old"), ("2", "old"), ("9", "old")], "key string, document string")
    for changes in (first, rest):
        table = databases.apply_changes(table, changes.select("key", "document", "operation", "at"), ["key"], "at")
    assert sorted(map(tuple, table.collect())) == [("1", "b"), ("3", "d"), ("9", "old")]


def test_changes_to_the_end(spark, tmp_path):
    feed = [{"operation": "insert", "key": str(i), "document": "x", "at": i, "token": str(i)} for i in range(25)]
    saved = checkpoints.Checkpoints(spark, str(tmp_path), checkpoints.CDC)
    watch = lambda token: iter(feed[int(token) + 1 if token else 0 :])
    for most, n in ((None, 25), (20, 20), (3, 3)):
        changes = databases.read_changes(spark, watch, saved, "s", most, held=10)
        assert sorted(r["at"] for r in changes.collect()) == list(range(n)) and databases.last_token(changes) == str(n - 1)
    saved.save("s", "24")
    assert databases.last_token(databases.read_changes(spark, watch, saved, "s", None)) is None


@pytest.mark.parametrize("n", [0, 3, 600])
def test_change_feed_rounds_do_not_grow(spark, tmp_path, monkeypatch, n):
    read, rounds = databases.read_changes, []
    monkeypatch.setattr(databases, "read_changes", lambda *args: rounds.append(args) or read(*args))
    spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") / 4).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = sorted(map(tuple, queries.QUERIES["change_feed"](spark, str(tmp_path)).collect()))
    assert rows == [(k, 0.0 if k % 5 == 0 else k / 4) for k in range(n) if k % 3] + [(k + 1_000_000, 1.0) for k in range(n) if k % 4 == 0]
    assert len(rounds) <= 2


def test_pages_to_the_last(spark, tmp_path):
    n = 1_500
    page = lambda token: ([{"id": int(token or 0)}], str(int(token or 0) + 1) if int(token or 0) + 1 < n else None)
    saved = checkpoints.Checkpoints(spark, str(tmp_path), checkpoints.CURSOR)
    some, token = checkpoints.read_pages(spark, page, "id long", saved, "s", most=2)
    assert sorted(r.id for r in some.collect()) == [0, 1] and token == "2"
    saved.save("s", token)
    for held in (10_000, 400):
        rest, token = checkpoints.read_pages(spark, page, "id long", saved, "s", held=held)
        assert sorted(r.id for r in rest.collect()) == list(range(2, n)) and token == str(n - 1)
    with pytest.raises(ValueError):
        checkpoints.read_pages(spark, lambda token: ([], "same"), "id long", saved, "t")


@pytest.mark.parametrize("n", [0, 5, 7, 8, 7_100])
def test_cursor_pages_gives_every_row(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted(r.id for r in queries.QUERIES["cursor_pages"](spark, str(tmp_path)).collect()) == list(range(n))


def shelf(at):
    """A queue for tests: files in a folder; those received are not given again by this object."""

    class Shelf:
        def __init__(self):
            self.given = set()

        def receive(self, n):
            names = sorted(set(os.listdir(at)) - self.given)[:n]
            self.given |= set(names)
            return [{"message_id": x, "body": x.upper(), "receipt": x, "session": x[0], "sequence": -int(x[1:])} for x in names]

        def ack(self, receipts):
            for r in receipts:
                os.remove(f"{at}/{r}")

    return lambda i: Shelf()


def test_queues(spark, tmp_path):
    def fill():
        for x in ("a1", "a2", "b1", "b2", "b3"):
            (tmp_path / x).write_text("")

    at = str(tmp_path)
    connect = shelf(at)
    fill()
    rows = brokers.process(spark, connect, lambda df: df.count(), brokers.ACK_MANUAL)
    assert [r.message_id for r in rows.collect()] == ["a2", "a1", "b3", "b2", "b1"]  # each session by its own order
    assert len(os.listdir(at)) == 5
    brokers.acknowledge(rows, connect)
    assert os.listdir(at) == []
    fill()
    with pytest.raises(ZeroDivisionError):
        brokers.process(spark, connect, lambda df: 1 / 0)
    assert len(os.listdir(at)) == 5  # delivered again
    with pytest.raises(ZeroDivisionError):
        brokers.process(spark, connect, lambda df: 1 / 0, brokers.ACK_NONE)
    assert os.listdir(at) == []  # at most once
    fill()
    waits = []
    brokers.process(spark, connect, lambda df: None, brokers.ACK_DELAYED, delay_s=5, sleep=waits.append, most=2)
    assert waits == [5] and sorted(os.listdir(at)) == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        brokers.process(spark, connect, print, "sometimes")


def test_a_queue_is_emptied(spark, tmp_path):
    at, got = tmp_path / "q", []
    at.mkdir()
    for i in range(7):
        (at / f"a{i}").write_text("")
    assert brokers.drain(spark, shelf(str(at)), lambda df: got.append([r.message_id for r in df.collect()]), most=3) == 7
    assert os.listdir(at) == [] and [len(x) for x in got] == [3, 3, 1, 0] and len(set(sum(got, []))) == 7
    with pytest.raises(ValueError):
        brokers.drain(spark, shelf(str(at)), print, brokers.ACK_MANUAL)


@pytest.mark.parametrize("n", [0, 3_100])
def test_queue_messages_gives_every_row(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = queries.QUERIES["queue_messages"](spark, str(tmp_path)).collect()
    assert sorted((int(r.body), r.consumer) for r in rows) == [(i, i % 3) for i in range(n)]


def test_queue_clients():
    class Sqs:
        def receive_message(self, **how):
            assert how["MaxNumberOfMessages"] == 10
            return {"Messages": [{"MessageId": "m", "Body": "b", "ReceiptHandle": "r", "Attributes": {"MessageGroupId": "g", "SequenceNumber": "7"}}]}

        def delete_message_batch(self, **how):
            self.gone = [len(how["Entries"]), *getattr(self, "gone", [])]

    client = Sqs()
    q = brokers.SqsQueue(client, "u")
    assert q.receive(50) == [{"message_id": "m", "body": "b", "receipt": "r", "session": "g", "sequence": "7"}]
    q.ack(["r"] * 13)
    assert client.gone == [3, 10]


def test_kafka_formats(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert brokers.decode(brokers.encode(df, "json", "a"), "json", "a int, b string").select("parsed.b").first()[0] == "x"
    with pytest.raises(ValueError):
        brokers.decode(df, "xml", "")


def test_checkpoint_flushing(spark, tmp_path):
    now = [0.0]
    c = checkpoints.Checkpoints(spark, str(tmp_path), every_rows=10, every_s=60, clock=lambda: now[0])
    assert [c.note("s", i, 4) for i in range(3)] == [False, False, True] and c.load("s") == 2
    assert not c.note("s", 9, 1)
    now[0] = 100
    assert c.note("s", 10, 1) and c.load("s") == 10
    c.note("s", 11, 1)
    c.flush()
    assert c.load("s") == 11
    with pytest.raises(ValueError):
        checkpoints.Checkpoints(spark, str(tmp_path), "sometimes")


def test_http_auth_and_retries():
    seen, waits = [], []

    def fetch(url, params, headers):
        seen.append((params, headers))
        return (429, {"Retry-After": "2"}, None) if len(seen) == 1 else (503, {}, None) if len(seen) == 2 else (200, {}, [1])

    tokens = iter("abc")
    got = list(http.pages(fetch, "u", auth=http.bearer(lambda: next(tokens)), backoff=lambda n: n / 2, sleep=waits.append))
    assert got == [[1]] and waits == [2.0, 1.0] and [h["Authorization"] for _, h in seen] == ["Bearer a", "Bearer b", "Bearer c"]
    assert http.basic("u", "p")() == ({"Authorization": "Basic dTpw"}, {}) and http.api_key("k", "v", True)() == ({}, {"k": "v"})
    with pytest.raises(OSError, match="401"):
        http.request(lambda *a: (401, {}, None), "u", {}, {}, sleep=waits.append)


def test_shared_folders_on_a_cluster(spark, monkeypatch):
    from tidemill import session

    class Cluster:
        class sparkContext:
            master = "spark://h:7077"

            @staticmethod
            def getConf():
                return {}

            @staticmethod
            def getCheckpointDir():
                return None

            @staticmethod
            def setCheckpointDir(folder):
                raise AssertionError(folder)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    for f in (session.shared_folder, session.with_checkpoints):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            f(Cluster)


def test_a_waiting_row_keeps_its_types(spark, tmp_path):
    from decimal import Decimal

    schema = "k int, side string, s string, t timestamp, d decimal(10,2), b binary, l array<int>, r string"
    left = (1, "left", "007", datetime(2024, 2, 3, 4, 5, 6, 789), Decimal("1.50"), bytearray(b"\x00\xff"), [1, 2], None)
    for rows in ([left, (2, "left", "1e5", None, None, None, None, None)], [(1, "right", None, None, None, None, None, "x"), (2, "right", None, None, None, None, None, "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.keyed_join(streams.read_files(spark, str(tmp_path / "in"), schema, max_files=1), "k", ["s", "t", "d", "b", "l"], ["r"])
    found = []
    streams.write_batches(out, lambda b, i: found.extend(b.collect()), str(tmp_path / "c")).awaitTermination()
    got = {r.k: r for r in found}
    assert (got[1].s, got[1].t, got[1].d, bytes(got[1].b), got[1].l, got[1].r) == ("007", left[3], left[4], b"\x00\xff", [1, 2], "x")
    assert (got[2].s, got[2].t, got[2].r) == ("1e5", None, "y")


def test_databases(spark, tmp_path):
    db = databases.Database("postgres", "h", "d", "u", "p")
    assert databases.read_options(db, table="t", split=("id", 0, 10, 4))["numPartitions"] == "4"
    with pytest.raises(ValueError):
        databases.read_options(db)
    assert databases.upsert_statement("postgres", "t", ["a", "b"], ["a"]) == 'INSERT INTO t ("a", "b") VALUES (?, ?) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    assert databases.upsert_statement("mysql", "t", ["a"], ["a"], update=False).startswith("INSERT IGNORE")
    assert databases.upsert_statement("sqlserver", "t", ["a", "b"], ["a"]).startswith("MERGE INTO t")
    assert databases.resume_query("select 1 a", "a", 5).endswith("WHERE a > 5 ORDER BY a")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    databases.write_duckdb(df, str(tmp_path / "d.db"), "t", str(tmp_path / "out"))
    assert sorted(r.a for r in databases.read_duckdb(spark, "select * from t", str(tmp_path / "d.db")).collect()) == [1, 2]
    assert "spark.cosmos.changeFeed.mode" in databases.cosmos_options("e", "k", "d", "c", change_feed=True)
    with pytest.raises(NotImplementedError):
        databases.cosmos_options("e", "k", "d", "c", change_feed=True, api="cassandra")


def test_brokers(spark):
    assert brokers.kafka_options("s", "t", max_per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    with pytest.raises(ValueError):
        brokers.kafka_options("s")
    with pytest.raises(ValueError):
        brokers.sqs_options("u", "r", batch=11)
    assert brokers.service_bus_options("n", topic="t", subscription="s")["entity"] == "t/subscriptions/s"
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert brokers.decode_json(brokers.encode_json(df, "a"), "a int, b string").select("parsed.b").first()[0] == "x"
    brokers.queue_sink(lambda: lambda rows: None)(df, 0)


def test_http(spark):
    def fetch(url, params, headers):
        if params.get("cursor"):
            return 200, {}, {"data": {"items": [{"id": 3}]}}
        return 200, {}, {"data": {"items": [{"id": 1}, {"id": 2}]}, "next_cursor": "x"}

    assert [len(p) for p in http.pages(fetch, "u", "cursor", "data.items")] == [2, 1]
    offset = lambda url, params, headers: (200, {}, [{"id": i} for i in range(params["offset"], min(5, params["offset"] + params["limit"]))])
    assert [len(p) for p in http.pages(offset, "u", "offset", size=2)] == [2, 2, 1]
    link = lambda url, params, headers: (200, {"Link": '<v>; rel="next"'} if url == "u" else {}, [1])
    assert len(list(http.pages(link, "u", "link"))) == 2
    with pytest.raises(OSError):
        list(http.pages(lambda *a: (404, {}, None), "u"))
    assert sorted(r.id for r in http.read_http(spark, fetch, ["u"], "id int", paging="cursor", path="data.items").collect()) == [1, 2, 3]


def test_checkpoints(spark, tmp_path):
    c = checkpoints.Checkpoints(spark, str(tmp_path))
    df = spark.range(5).toDF("i")
    new, top = checkpoints.read_new(df, "i", c, "src")
    assert new.count() == 5
    c.save("src", top)
    new, top = checkpoints.read_new(spark.range(8).toDF("i"), "i", c, "src")
    assert new.count() == 3 and top == "7"


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 10, 0), 1.0), (1, datetime(2024, 1, 1, 10, 20), 2.0), (2, datetime(2024, 1, 1, 11, 0), 3.0)]
    df = spark.createDataFrame(rows, "k int, t timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: streams.read_files(spark, str(tmp_path / "in"), df.schema)
    out = streams.windowed_aggregate(read(), "t", timedelta(hours=1), ["k"], {"n": F.count("*")}, delay=timedelta(0))
    found = []
    streams.write_batches(out, lambda b, i: found.extend(b.collect()), str(tmp_path / "c1"), mode="complete").awaitTermination()
    assert {(r.k, r.window_start.hour, r.n) for r in found} == {(1, 10, 2), (2, 11, 1)}
    good, dead = [], []
    sink = streams.with_dead_letters([rules.Rule("small", F.col("v") < 3)], rules.TO_DEAD_LETTERS, lambda b, i: good.append(b.count()), lambda b, i: dead.append(b.count()))
    streams.write_batches(read(), sink, str(tmp_path / "c2")).awaitTermination()
    assert (sum(good), sum(dead)) == (2, 1)
    streams.write_parquet(read(), str(tmp_path / "o"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_stateful_streams(spark, tmp_path):
    late = spark.createDataFrame([(1, i, datetime(2024, 1, 1, 10, m)) for i, m in enumerate([0, 10, 5, 3])], "k int, _arrival int, t timestamp")
    late.coalesce(1).write.parquet(str(tmp_path / "late"))
    found = []
    kept = streams.drop_late(streams.read_files(spark, str(tmp_path / "late"), late.schema), "t", "k", timedelta(minutes=5))
    streams.write_batches(kept, lambda b, i: found.extend(r._arrival for r in b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert sorted(found) == [0, 1, 2]
    for n, rows in enumerate(([(1, "left", "a", None), (1, "left", "b", None), (2, "left", "c", None)], [(1, "right", None, "x"), (1, "right", None, "y"), (3, "right", None, "z")])):
        spark.createDataFrame(rows, "k int, side string, l string, r string").coalesce(1).write.mode("append").parquet(str(tmp_path / "join"))
    # Batches by file age would need two runs; one run holds both files, left rows first by name order.
    pairs = []
    merged = streams.read_files(spark, str(tmp_path / "join"), "k int, side string, l string, r string", max_files=1)
    streams.write_batches(streams.keyed_join(merged, "k", ["l"], ["r"]), lambda b, i: pairs.extend((r.k, r.l, r.r) for r in b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert pairs == [(1, "a", "x")]
    assert os.path.exists(tmp_path / "c2")


def test_batches_know_their_watermark(spark, tmp_path):
    for h in (10, 12, 11):
        spark.createDataFrame([(datetime(2024, 1, 1, h),)], "t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    handle = streams.with_watermark_known(lambda df, i, mark: seen.append((df.first().t.hour, mark and mark.hour)), "t", timedelta(hours=1))
    streams.write_batches(streams.read_files(spark, str(tmp_path / "in"), "t timestamp", max_files=1), handle, str(tmp_path / "c")).awaitTermination()
    assert seen == [(10, None), (12, 9), (11, 11)]


def test_skip_read(spark, tmp_path):
    c = checkpoints.Checkpoints(spark, str(tmp_path), checkpoints.OFFSET)
    rows, n = checkpoints.skip_read(spark.range(5).toDF("i"), ["i"], c, "s")
    assert rows.count() == n == 5
    c.save("s", n)
    rows, n = checkpoints.skip_read(spark.range(8).toDF("i"), ["i"], c, "s")
    assert sorted(r.i for r in rows.collect()) == [5, 6, 7] and n == 8


def test_a_waiting_row_may_be_forgotten(spark, tmp_path):
    schema = "k int, side string, l string, r string"
    found = []
    for name, expire in (("kept", timedelta(days=1)), ("gone", timedelta(milliseconds=1))):
        put = lambda row, at=str(tmp_path / f"in {name}"): spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(at)
        put((1, "left", "a", None))
        out = streams.keyed_join(streams.read_files(spark, str(tmp_path / f"in {name}"), schema, max_files=1), "k", ["l"], ["r"], expire=expire)
        q = streams.write_batches(out, lambda b, i, name=name: found.extend((name, r.l, r.r) for r in b.collect()), str(tmp_path / name), once=False, every="500 milliseconds")
        for batch in (2, 5):
            end = time.monotonic() + 15
            while time.monotonic() < end and (not q.lastProgress or q.lastProgress["batchId"] < batch):
                time.sleep(0.1)
            if batch == 2:
                put((1, "right", None, "x"))
        q.stop()
    assert found == [("kept", "a", "x")]

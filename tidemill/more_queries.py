"""More queries with SQL: the operators that the first module leaves out. Registered by importing it."""

from __future__ import annotations

import os
import sqlite3
from datetime import datetime, timedelta, timezone
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import arrays, checks, convert, dates, numbers, strings
from .operators import aggregates, ai, enrich, joins, ordering, routing, rules, transforms
from .plans import lineage, metrics, resilience
from .plans.pipeline import Context, Pipeline
from .queries import DAY, HOUR, clock, query
from .session import read_table, shared_folder
from .sources import brokers, checkpoints, databases, files, http
from .sources.lake import LakeTable
from .streaming import streams

_DECIMAL = "CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"


# --- conversion ------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS by_pattern,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS some
FROM orders""")
def convert_more(spark, sf):
    """Decimals with thousands separators, and times by pattern; what does not parse is null."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.format_number("o_totalprice", 2).alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "dd/MM/yyyy hh:mm:ss a").alias("own"),
    )
    broken = F.when(F.col("o_orderkey") % 3 == 0, F.lit("31/31/1999 xx")).otherwise(F.col("own"))
    pattern = convert.spark_pattern("dd/MM/yyyy hh:mm:ss tt")
    return o.select(
        "o_orderkey", convert.to_decimal("p", 18, 2).alias("price"), clock(convert.to_timestamp("iso")).alias("iso"), clock(convert.to_timestamp("own", pattern)).alias("by_pattern"),
        clock(convert.to_timestamp(broken, pattern)).alias("some"),
    )


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS int_text, printf('%.2f', o_totalprice) AS double_text, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS decimal_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS time_text,
       strftime(o_orderdate, '%Y/%m') AS month_text, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS bool_text, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'n' END AS own_bool, o_orderstatus AS enum_text
FROM orders""")
def convert_to_text(spark, sf):
    even = F.col("o_orderkey") % 2 == 0
    return read_table(spark, sf, "orders").select(
        "o_orderkey", convert.number_to_string("o_orderkey").alias("int_text"), convert.number_to_string("o_totalprice", "%.2f").alias("double_text"),
        convert.number_to_string(F.col("o_totalprice").cast("decimal(18,2)")).alias("decimal_text"), convert.timestamp_to_string("o_orderdate").alias("time_text"), convert.timestamp_to_string("o_orderdate", "yyyy/MM").alias("month_text"),
        convert.bool_to_string(even).alias("bool_text"), convert.bool_to_string(even, "y", "n").alias("own_bool"), convert.enum_to_string("o_orderstatus").alias("enum_text"),
    )


# --- cleansing and validation ----------------------------------------------------------------------


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS zoneless, strftime((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc,
       strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d %H:%M:%S') AS there,
       CASE WHEN event_id % 4 = 0 THEN '2000-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS no_min, CASE WHEN event_id % 4 = 1 THEN '2000-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS no_max,
       CASE WHEN event_id % 4 = 2 THEN '2000-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS no_null, event_id % 4 <> 0 AS not_min, event_id % 4 <> 1 AS not_max, event_id % 4 <> 2 AS not_null
FROM events""")
def cleanse_zones_and_sentinels(spark, sf):
    e, default = read_table(spark, sf, "events").select("event_id", "ts"), datetime(2000, 1, 1)
    n = F.col("event_id") % 4
    least = F.when(n == 0, F.expr("timestamp'0001-01-01 00:00:00'")).otherwise(F.col("ts"))
    most = F.when(n == 1, F.expr("timestamp'9999-12-31 23:59:59.999999'")).otherwise(F.col("ts"))
    none = F.when(n != 2, F.col("ts"))
    return e.select(
        "event_id", clock(dates.as_utc_instant(dates.as_zoneless("ts"))).alias("zoneless"), clock(dates.to_utc("ts", "America/New_York")).alias("utc"), clock(dates.to_local("ts", "Asia/Kolkata")).alias("there"),
        clock(dates.default_if_min_value(least, default)).alias("no_min"), clock(dates.default_if_max_value(most, default)).alias("no_max"), clock(dates.default_if_null(none, default)).alias("no_null"),
        checks.is_not_min_value(least).alias("not_min"), checks.is_not_max_value(most).alias("not_max"), checks.is_not_null(none).alias("not_null"),
    )


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(list_filter(ws, lambda x: x <> '')) AS INTEGER) AS full_words, CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS visible_words, len(ws) > 0 AS some FROM t""")
def cleanse_words(spark, sf):
    words = F.split("text", " ")
    return read_table(spark, sf, "documents").where("text is not null").select(
        "doc_id", F.size(arrays.remove_empty(words)).alias("full_words"), F.size(arrays.remove_blank(words)).alias("visible_words"), checks.array_is_not_empty(words).alias("some"),
    )


_FORMS = """CASE c_custkey % 6 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' WHEN 1 THEN 'no at sign' WHEN 2 THEN '12,345.5' WHEN 3 THEN 'abc' WHEN 4 THEN '12345'
ELSE '{' || substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) || '}' END"""


@query(f"""
WITH t AS (SELECT c_custkey, c_custkey % 6 AS k, {_FORMS} AS s FROM customer)
SELECT c_custkey, k = 0 AS email, k = 5 AS guid, k = 3 AS letters, k = 4 AS digits, k IN (2, 4) AS number_, true AS visible FROM t""")
def validate_forms(spark, sf):
    c = read_table(spark, sf, "customer").withColumn("s", F.expr(_FORMS))
    return c.select(
        "c_custkey", checks.is_email("s").alias("email"), checks.is_guid("s").alias("guid"), checks.is_alphabetic("s").alias("letters"), checks.is_digits_only("s").alias("digits"),
        checks.is_numeric("s").alias("number_"), checks.is_not_blank("s").alias("visible"),
    )


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE p_size - 25 END AS v FROM part)
SELECT p_partkey, coalesce(v >= 0, true) AS zero_or_positive, coalesce(v > 0, true) AS positive, v IS NOT NULL AS given, coalesce(v, 0) AS filled, CASE WHEN v = 0 THEN 99 ELSE v END AS no_zero FROM n""")
def validate_nulls(spark, sf):
    v = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") - 25)
    return read_table(spark, sf, "part").select(
        "p_partkey", checks.is_zero_or_positive(v).alias("zero_or_positive"), checks.is_positive(v).alias("positive"), checks.is_not_null(v).alias("given"), numbers.default_if_null(v, 0).alias("filled"),
        numbers.default_if_zero(v, 99).alias("no_zero"),
    )


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'none' ELSE c_name END AS if_null, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'none' ELSE CASE c_custkey % 4 WHEN 2 THEN '  ' ELSE c_name END END AS if_empty,
       CASE WHEN c_custkey % 4 < 3 THEN 'none' ELSE c_name END AS if_blank, CASE WHEN c_nationkey = 0 THEN -1 ELSE c_nationkey END AS if_zero, CASE WHEN c_nationkey = 0 OR c_custkey % 4 = 0 THEN 77 ELSE c_nationkey END AS if_default,
       CAST(CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 2 END AS INTEGER) AS n_tags
FROM customer""")
def enrich_defaults(spark, sf):
    n = F.col("c_custkey") % 4
    text = F.when(n == 1, "").when(n == 2, "  ").when(n == 3, F.col("c_name"))  # null, empty, blank, full
    tags = F.when(n == 1, F.array().cast("array<string>")).when(n >= 2, F.array(F.lit("a"), F.lit("b")))
    c = read_table(spark, sf, "customer").select(
        "c_custkey", F.when(n == 0, None).otherwise(F.col("c_name")).alias("if_null"), F.when(n > 1, text).when(n == 1, "").alias("if_empty"), text.alias("if_blank"), F.col("c_nationkey").alias("if_zero"),
        F.when(n != 0, F.col("c_nationkey")).alias("if_default"), tags.alias("tags"),
    )
    e = enrich.Enricher().default_if_null("if_null", "none").default_if_empty("if_empty", "none").default_if_blank("if_blank", "none").default_if_zero("if_zero", -1).default_if_type_default("if_default", 77)
    out = e.default_if_empty_array("tags", F.array(F.lit("x"))).apply(c)
    return out.withColumn("n_tags", F.size("tags")).drop("tags")


# --- joins -------------------------------------------------------------------------------------------

_SIDES = """
WITH v AS (SELECT event_id, user_id, time_bucket(INTERVAL '6 hours', ts) AS w, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '6 hours', ts) ORDER BY event_id) AS n FROM events WHERE event_type = 'view'),
     b AS (SELECT event_id, user_id, time_bucket(INTERVAL '6 hours', ts) AS w, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '6 hours', ts) ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase'),
     both_ AS (SELECT v.w, v.user_id, v.event_id AS viewed, b.event_id AS bought FROM v JOIN b ON v.user_id = b.user_id AND v.w = b.w AND v.n = 1 AND b.n = 1),
     only_l AS (SELECT w, user_id, event_id, CAST(NULL AS BIGINT) FROM v WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = v.user_id AND b.w = v.w)),
     only_r AS (SELECT w, user_id, CAST(NULL AS BIGINT), event_id FROM b WHERE n = CASE WHEN EXISTS (SELECT 1 FROM v WHERE b.user_id = v.user_id AND b.w = v.w) THEN 2 ELSE 1 END),
     a AS ({parts})
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, viewed, bought FROM a"""


def _windowed(how: str):
    def run(spark, sf) -> DataFrame:
        e = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
        views, buys = (e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase"))
        out = joins.windowed_join(views, buys, ["user_id"], "ts", "ts", 6 * HOUR, None, ["event_id"], ["event_id"], how)
        return out.select(clock("window_start").alias("window_start"), "user_id", F.col("l.event_id").alias("viewed"), F.col("r.event_id").alias("bought"))

    run.__name__ = f"windowed_join_{how}"
    return run


_BOTH, _LEFT, _RIGHT = "SELECT * FROM both_", " UNION ALL SELECT * FROM only_l", " UNION ALL SELECT * FROM only_r"
for _how, _parts in (("left", _BOTH + _LEFT), ("right", _BOTH + _RIGHT), ("full", _BOTH + _LEFT + _RIGHT)):
    query(_SIDES.format(parts=_parts))(_windowed(_how))


@query("""
WITH l AS (SELECT DISTINCT 2 * n_nationkey AS k FROM nation), l10 AS (SELECT k FROM l ORDER BY k LIMIT 10),
     r AS (SELECT 3 * s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
     parked AS (SELECT r.k, s_suppkey FROM r WHERE n = CASE WHEN k IN (SELECT k FROM l10) THEN 2 ELSE 1 END ORDER BY s_suppkey LIMIT 10)
SELECT l10.k, l10.k AS l, r.s_suppkey AS r FROM l10 LEFT JOIN r ON l10.k = r.k AND r.n = 1 UNION ALL SELECT k, NULL, s_suppkey FROM parked""")
def keyed_join_capacity_full(spark, sf):
    """Both sides keep ten waiting keys at most."""
    left = read_table(spark, sf, "nation").select((2 * F.col("n_nationkey")).alias("k"), (2 * F.col("n_nationkey")).alias("at"))
    right = read_table(spark, sf, "supplier").select((3 * F.col("s_nationkey")).alias("k"), "s_suppkey")
    out = joins.keyed_join(left, right, ["k"], ["at"], ["s_suppkey"], "full", max_capacity=10)
    return out.select("k", F.col("l.at").alias("l"), F.col("r.s_suppkey").alias("r"))


def _self(how: str):
    def run(spark, sf) -> DataFrame:
        s = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 40).alias("boss"))
        return joins.self_join(s, "boss", "s_suppkey", how).select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"))

    run.__name__ = f"self_join_{how}"
    return run


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    query(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a {_sql} JOIN supplier b ON a.s_suppkey % 40 = b.s_suppkey")(_self(_how))


@query("""
SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 2 THEN 'east' WHEN 3 THEN 'west' END AS side FROM nation""")
def lookup_in_memory(spark, sf):
    return read_table(spark, sf, "nation").select("n_nationkey", joins.lookup_map("n_regionkey", {0: "south", 2: "east", 3: "west"}).alias("side"))


@query("""
WITH l AS (SELECT c_custkey AS k, c_name FROM customer), r AS (SELECT 3 * s_suppkey AS k, s_name FROM supplier)
SELECT k, CASE WHEN s_name IS NULL THEN 'only ' || c_name WHEN c_name IS NULL THEN 'unknown ' || s_name ELSE c_name || ' and ' || s_name END AS what FROM l FULL JOIN r USING (k)""")
def join_projections(spark, sf):
    """Matches and the unmatched rows of each side, each by a projection of their own."""
    left = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    right = read_table(spark, sf, "supplier").select((3 * F.col("s_suppkey")).alias("k"), "s_name")
    joined = joins.keyed_join(left, right, ["k"], ["c_name"], ["s_name"], "full")
    return joins.projected(
        joined, ["k"], {"what": F.concat("l.c_name", F.lit(" and "), "r.s_name")}, {"what": F.concat(F.lit("only "), "l.c_name")}, {"what": F.concat(F.lit("unknown "), "r.s_name")},
    )


# --- aggregates --------------------------------------------------------------------------------------


@query(f"""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS spread, round(avg(l_quantity), 6) AS mean, count(l_tax) AS n, CAST(len(list(l_linenumber)) AS INTEGER) AS collected, {_DECIMAL.format(c='l_tax')} AS tax
FROM lineitem GROUP BY 1""")
def named_aggregates_more(spark, sf):
    named = aggregates.NAMED
    out = aggregates.aggregate(read_table(spark, sf, "lineitem"), ["l_returnflag"], s=named["stddev"]("l_quantity"), m=named["avg"]("l_quantity"), n=named["count"]("l_tax"), c=named["collect"]("l_linenumber"), tax=aggregates.exact_sum("l_tax"))
    return out.select("l_returnflag", F.round("s", 6).alias("spread"), F.round("m", 6).alias("mean"), "n", F.size("c").alias("collected"), "tax")


@query("""
SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.5) AS middle FROM lineitem GROUP BY 1, 2""")
def exact_percentiles(spark, sf):
    items, keys = read_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]
    return aggregates.exact_percentile(items, keys, "l_extendedprice", 0.9, "p90").join(aggregates.exact_percentile(items, keys, "l_extendedprice", 0.5, "middle"), keys)


@query("""
WITH q AS (SELECT l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) AS n, count(*) OVER (PARTITION BY l_linestatus) AS c FROM lineitem)
SELECT l_linestatus, min(l_quantity) AS p75, min(q50) AS p50 FROM q JOIN (SELECT l_linestatus AS s, min(l_quantity) AS q50 FROM q WHERE n >= ceil(0.5 * c) GROUP BY 1) ON s = l_linestatus WHERE n >= ceil(0.75 * c) GROUP BY 1""")
def sketched_percentiles(spark, sf):
    """The sketch is exact here, as the column has fewer different values than it holds."""
    return aggregates.aggregate(read_table(spark, sf, "lineitem"), ["l_linestatus"], p75=aggregates.percentile(0.75)("l_quantity"), p50=aggregates.NAMED["approx_median"]("l_quantity"))


@query("""
SELECT user_id, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, (row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 day', ts) ORDER BY event_id) - 1) // 2 AS batch, event_id FROM events""")
def timed_batches(spark, sf):
    """At most two rows, and never across midnight."""
    b = ordering.timed_batches(read_table(spark, sf, "events").select("user_id", "event_id", "ts"), 2, DAY, "ts", ["event_id"], ["user_id"])
    return b.select("user_id", clock("window_start").alias("window_start"), "batch", F.explode("items.event_id").alias("event_id"))


# --- transforms, policies, pipelines -------------------------------------------------------------------


@query("SELECT event_id, CAST(round(value * 2, 6) AS DOUBLE) AS twice FROM events WHERE value > 0")
def opaque_batches(spark, sf):
    """A step that only Python expresses: batches of rows in, any number of rows out."""

    def keep(frames):
        for f in frames:
            some = f[f.value > 0]
            yield pd.DataFrame({"event_id": some.event_id, "twice": (some.value * 2).round(6)})

    return transforms.opaque(read_table(spark, sf, "events").select("event_id", "value"), keep, "event_id long, twice double")


@query("SELECT o_orderkey, i AS part FROM orders, range(3) t(i) WHERE i <= o_orderkey % 3")
def one_to_many(spark, sf):
    """A table function: each row gives one to three."""

    def several(frames):
        for f in frames:
            n = (f.o_orderkey % 3 + 1).astype(int)
            out = f.loc[f.index.repeat(n)]
            yield pd.DataFrame({"o_orderkey": out.o_orderkey.values, "part": out.groupby(level=0).cumcount().values})

    return transforms.opaque(read_table(spark, sf, "orders").select("o_orderkey"), several, "o_orderkey long, part long")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 10 END AS tenfold, CASE WHEN c_custkey % 7 = 0 THEN 'KeyError: ''seven''' END AS error FROM customer WHERE c_custkey % 11 <> 0""")
def per_item_policy(spark, sf):
    """Errors by class: one kind is tried again and then goes well, one is skipped, one is a dead letter."""

    def work(row: dict, tries={}) -> dict:  # noqa: B006  a worker's memory of its own attempts
        k = row["c_custkey"]
        if k % 11 == 0:
            raise ValueError("eleven")
        if k % 7 == 0:
            raise KeyError("seven")
        tries[k] = tries.get(k, 0) + 1
        if k % 5 == 0 and tries[k] % 2:
            raise TimeoutError("once")
        return {"tenfold": k * 10}

    policy = rules.Policy({"TimeoutError": rules.RETRY, "ValueError": rules.SKIP, "LookupError": rules.DEAD_LETTER})
    done = transforms.per_item(read_table(spark, sf, "customer").select("c_custkey"), work, "tenfold long", 3, policy=policy, backoff=resilience.fixed(0.0))
    return done.select(F.coalesce(F.col("tenfold") / 10, F.get_json_object("_item", "$.c_custkey")).cast("long").alias("c_custkey"), "tenfold", F.col("_error").alias("error"))


@query("""
SELECT 'big' AS sink, count(*) AS n FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'all', count(*) FROM orders UNION ALL SELECT 'broken', 0 UNION ALL SELECT 'late', count(*) FROM orders""")
def resilient_graph(spark, sf):
    """One source for several sinks, read once; a step that fails once and is restarted, and one that fails for good and is left out."""
    runs = []

    def fails_once(df: DataFrame) -> DataFrame:
        runs.append(1)
        return df.withColumn("x", F.raise_error(F.lit("not yet"))) if len(runs) == 1 else df

    p = Pipeline().source("orders", lambda c: read_table(c.spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    p.transform("big", lambda df: df.where("o_totalprice > 150000")).transform("late", fails_once, restarts=2)
    p.transform("broken", lambda df: df.withColumn("x", F.raise_error(F.lit("never"))), or_schema="o_orderkey long, o_totalprice double, x string")
    for name in ("big", "broken", "late"):
        p.sink(f"count {name}", lambda df: df.count()).connect("orders", name, f"count {name}")
    p.sink("count all", lambda df: df.count()).connect("orders", "count all")
    found = p.build().run(Context(spark))
    return spark.createDataFrame([(k.removeprefix("count "), n) for k, n in found.items()], "sink string, n long")


@query("SELECT 'solvent' AS node, CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS emitted, CAST(2 AS BIGINT) AS retries FROM customer")
def node_metrics(spark, sf):
    m, tries = metrics.Metrics(), []
    df = m.node("solvent", lambda d: d.where("c_acctbal > 0"))(read_table(spark, sf, "customer"))

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        df.write.format("noop").mode("overwrite").save()

    m.retried("solvent", run, 3, backoff=resilience.fixed(0.0))
    got = m.report()["solvent"]
    return spark.createDataFrame([("solvent", got["processed"], got["emitted"], got["retries"])], "node string, processed long, emitted long, retries long")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def default_merge(spark, sf):
    """A node with several inputs takes all their rows."""
    found = []
    p = Pipeline().source("s", lambda c: read_table(c.spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    p.source("c", lambda c: read_table(c.spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    p.transform("same", lambda df: df).sink("out", found.append).connect("s", "same", "out").connect("c", "same").build().run(Context(spark))
    return found[0]


@query("SELECT o_orderkey FROM orders")
def branch_keeps_rows(spark, sf):
    """Handlers see the rows; the dataset goes on unchanged, also if one of them fails."""
    seen: list = []
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return routing.branch(o, [lambda df: seen.append(df.count()), lambda df: 1 / 0], routing.LOG_AND_CONTINUE, seen.append)


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'DeadLettered' WHEN o_orderstatus = 'P' THEN 'FilteredOut' ELSE 'Emitted' END AS outcome FROM orders""")
def lineage_policies(spark, sf):
    """Outcomes under a policy with several actions; a row under two rules is reported under the first."""
    policy = rules.Policy({"validation": rules.DEAD_LETTER, "filter": rules.SKIP})
    checks_ = [rules.Rule("price", F.col("o_totalprice") <= 300000), rules.filter_rule(F.col("o_orderstatus") != "P")]
    o = lineage.start(read_table(spark, sf, "orders"), "orders", ["o_orderkey"])
    return lineage.outcomes(o, "check", checks_, policy).select("o_orderkey", F.col("_outcome").alias("outcome"))


@query("""
SELECT c_custkey, CASE WHEN n IS NULL THEN 'ConsumedWithoutEmission' ELSE 'Emitted' END AS outcome, '1:n' AS cardinality, coalesce(n, 0) AS gave
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lineage_hops(spark, sf):
    c = lineage.start(read_table(spark, sf, "customer").select("c_custkey"), "customers", ["c_custkey"])
    after = c.join(read_table(spark, sf, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    hops = lineage.exploded(c, after, "orders of")
    return c.join(hops, lineage.ID).select("c_custkey", "hop.outcome", "hop.cardinality", "hop.gave")


# --- sources and sinks -----------------------------------------------------------------------------------


@query("SELECT event_id AS eventId, event_type AS eventType, value FROM events")
def json_arrays(spark, sf):
    """Each file is one JSON array."""
    at = shared_folder(spark)
    files.write_json(read_table(spark, sf, "events").select("event_id", "event_type", "value"), f"{at}/json", naming="camel", lines=False)
    return files.read_json(spark, f"{at}/json", "eventId long, eventType string, value double")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def parquet_options(spark, sf):
    """Files of several schemas, a strict schema, a projection and a filter that reach the scan."""
    at, part = shared_folder(spark), read_table(spark, sf, "part")
    files.write_parquet(part.where("p_size <= 25").select("p_partkey", "p_size"), f"{at}/parts", compression="zstd", max_rows_per_file=500)
    files.write_parquet(part.where("p_size > 25").select("p_partkey", "p_size", "p_brand"), f"{at}/parts", "append")
    wide = files.read_parquet(spark, f"{at}/parts", merge=True)
    assert "p_brand" in wide.columns
    return files.read_parquet(spark, f"{at}/parts", ["p_partkey", "p_size"], F.col("p_size") > 10, wide.schema)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN 'bad' ELSE 'good' END AS state FROM customer")
def csv_quarantine(spark, sf):
    """Rows that do not fit the schema go aside with their text."""
    at = shared_folder(spark)
    c = read_table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "much").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    files.write_csv(c, f"{at}/csv")
    good, bad = files.quarantine(files.read_csv(spark, f"{at}/csv", "c_custkey long, c_acctbal double", errors=files.QUARANTINE).checkpoint())
    raw = bad.select(F.split(files.CORRUPT, ",")[0].cast("long").alias("c_custkey"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("bad").alias("state"))
    return good.withColumn("state", F.lit("good")).unionByName(raw)


@query("SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def duckdb_round_trip(spark, sf):
    import tempfile

    at, own = shared_folder(spark), tempfile.mkdtemp(prefix="tidemill-duckdb-")  # the database is the driver's alone
    for t in ("region", "nation"):
        databases.write_duckdb(read_table(spark, sf, t), f"{own}/own.db", t, databases.local_path(f"{at}/{t}"), "replace")
    sql = "SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2"
    return databases.read_duckdb(spark, sql, f"{own}/own.db", f"{at}/out")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE s_name END AS s_name FROM supplier")
def database_upsert(spark, sf):
    """Insert-or-update by parameterised statements, over a file that stands for a server; a row the database refuses does not stop the others."""
    at = f"{databases.local_path(shared_folder(spark))}.db"
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE suppliers (s_suppkey INTEGER PRIMARY KEY, s_name TEXT NOT NULL)")
    statement = databases.upsert_statement("postgres", "suppliers", ["s_suppkey", "s_name"], ["s_suppkey"])
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_name").coalesce(1)
    connect = lambda: sqlite3.connect(at)
    databases.upsert(s, connect, statement)
    changed = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), "s_name")).alias("s_name"))
    databases.upsert(changed, connect, statement, 10, on_error=lambda row, message: None)
    with sqlite3.connect(at) as c:
        rows = c.execute("SELECT s_suppkey, s_name FROM suppliers").fetchall()
    os.remove(at)
    return spark.createDataFrame(rows, "s_suppkey long, s_name string")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey + 1000000, 1.0 FROM supplier WHERE s_suppkey % 4 = 0")
def change_feed(spark, sf):
    """A feed of updates, deletes and inserts, read after a saved token and applied to a table; of several changes to a key the last one counts."""
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    rows = [(r.s_suppkey, r.s_acctbal) for r in s.collect()]  # a stand-in for a server's log

    def log():
        for k, _ in sorted(rows):
            yield from [("update", k, -1.0), ("update", k, 0.0)] if k % 5 == 0 else []
            yield from [("delete", k, None)] if k % 3 == 0 else []
            yield from [("insert", k + 1_000_000, 1.0)] if k % 4 == 0 else []

    def watch(token):
        for i, (o, k, v) in islice(enumerate(log()), int(token[1:]) + 1 if token else 0, None):
            yield {"operation": o, "key": str(k), "document": str(v), "at": i, "token": f"t{i}"}

    saved = checkpoints.Checkpoints(spark, shared_folder(spark), checkpoints.CDC)
    table = s
    for most in (50, None):  # the rest in one go: a round costs a join with the whole table
        changes = databases.read_changes(spark, watch, saved, "suppliers", most)
        typed = changes.select(F.col("key").cast("long").alias("s_suppkey"), F.expr("try_cast(document AS double)").alias("s_acctbal"), "operation", "at")
        table = databases.apply_changes(table, typed, ["s_suppkey"], "at").checkpoint()
        if (token := databases.last_token(changes)) is not None:
            saved.save("suppliers", token)
    return table


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def http_pages(spark, sf):
    """A paged source with a key to let it in, over a server that is busy at times; the client is a stand-in."""
    names = [(r.n_nationkey, r.n_name) for r in read_table(spark, sf, "nation").collect()]

    def fetch(url, params, headers, busy=[]):  # noqa: B006  the server's memory
        if headers.get("X-Key") != "secret":
            return 401, {}, None
        busy.append(1)
        if len(busy) % 3 == 0:
            return 503, {"Retry-After": "0"}, None
        part = sorted(names)[params["offset"] : params["offset"] + params["limit"]]
        return 200, {}, {"items": [{"id": i, "name": n} for i, n in part]}

    return http.read_http(spark, fetch, ["http://nations"], "id int, name string", paging="offset", path="items", size=4, auth=http.api_key("X-Key", "secret"))


@query("SELECT s_suppkey % 3 AS consumer, CAST(s_suppkey AS VARCHAR) AS body FROM supplier")
def queue_messages(spark, sf):
    """Three consumers of a queue, acknowledged after the sink has them; the queue is a folder of files."""
    top = shared_folder(spark)
    at, out = databases.local_path(top), f"{top}-out"
    for i in range(3):
        os.makedirs(f"{at}/{i}")

    def fill(part):
        for r in part:
            with open(f"{at}/{r.s_suppkey % 3}/{r.s_suppkey:08d}", "w") as f:
                f.write(str(r.s_suppkey))

    read_table(spark, sf, "supplier").select("s_suppkey").foreachPartition(fill)

    class Folder:
        def __init__(self, i):
            self.at, self.names = f"{at}/{i}", None

        def receive(self, n):
            self.names = self.names or iter(sorted(os.listdir(self.at)))
            out = []
            for name in islice(self.names, n):
                with open(f"{self.at}/{name}") as f:
                    out.append({"message_id": name, "body": f.read(), "receipt": name, "sequence": int(name)})
            return out

        def ack(self, receipts):
            for r in receipts:
                os.remove(f"{self.at}/{r}")

    brokers.drain(spark, Folder, lambda df: df.write.mode("append").parquet(out), consumers=3)
    assert not any(os.listdir(f"{at}/{i}") for i in range(3))
    return spark.read.parquet(out).select(F.col("consumer").cast("long").alias("consumer"), "body")


@query("SELECT 'before' AS state, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'now', count(*) FROM orders UNION ALL SELECT 'one status', count(*) FROM orders WHERE o_orderstatus = 'F'")
def lake_history(spark, sf):
    """Earlier states can be read after a compaction, until they expire; a partition is read alone."""
    table = LakeTable(spark, f"{shared_folder(spark)}/orders", ["o_orderstatus"])
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for i in range(4):
        table.append(orders.where(F.col("o_orderkey") % 4 == i), now=start + i * HOUR)
    table.compact(at_least=2)
    states = {"before": table.read(as_of=datetime(2024, 1, 1, 0, 30)), "now": table.read(), "one status": table.read(partition={"o_orderstatus": "F"})}
    return routing.concatenate(*[df.agg(F.count("*").alias("n")).select(F.lit(n).alias("state"), "n") for n, df in states.items()])


@query("SELECT s_suppkey AS id FROM supplier")
def cursor_pages(spark, sf):
    """Pages by an opaque cursor, in two runs: the second goes on from the saved token."""
    ids = sorted(r[0] for r in read_table(spark, sf, "supplier").select("s_suppkey").collect())

    def page(token):
        at = int(token or 0)
        following = at + 7
        return [{"id": i} for i in ids[at:following]], str(following) if following < len(ids) else None

    saved = checkpoints.Checkpoints(spark, shared_folder(spark), checkpoints.CURSOR)
    first, token = checkpoints.read_pages(spark, page, "id long", saved, "suppliers", most=1)
    if token is None:  # there was one page
        return first
    saved.save("suppliers", token)
    rest, _ = checkpoints.read_pages(spark, page, "id long", saved, "suppliers")
    return first.union(rest)


@query("SELECT c_custkey FROM customer")
def skipped_rows(spark, sf):
    """The offset strategy: the second read skips what the first one had."""
    c = read_table(spark, sf, "customer").select("c_custkey")
    saved = checkpoints.Checkpoints(spark, shared_folder(spark), checkpoints.OFFSET)
    first, n = checkpoints.skip_read(c.where("c_custkey <= 500"), ["c_custkey"], saved, "customers")
    saved.save("customers", n)
    return first.union(checkpoints.skip_read(c, ["c_custkey"], saved, "customers")[0])


# --- streams ----------------------------------------------------------------------------------------------


def _latest_first(spark, sf) -> tuple[DataFrame, str]:
    """The events as a stream of three files, the latest rows first; a batch's rows are late by the watermark that the batch before it began with."""
    at, events = shared_folder(spark), read_table(spark, sf, "events").drop("props")
    late, middle = F.col("ts") >= datetime(2024, 1, 20), F.col("ts") >= datetime(2024, 1, 15)
    for test in (late, middle & ~late, ~middle):
        events.where(test).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return streams.read_files(spark, f"{at}/in", events.schema, max_files=1), at


@query("""
WITH top AS (SELECT max(ts) - INTERVAL '2 days' AS w FROM events)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events, top WHERE ts >= TIMESTAMP '2024-01-15' AND date_trunc('hour', ts) + INTERVAL '1 hour' <= w GROUP BY 1""")
def stream_late_rows(spark, sf):
    """Rows that come two weeks late are dropped, and windows are given once they are final."""
    source, at = _latest_first(spark, sf)
    out = streams.windowed_aggregate(source, "ts", HOUR, [], {"n": F.count("*")}, delay=timedelta(days=2))
    write = lambda df, i: df.write.mode("append").parquet(f"{at}/out")
    streams.write_batches(out, write, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(clock("window_start").alias("window_start"), "n")


@query("""
WITH p AS (SELECT user_id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 0 WHEN ts >= TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS part FROM events)
SELECT user_id, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.part < p.part) GROUP BY 1""")
def stream_keeps_early(spark, sf):
    """Late rows per key: with the latest rows first, all others of a user are below the user's watermark."""
    source, at = _latest_first(spark, sf)
    first = source.withColumn("_arrival", F.col("ts").cast("double"))
    kept = streams.drop_late(first, "ts", "user_id", timedelta(0))
    write = lambda df, i: df.select("user_id", "event_id").write.mode("append").parquet(f"{at}/out")
    streams.write_batches(kept, write, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT user_id, min(event_id) AS l FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id, min(event_id) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, '00' || l AS code, strftime((SELECT ts FROM events WHERE event_id = l), '%Y-%m-%d %H:%M:%S') AS at, r FROM l JOIN r USING (user_id)""")
def stream_keyed_join(spark, sf):
    """One-to-one across two micro-batches: what waits keeps its types. Each side has one row for each user."""
    at, e = shared_folder(spark), read_table(spark, sf, "events")
    for side, kind in (("left", "view"), ("right", "purchase")):
        one = e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("ts", "event_id").alias("ts"))
        one.select("user_id", F.lit(side).alias("side"), F.concat(F.lit("00"), F.col("event_id").cast("string")).alias("code"), "ts", F.col("event_id").alias("r")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    merged = streams.read_files(spark, f"{at}/in", "user_id long, side string, code string, ts timestamp, r long", max_files=1)
    write = lambda df, i: df.write.mode("append").parquet(f"{at}/out")
    streams.write_batches(streams.keyed_join(merged, "user_id", ["code", "ts"], ["r"]), write, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id", "code", clock("ts").alias("at"), "r")


@query("SELECT event_id, 'saw ' || event_type AS note FROM events")
def ai_enrich_events(spark, sf):
    """The model is a stand-in that needs no network."""
    model = lambda prompts: [{"note": f"saw {p}"} for p in prompts]
    return ai.ai_enrich(read_table(spark, sf, "events").select("event_id", "event_type"), "event_type", model, "note string").select("event_id", "note")


@query("SELECT p_partkey, trim(p_name) AS p_name FROM part")
def composite_in_context(spark, sf):
    """A nested pipeline that reads a parameter of the outer one."""
    found = []
    p = Pipeline().source("parts", lambda c: read_table(c.spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_name").alias("p_name")))
    p.composite("clean", lambda df, c: df.withColumn(c.parameters["column"], strings.trim(c.parameters["column"]))).sink("out", found.append)
    p.connect("parts", "clean", "out").build().run(Context(spark, {"column": "p_name"}))
    return found[0]

"""Queries over the supplied tables, one or more for each operator, with equivalent SQL for DuckDB.

Times leave the queries as text, so that no engine's time zone enters a comparison. Sums of
doubles are taken as decimals, which do not depend on order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, checks, convert, dates, json_access, numbers, strings
from .operators import aggregates, ai, enrich, joins, ordering, routing, rules, transforms, windows
from .plans import lineage
from .plans.pipeline import Context, Pipeline
from .session import read_table, shared_folder
from .sources import checkpoints, files
from .sources.lake import LakeTable
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def clock(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")




# --- filters and rules ----------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 10 AND event_type <> 'error'")
def filter_events(spark, sf):
    kept, _ = rules.apply_rules(
        read_table(spark, sf, "events"), [rules.filter_rule(F.col("value") > 10), rules.filter_rule(F.col("event_type") != "error")], rules.SKIP_REFUSED,
    )
    return kept.select("event_id", "user_id", "event_type", "value")


EVENT_RULES = lambda: [
    rules.Rule("positive value", checks.is_greater_than("value", 5), "value", "Value is too small."),
    rules.Rule("known type", checks.is_in_list("event_type", ["click", "view", "purchase"]), "event_type"),
    rules.Rule("even user", checks.is_even("user_id"), "user_id"),
]


@query("""
SELECT event_id, CASE WHEN NOT value > 5 THEN 'positive value' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'known type' ELSE 'even user' END AS rule,
       CASE WHEN NOT value > 5 THEN 'Value is too small.' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'Validation failed for rule ''known type''.'
            ELSE 'Validation failed for rule ''even user''.' END AS message
FROM events WHERE NOT (value > 5 AND event_type IN ('click', 'view', 'purchase') AND user_id % 2 = 0)""")
def rejected_events(spark, sf):
    _, dead = rules.apply_rules(read_table(spark, sf, "events"), EVENT_RULES(), rules.TO_DEAD_LETTERS)
    return dead.select("event_id", "rule", "message")


@query("SELECT event_id, value FROM events WHERE value > 5 AND event_type IN ('click', 'view', 'purchase') AND user_id % 2 = 0")
def validated_events(spark, sf):
    kept, _ = rules.split(read_table(spark, sf, "events"), EVENT_RULES())
    return kept.select("event_id", "value")


# --- cleansing ------------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, '  ' || p_name || chr(9) || ' ' || p_type || chr(10) AS raw FROM part)
SELECT p_partkey, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS trimmed, regexp_replace(raw, '^\s+', '') AS trimmed_start, regexp_replace(raw, '\s+$', '') AS trimmed_end,
       trim(regexp_replace(raw, '\s+', ' ', 'g')) AS collapsed, regexp_replace(raw, '\s+', '', 'g') AS no_space, lower(p_brand) AS low, upper(p_name) AS up,
       regexp_replace(p_brand || '-' || p_name, '[^\p{L}\p{Nd}]', '', 'g') AS plain, regexp_replace(p_brand, '[0-9]', '', 'g') AS no_digits,
       regexp_replace(p_name || 'é', '[^\x00-\x7F]', '', 'g') AS ascii, left(p_type, 5) AS short,
       CASE WHEN starts_with(p_brand, 'Brand') THEN p_brand ELSE 'Brand' || p_brand END AS prefixed, CASE WHEN ends_with(p_type, '!') THEN p_type ELSE p_type || '!' END AS suffixed,
       replace(p_name, 'a', 'A') AS replaced, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE p_name END AS blank_default, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS blank_null,
       CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE p_name END AS empty_default
FROM p""")
def cleanse_strings(spark, sf):
    p = read_table(spark, sf, "part")
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type", F.lit("\n"))
    blank = F.when(F.col("p_partkey") % 7 == 0, F.lit(" \t")).otherwise(F.col("p_name"))
    empty = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_name"))
    return transforms.project(
        p, p_partkey=F.col("p_partkey"), trimmed=strings.trim(raw), trimmed_start=strings.trim_start(raw), trimmed_end=strings.trim_end(raw),
        collapsed=strings.collapse_whitespace(raw), no_space=strings.remove_whitespace(raw), low=strings.to_lower("p_brand"), up=strings.to_upper("p_name"),
        plain=strings.remove_special_characters(F.concat("p_brand", F.lit("-"), "p_name")), no_digits=strings.remove_digits("p_brand"),
        ascii=strings.remove_non_ascii(F.concat("p_name", F.lit("é"))), short=strings.truncate("p_type", 5), prefixed=strings.ensure_prefix("p_brand", "Brand"),
        suffixed=strings.ensure_suffix("p_type", "!"), replaced=strings.replace("p_name", "a", "A"), blank_default=strings.default_if_blank(blank, "none"),
        blank_null=strings.null_if_blank(blank), empty_default=strings.default_if_empty(empty, "none"),
    )


@query(r"""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: array_to_string(list_transform(string_split(x, '-'), lambda y: upper(left(y, 1)) || y[2:]), '-')), ' ') AS title
FROM (SELECT p_partkey, p_type || '-' || p_name AS p_type FROM part)""")
def title_case(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", strings.to_title_case(F.concat("p_type", F.lit("-"), "p_name")).alias("title"))


@query("""
SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clamped, greatest(c_acctbal, 100) AS low_bound, least(c_acctbal, 100) AS high_bound,
       CAST(round_even(CAST(c_acctbal AS DECIMAL(18,4)), 1) AS DOUBLE) AS rounded, floor(c_acctbal) AS floored, ceil(c_acctbal) AS ceiled, abs(c_acctbal) AS absolute,
       CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS zeroed, c_acctbal * 2.0 AS scaled, coalesce(nullif(c_nationkey, 3), -1) AS filled
FROM customer""")
def cleanse_numbers(spark, sf):
    return transforms.project(
        read_table(spark, sf, "customer"), c_custkey=F.col("c_custkey"), clamped=numbers.clamp("c_acctbal", 0.0, 5000.0), low_bound=numbers.at_least("c_acctbal", 100.0),
        high_bound=numbers.at_most("c_acctbal", 100.0), rounded=numbers.round_half_even(F.col("c_acctbal").cast("decimal(18,4)"), 1).cast("double"), floored=numbers.floor("c_acctbal"),
        ceiled=numbers.ceiling("c_acctbal"), absolute=numbers.absolute("c_acctbal"), zeroed=numbers.zero_if_negative("c_acctbal"), scaled=numbers.scale("c_acctbal", 2.0),
        filled=numbers.default_if_null(F.nullif("c_nationkey", F.lit(3)), -1),
    )


@query("""
SELECT event_id, strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS quarter, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day,
       strftime(date_trunc('minute', ts + INTERVAL '30 seconds'), '%Y-%m-%d %H:%M:%S') AS to_minute, strftime(date_trunc('hour', ts + INTERVAL '30 minutes'), '%Y-%m-%d %H:%M:%S') AS to_hour,
       strftime(date_trunc('day', ts + INTERVAL '12 hours'), '%Y-%m-%d %H:%M:%S') AS to_day, strftime(least(greatest(ts, TIMESTAMP '2024-01-05'), TIMESTAMP '2024-01-20'), '%Y-%m-%d %H:%M:%S') AS clamped,
       strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week
FROM events""")
def cleanse_dates(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(
        "event_id", clock(dates.truncate("ts", timedelta(minutes=15))).alias("quarter"), clock(dates.strip_time("ts")).alias("day"), clock(dates.round_to_minute("ts")).alias("to_minute"),
        clock(dates.round_to_hour("ts")).alias("to_hour"), clock(dates.round_to_day("ts")).alias("to_day"), clock(dates.clamp("ts", datetime(2024, 1, 5), datetime(2024, 1, 20))).alias("clamped"),
        clock(dates.truncate("ts", 7 * DAY)).alias("week"),
    )


@query("""
SELECT vec_id, CAST(len(list_distinct(r)) AS INTEGER) AS n_distinct, list_sort(r)[1] AS least, r[64] AS last, CAST(len(r[1:5]) AS INTEGER) AS taken, r[11] AS after_skip, CAST(64 AS INTEGER) AS n_full
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS INTEGER)) AS r FROM embeddings)""")
def cleanse_arrays(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 10).cast("int")).alias("r"))
    return e.select(
        "vec_id", F.size(arrays.remove_duplicates("r")).alias("n_distinct"), arrays.sort("r")[0].alias("least"), arrays.reverse("r")[0].alias("last"),
        F.size(arrays.take("r", 5)).alias("taken"), arrays.skip("r", 10)[0].alias("after_skip"), F.size(arrays.remove_nulls(F.concat("r", F.array(F.lit(None).cast("int"))))).alias("n_full"),
    )


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz FROM events")
def json_properties(spark, sf):
    return read_table(spark, sf, "events").select("event_id", json_access.json_value("props", "k", "bigint").alias("k"), json_access.has_path("props", "k").alias("has_k"), json_access.has_path("props", "zz").alias("has_zz"))


_TEXT_NUMBER = "CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 5 = 1 THEN ' ' || o_orderkey || ' ' WHEN o_orderkey % 5 = 2 THEN '' ELSE CAST(o_orderkey AS STRING) END"


@query(f"""
WITH t AS (SELECT o_orderkey, {_TEXT_NUMBER.replace('STRING', 'VARCHAR')} AS s, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '1' ELSE 'maybe' END AS b, o_orderstatus AS st FROM orders)
SELECT o_orderkey, TRY_CAST(trim(s) AS INTEGER) AS as_int, TRY_CAST(trim(s) AS BIGINT) AS as_long, TRY_CAST(trim(s) AS DOUBLE) AS as_double,
       CASE WHEN lower(b) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(b) IN ('false', '0', 'no', 'off') THEN false END AS as_bool, trim(s) = '' OR TRY_CAST(trim(s) AS INTEGER) IS NULL AS failed,
       CASE st WHEN 'O' THEN 'O' WHEN 'F' THEN 'F' END AS as_enum
FROM t""")
def convert_types(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_TEXT_NUMBER).alias("s"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '1' ELSE 'maybe' END").alias("b"), F.lower("o_orderstatus").alias("st"),
    )
    return o.select(
        "o_orderkey", convert.to_int("s").alias("as_int"), convert.to_long("s").alias("as_long"), convert.to_double("s").alias("as_double"), convert.to_bool("b").alias("as_bool"),
        convert.failed("s", convert.to_int("s")).alias("failed"), convert.to_enum("st", ["O", "F"]).alias("as_enum"),
    )


# --- validation -----------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE url END AS u FROM pages)
SELECT page_id, coalesce(u <> '', false) AS not_empty, coalesce(length(u) >= 40, true) AS long, coalesce(length(u) <= 50, true) AS short, coalesce(length(u) BETWEEN 30 AND 45, true) AS between_,
       coalesce(regexp_matches(u, '^https?://'), true) AS is_url, coalesce(regexp_matches(u, '[0-9]{3}'), true) AS three_digits, coalesce(contains(u, 'example'), true) AS has_example,
       coalesce(starts_with(u, 'https'), true) AS secure, coalesce(ends_with(u, '.html'), true) AS html, coalesce(regexp_matches(u, '^[\p{L}\p{Nd}]*$'), true) AS alnum
FROM t""")
def validate_strings(spark, sf):
    u = F.when(F.col("page_id") % 11 != 0, F.col("url"))
    return read_table(spark, sf, "pages").select(
        "page_id", checks.is_not_empty(u).alias("not_empty"), checks.has_min_length(u, 40).alias("long"), checks.has_max_length(u, 50).alias("short"), checks.has_length_between(u, 30, 45).alias("between_"),
        checks.is_url(u).alias("is_url"), checks.matches(u, "[0-9]{3}").alias("three_digits"), checks.contains(u, "example").alias("has_example"), checks.starts_with(u, "https").alias("secure"),
        checks.ends_with(u, ".html").alias("html"), checks.is_alphanumeric(u).alias("alnum"),
    )


@query("""
SELECT c_custkey, c_acctbal > 0 AS positive, c_acctbal < 0 AS negative, c_acctbal >= 0 AS not_negative, c_nationkey <> 0 AS non_zero, c_acctbal BETWEEN 100 AND 1000 AS between_,
       c_custkey % 2 = 0 AS even, c_custkey % 2 <> 0 AS odd, c_nationkey % 3 = 2 AS finite, c_acctbal = floor(c_acctbal) AS whole, c_acctbal > 500 AS greater, c_acctbal < 500 AS less FROM customer""")
def validate_numbers(spark, sf):
    b = "c_acctbal"
    return read_table(spark, sf, "customer").select(
        "c_custkey", checks.is_positive(b).alias("positive"), checks.is_negative(b).alias("negative"), checks.is_not_negative(b).alias("not_negative"), checks.is_non_zero("c_nationkey").alias("non_zero"),
        checks.is_number_between(b, 100, 1000).alias("between_"), checks.is_even("c_custkey").alias("even"), checks.is_odd("c_custkey").alias("odd"),
        checks.is_finite(F.expr("CASE c_nationkey % 3 WHEN 0 THEN double('Infinity') WHEN 1 THEN double('NaN') ELSE c_acctbal END")).alias("finite"),
        checks.is_integer_value(b).alias("whole"), checks.is_greater_than(b, 500).alias("greater"), checks.is_less_than(b, 500).alias("less"),
    )


@query("""
SELECT o_orderkey, o_orderdate > TIMESTAMP '1997-01-01' AS after_, o_orderdate < TIMESTAMP '1997-01-01' AS before_, o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AS between_,
       isodow(o_orderdate) <= 5 AS weekday_, isodow(o_orderdate) > 5 AS weekend, dayofweek(o_orderdate) = 1 AS monday, year(o_orderdate) = 1996 AS in_1996, month(o_orderdate) = 2 AS in_february,
       o_orderdate < TIMESTAMP '2020-01-01' AS past, o_orderdate > TIMESTAMP '2020-01-01' AS future, CAST(o_orderdate AS DATE) = DATE '2020-01-01' AS today FROM orders""")
def validate_dates(spark, sf):
    d, now = "o_orderdate", datetime(2020, 1, 1)
    return read_table(spark, sf, "orders").select(
        "o_orderkey", checks.is_after(d, datetime(1997, 1, 1)).alias("after_"), checks.is_before(d, datetime(1997, 1, 1)).alias("before_"), checks.is_date_between(d, datetime(1995, 1, 1), datetime(1996, 12, 31)).alias("between_"),
        checks.is_weekday(d).alias("weekday_"), checks.is_weekend(d).alias("weekend"), checks.is_day_of_week(d, 1).alias("monday"), checks.is_in_year(d, 1996).alias("in_1996"), checks.is_in_month(d, 2).alias("in_february"),
        checks.is_in_past(d, now).alias("past"), checks.is_in_future(d, now).alias("future"), checks.is_today(d, now).alias("today"),
    )


@query("""
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS INTEGER)) AS r FROM embeddings)
SELECT vec_id, len(r) >= 64 AS enough, len(r) <= 63 AS few, len(r) BETWEEN 1 AND 64 AS between_, len(list_filter(r, lambda x: x < 4)) = len(r) AS all_small, len(list_filter(r, lambda x: x > 2)) > 0 AS any_large,
       len(list_filter(r, lambda x: x > 2)) = 0 AS none_large, list_contains(r, 0) AS has_zero, NOT list_contains(r, 0) AS no_zero, len(list_distinct(r)) = len(r) AS unique_,
       len(list_filter(r, lambda x: x NOT IN (-2, -1, 0, 1))) = 0 AS subset FROM t""")
def validate_arrays(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 10).cast("int")).alias("r"))
    return e.select(
        "vec_id", checks.has_min_count("r", 64).alias("enough"), checks.has_max_count("r", 63).alias("few"), checks.has_count_between("r", 1, 64).alias("between_"), checks.all_match("r", lambda x: x < 4).alias("all_small"),
        checks.any_match("r", lambda x: x > 2).alias("any_large"), checks.none_match("r", lambda x: x > 2).alias("none_large"), checks.array_contains("r", 0).alias("has_zero"),
        checks.does_not_contain("r", 0).alias("no_zero"), checks.all_unique("r").alias("unique_"), checks.is_subset_of("r", [-2, -1, 0, 1]).alias("subset"),
    )


# --- joins and enrichment ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name AS part_name, p_brand AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def lookup_part(spark, sf):
    items = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(items, read_table(spark, sf, "part"), "l_partkey", "p_partkey", {"part_name": "p_name", "brand": "p_brand"})


_RANKED = """
WITH l AS (SELECT 2 * o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
     r AS (SELECT 3 * user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
     l1 AS (SELECT * FROM l WHERE n = 1), r1 AS (SELECT * FROM r WHERE n = 1), r2 AS (SELECT * FROM r WHERE n = 2),
     inner_ AS (SELECT l1.k, o_orderkey, event_id FROM l1 JOIN r1 USING (k)),
     left_ AS (SELECT k, o_orderkey, CAST(NULL AS BIGINT) AS event_id FROM l1 WHERE k NOT IN (SELECT k FROM r1)),
     right_ AS (SELECT k, CAST(NULL AS BIGINT) AS o_orderkey, event_id FROM r1 WHERE k NOT IN (SELECT k FROM l1) UNION ALL SELECT k, NULL, event_id FROM r2 WHERE k IN (SELECT k FROM l1))
"""
_PARTS = {"inner": "SELECT * FROM inner_", "left": "SELECT * FROM inner_ UNION ALL SELECT * FROM left_", "right": "SELECT * FROM inner_ UNION ALL SELECT * FROM right_", "full": "SELECT * FROM inner_ UNION ALL SELECT * FROM left_ UNION ALL SELECT * FROM right_"}


def _keyed(how: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # Even keys on one side and multiples of three on the other: both have rows without a match.
        left = read_table(spark, sf, "orders").select((2 * F.col("o_custkey")).alias("k"), "o_orderdate", "o_orderkey")
        right = read_table(spark, sf, "events").select((3 * F.col("user_id")).alias("k"), "event_id")
        joined = joins.keyed_join(left, right, ["k"], ["o_orderdate", "o_orderkey"], ["event_id"], how)
        return joins.flat(joined, ["k"]).select("k", "o_orderkey", "event_id")

    return run


for _how, _sql in _PARTS.items():
    QUERIES[f"keyed_join_{_how}"], SQL[f"keyed_join_{_how}"] = _keyed(_how), _RANKED + _sql


@query("""
WITH l AS (SELECT nation.n_nationkey AS k, n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation), keep AS (SELECT * FROM l WHERE n <= 10),
     r AS (SELECT s_nationkey AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1)
SELECT k, n_name, s_suppkey FROM keep LEFT JOIN r USING (k)""")
def keyed_join_capacity(spark, sf):
    left = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("at"), "n_name")
    right = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return joins.flat(joins.keyed_join(left, right, ["k"], ["at"], ["s_suppkey"], "left", max_capacity=10), ["k"]).select("k", "n_name", "s_suppkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def self_join_suppliers(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return joins.self_join(s, "s_nationkey").select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"))


@query("""
WITH t AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT a.k, CAST(a.y AS INTEGER) AS y, a.n, b.n AS before_ FROM t a LEFT JOIN t b ON a.k = b.k AND a.y = b.y + 1""")
def year_over_year(spark, sf):
    t = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    t = t.withColumns({"this": F.struct("k", "y"), "next": F.struct("k", (F.col("y") + 1).alias("y"))})
    return joins.self_join(t, "this", "next", "left").select("l.k", "l.y", "l.n", F.col("r.n").alias("before_"))


_WINDOWED = """
WITH v AS (SELECT event_id, user_id, ts, {w} AS w FROM events {x} WHERE event_type = 'view'{c}), b AS (SELECT event_id, user_id, ts, {w} AS w FROM events {x} WHERE event_type = 'purchase'{c}),
     v1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) AS n FROM v), b1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) AS n FROM b)
SELECT strftime(v1.w, '%Y-%m-%d %H:%M:%S') AS window_start, v1.user_id, v1.event_id AS viewed, b1.event_id AS bought FROM v1 JOIN b1 ON v1.user_id = b1.user_id AND v1.w = b1.w AND v1.n = 1 AND b1.n = 1"""


def _views_and_purchases(spark, sf, slide):
    e = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views, buys = (e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "purchase"))
    joined = joins.windowed_join(views, buys, ["user_id"], "ts", "ts", 6 * HOUR, slide, ["event_id"], ["event_id"])
    return joined.select(clock("window_start").alias("window_start"), "user_id", F.col("l.event_id").alias("viewed"), F.col("r.event_id").alias("bought"))


@query(_WINDOWED.format(w="time_bucket(INTERVAL '6 hours', ts)", x="", c=""))
def windowed_join_tumbling(spark, sf):
    return _views_and_purchases(spark, sf, None)


@query(_WINDOWED.format(w="time_bucket(INTERVAL '2 hours', ts) - i * INTERVAL '2 hours'", x=", range(3) t(i)", c=""))
def windowed_join_sliding(spark, sf):
    return _views_and_purchases(spark, sf, 2 * HOUR)


@query("""
SELECT o_orderkey, o_totalprice * 2 AS doubled, coalesce(CASE WHEN c.c_custkey IS NOT NULL THEN c_mktsegment END, o_orderpriority) AS note, coalesce(s.s_acctbal, 0) AS balance,
       CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status
FROM orders LEFT JOIN customer c ON o_custkey = 2 * c_custkey LEFT JOIN (SELECT s_suppkey, s_acctbal FROM supplier) s ON o_custkey = s_suppkey""")
def enrich_orders(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("note", F.col("o_orderpriority"))
    e = enrich.Enricher().compute("doubled", F.col("o_totalprice") * 2).lookup("note", "o_custkey", read_table(spark, sf, "customer").withColumn("k", 2 * F.col("c_custkey")), "k", "c_mktsegment")
    e.set("balance", "o_custkey", read_table(spark, sf, "supplier"), "s_suppkey", "s_acctbal").compute("status", F.col("o_orderstatus")).default_when("status", F.col("status") == "F", "done")
    return e.apply(o).select("o_orderkey", "doubled", "note", "balance", "status")


# --- aggregation, windows, order --------------------------------------------------------------------

_SUM = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"


@query(f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, {_SUM} AS total
FROM events WHERE value > 0 GROUP BY 1, 2""")
def hourly_totals(spark, sf):
    kept, _ = rules.apply_rules(read_table(spark, sf, "events"), [rules.filter_rule(F.col("value") > 0)], rules.SKIP_REFUSED)
    out = aggregates.tumbling_aggregate(kept, "ts", HOUR, ["event_type"], n=F.count("*"), total=aggregates.exact_sum("value"))
    return out.select(clock("window_start").alias("window_start"), "event_type", "n", "total")


_SLIDING = f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, {_SUM} AS total
FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' AS w FROM events, range(4) t(i)) GROUP BY 1, 2"""


@query(_SLIDING)
def sliding_totals(spark, sf):
    out = aggregates.sliding_aggregate(read_table(spark, sf, "events"), "ts", 4 * HOUR, HOUR, ["event_type"], n=F.count("*"), total=aggregates.exact_sum("value"))
    return out.select(clock("window_start").alias("window_start"), "event_type", "n", "total")


@query(_SLIDING)
def sliding_totals_by_panes(spark, sf):
    out = aggregates.sliding_sums(read_table(spark, sf, "events"), "ts", 4 * HOUR, HOUR, ["event_type"], n=F.lit(1), total=F.col("value").cast("decimal(18,4)"))
    return out.select(clock("window_start").alias("window_start"), "event_type", F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"))


@query(f"""
SELECT strftime(time_bucket(INTERVAL '7 days', ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL '7 days', ts) + INTERVAL '7 days', '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n, {_SUM} AS total
FROM events GROUP BY 1, 2""")
def weekly_totals(spark, sf):
    out = aggregates.tumbling_aggregate(read_table(spark, sf, "events"), "ts", 7 * DAY, [], n=F.count("*"), total=aggregates.exact_sum("value"))
    return out.select(clock("window_start").alias("window_start"), clock("window_end").alias("window_end"), "n", "total")


_SESSIONS = """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS new_ FROM events),
     s AS (SELECT event_id, user_id, ts, CAST(sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
"""


@query(_SESSIONS + "SELECT user_id, session, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY 1, 2")
def user_sessions(spark, sf):
    s = windows.sessions(read_table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 2 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), clock(F.min("ts")).alias("began"), clock(F.max("ts")).alias("ended"))


@query(_SESSIONS + """, c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1) // 3 AS part FROM s)
SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY session, part) - 1 AS session, n FROM (SELECT user_id, session, part, count(*) AS n FROM c GROUP BY 1, 2, 3)""")
def capped_sessions(spark, sf):
    s = windows.sessions(read_table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 2 * HOUR, cap=3)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, min(l_discount) AS least, max(l_discount) AS most, count(DISTINCT l_partkey) AS parts,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS average, quantile_cont(l_quantity, 0.5) AS middle, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS last_order
FROM lineitem GROUP BY 1, 2""")
def named_aggregates(spark, sf):
    items = read_table(spark, sf, "lineitem").withColumn("at", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    named = aggregates.NAMED
    return aggregates.aggregate(
        items, ["l_returnflag", "l_linestatus"], n=named["count"]("l_orderkey"), quantity=aggregates.exact_sum("l_quantity"), least=named["min"]("l_discount"), most=named["max"]("l_discount"),
        parts=named["count_distinct"]("l_partkey"), average=aggregates.exact_sum("l_quantity") / F.count("*"), middle=named["median"]("l_quantity"),
        first_order=aggregates.first_by("l_orderkey", "at"), last_order=aggregates.last_by("l_orderkey", "at"),
    )


@query("""
SELECT user_id, list_reduce(list_prepend(CAST(7 AS BIGINT), list(k ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS result
FROM (SELECT user_id, event_id, CAST(value AS BIGINT) AS k FROM events) GROUP BY 1""")
def ordered_fold(spark, sf):
    e = read_table(spark, sf, "events").withColumn("k", F.expr("CAST(rint(value) AS BIGINT)"))
    return transforms.fold(["user_id"], "event_id", "k", F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003)(e)


@query("""
SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS n,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderkey_lag, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderkey_lead,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS so_far
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def analytic_columns(spark, sf):
    o = aggregates.ranked(read_table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority"], r="rank", d="dense_rank")
    o = aggregates.ranked(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], n="row_number")
    o = aggregates.running(aggregates.neighbours(o, ["o_custkey"], ["o_orderkey"], "o_orderkey"), ["o_custkey"], ["o_orderkey"], so_far=F.count("*"))
    return o.select("o_orderkey", "r", "d", "n", "o_orderkey_lag", "o_orderkey_lead", "so_far")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_orders(spark, sf):
    return aggregates.top_k(read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


# --- late data, routing, merging, batching ----------------------------------------------------------

#: The tables are in time order; this arrival is not.
ARRIVAL = lambda: F.expr("(event_id * 7919) % 10007").alias("arrival")


@query("""
WITH m AS (SELECT event_id, ts, max(ts) OVER (ORDER BY (event_id * 7919) % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
SELECT event_id FROM m WHERE top IS NULL OR ts >= top - INTERVAL '5 days'""")
def late_filter(spark, sf):
    e = ordering.late_marks(read_table(spark, sf, "events").select("event_id", "ts", ARRIVAL()), "ts", ["arrival", "event_id"], 5 * 86_400_000_000)
    return e.where("not late").select("event_id")


@query("""
WITH m AS (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
SELECT event_id FROM m WHERE top IS NULL OR ts >= top - INTERVAL '1 day'""")
def late_filter_by_user(spark, sf):
    e = ordering.late_marks(read_table(spark, sf, "events").select("event_id", "ts", "user_id", ARRIVAL()), "ts", ["arrival", "event_id"], 86_400_000_000, ["user_id"])
    return e.where("not late").select("event_id")


def _router(mode: str) -> routing.Router:
    return routing.Router(mode, "rest").when("big", F.col("value") > 50).when("even", F.col("event_id") % 2 == 0)


@query("SELECT event_id, CASE WHEN value > 50 THEN 'big' WHEN event_id % 2 = 0 THEN 'even' ELSE 'rest' END AS route FROM events")
def route_first(spark, sf):
    return _router(routing.FIRST_MATCH).route(read_table(spark, sf, "events")).select("event_id", "route")


@query("""
SELECT event_id, 'big' AS route FROM events WHERE value > 50 UNION ALL SELECT event_id, 'even' FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'rest' FROM events WHERE NOT value > 50 AND event_id % 2 <> 0""")
def route_all(spark, sf):
    return _router(routing.ALL_MATCHES).route(read_table(spark, sf, "events")).select("event_id", "route")


@query("SELECT s_nationkey AS k, s_suppkey AS id, CAST(0 AS INTEGER) AS source FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer")
def concat_merge(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    c = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    return routing.concatenate(s, c, index="source")


@query("""
SELECT k, name FROM (SELECT s_suppkey AS k, s_name AS name, 0 AS s FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) = 1""")
def priority_merge(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return routing.priority_merge(["k"], ["name"], s, c)


@query("SELECT batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders) GROUP BY 1")
def batch_sizes(spark, sf):
    b = ordering.batches(read_table(spark, sf, "orders").select("o_orderkey"), 64, ["o_orderkey"])
    return b.select("batch", "n", F.col("items")[0]["o_orderkey"].alias("first_key"))


@query("""
SELECT o_custkey, o_orderkey, (row_number() OVER w - 1) // 3 AS batch, CAST((row_number() OVER w - 1) % 3 AS INTEGER) AS position FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def batch_unbatch(spark, sf):
    b = ordering.batches(read_table(spark, sf, "orders").select("o_custkey", "o_orderkey"), 3, ["o_orderkey"], ["o_custkey"])
    return ordering.unbatch(b.select("batch", "items")).select("o_custkey", "o_orderkey", "batch", "position")


@query("SELECT event_id, n <= 10 OR n % 10 = 0 AS sampled FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)")
def sample_marks(spark, sf):
    return ordering.sampled(read_table(spark, sf, "events").select("event_id"), 10, ["event_id"])


# --- pipelines and lineage --------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'DeadLettered' ELSE 'Emitted' END AS outcome FROM orders""")
def lineage_outcomes(spark, sf):
    o = lineage.start(read_table(spark, sf, "orders"), "orders", ["o_orderkey"])
    rule = rules.Rule("price", F.col("o_totalprice") <= 150000, "o_totalprice")
    return lineage.outcomes(o, "price check", [rule], rules.TO_DEAD_LETTERS).select("o_orderkey", F.col("_outcome").alias("outcome"))


@query("""
SELECT n_name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def graph_pipeline(spark, sf):
    found = []
    p = Pipeline().source("customers", lambda c: read_table(c.spark, sf, "customer")).source("nations", lambda c: read_table(c.spark, sf, "nation"))
    p.transform("solvent", lambda df: rules.apply_rules(df, [rules.filter_rule(F.col("c_acctbal") > 0)], rules.SKIP_REFUSED)[0])
    p.join("named", lambda a, b: joins.equi_join(a.withColumnRenamed("c_nationkey", "n_nationkey"), b, ["n_nationkey"]))
    p.transform("totals", lambda df: aggregates.aggregate(df, ["n_name"], n=F.count("*"), balance=aggregates.exact_sum("c_acctbal"))).sink("out", found.append)
    p.connect("customers", "solvent", "named", "totals", "out").connect("nations", "named").build().run(Context(spark))
    return found[0]


@query("SELECT c_custkey, upper(trim(c_name)) AS c_name, greatest(c_acctbal, 0) AS c_acctbal FROM customer")
def property_steps(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return transforms.composite(c, lambda df: transforms.set_properties(df, [("c_name", strings.trim), ("c_name", strings.to_upper), ("c_acctbal", lambda x: numbers.at_least(x, 0.0))]))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, 'len ' || length(event_type) AS note FROM events WHERE length(event_type) > 4")
def ai_route_events(spark, sf):
    """The model is a stand-in that needs no network."""
    model = lambda prompts: [{"note": f"len {len(p)}", "size": len(p)} for p in prompts]
    router = routing.Router(routing.FIRST_MATCH).when("long", F.col("size") > 4)
    return ai.ai_route(read_table(spark, sf, "events").select("event_id", "event_type"), "event_type", model, "note string, size int", router)["long"].select("event_id", "note")


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def interleave_merge(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return routing.interleave(c, read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")))


@query("SELECT mine AS bucket, count(*) AS n FROM (SELECT unnest([o_orderkey % 7, 100 + o_orderkey % 3]) AS mine FROM orders) GROUP BY 1")
def custom_windows(spark, sf):
    """A window assigner of one's own: each row names its windows."""
    o = read_table(spark, sf, "orders").select(F.explode(F.array(F.col("o_orderkey") % 7, 100 + F.col("o_orderkey") % 3)).alias("bucket"))
    return aggregates.aggregate(o, ["bucket"], n=F.count("*"))


@query("SELECT count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders")
def tap_totals(spark, sf):
    tapped, seen = transforms.tap(read_table(spark, sf, "orders"), "orders", rows=F.count(F.lit(1)), total=aggregates.exact_sum("o_totalprice"))
    tapped.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["total"])], "rows long, total double")


# --- sources and sinks --------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    at = shared_folder(spark)
    files.write_csv(read_table(spark, sf, "customer"), f"{at}/csv", "overwrite")
    return files.read_csv(spark, f"{at}/csv", "C_MKTSEGMENT string, c_custkey long, c_name string, c_acctbal double").withColumnRenamed("C_MKTSEGMENT", "c_mktsegment")


@query("SELECT event_id AS eventId, user_id AS userId, value FROM events")
def json_round_trip(spark, sf):
    at = shared_folder(spark)
    files.write_json(read_table(spark, sf, "events").select("event_id", "user_id", "value"), f"{at}/json", "overwrite", naming="camel")
    return files.read_json(spark, f"{at}/json", "eventId long, userId long, value double", lines=True)


def _lake(spark, sf) -> tuple[LakeTable, list[str]]:
    """Orders by status in two snapshots an hour apart."""
    table = LakeTable(spark, f"{shared_folder(spark)}/orders", ["o_orderstatus"])
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return table, [table.append(orders.where(f"o_orderkey % 3 {test} 0"), now=at + i * HOUR) for i, test in enumerate(("=", "<>"))]


@query("SELECT 'all' AS state, o_orderkey FROM orders UNION ALL SELECT 'before', o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'second', o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def lake_time_travel(spark, sf):
    table, (_, second) = _lake(spark, sf)
    states = {"all": table.read(), "before": table.read(as_of=datetime(2024, 1, 1, 0, 30)), "second": table.read(snapshot=second)}
    return routing.concatenate(*[df.select(F.lit(n).alias("state"), "o_orderkey") for n, df in states.items()])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def lake_upsert_and_compact(spark, sf):
    table, _ = _lake(spark, sf)
    changed = read_table(spark, sf, "orders").where("o_orderkey % 10 = 0").select("o_orderkey", "o_orderstatus", F.lit(0.0).alias("o_totalprice"))
    table.upsert(changed, ["o_orderkey"], "o_orderkey")
    table.compact(at_least=1)
    return table.read().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100")
def resume_from_checkpoint(spark, sf):
    saved = checkpoints.Checkpoints(spark, shared_folder(spark))
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    _, top = checkpoints.read_new(orders.where("o_orderkey <= 100"), "o_orderkey", saved, "orders")
    saved.save("orders", top)
    return checkpoints.read_new(orders, "o_orderkey", saved, "orders")[0]


# --- streams ------------------------------------------------------------------------------------------


def _stream(spark, sf, make) -> tuple[DataFrame, str]:
    """The events as a stream of files, and a folder for its checkpoint."""
    at = shared_folder(spark)
    events = read_table(spark, sf, "events")
    events.repartition(3, "user_id").write.parquet(f"{at}/in")
    return make(streams.read_files(spark, f"{at}/in", events.schema)), at


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, {_SUM} AS total FROM events GROUP BY 1, 2")
def stream_hourly_totals(spark, sf):
    measures = {"n": F.count("*"), "total": aggregates.exact_sum("value")}
    out, at = _stream(spark, sf, lambda s: streams.windowed_aggregate(s, "ts", HOUR, ["event_type"], measures, delay=60 * DAY))
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{at}/out")
    streams.write_batches(out, write, f"{at}/checkpoint", mode="complete").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(clock("window_start").alias("window_start"), "event_type", "n", "total")


@query("SELECT event_id, value > 5 AS kept FROM events")
def stream_dead_letters(spark, sf):
    source, at = _stream(spark, sf, lambda s: s)
    save = lambda name: lambda df, i: df.select("event_id").write.mode("append").parquet(f"{at}/{name}")
    sink = streams.with_dead_letters([rules.Rule("value", F.col("value") > 5, "value")], rules.TO_DEAD_LETTERS, save("good"), save("dead"))
    streams.write_batches(source, sink, f"{at}/checkpoint").awaitTermination()
    return routing.concatenate(*[spark.read.parquet(f"{at}/{n}").withColumn("kept", F.lit(n == "good")) for n in ("good", "dead")])


@query("""
WITH o AS (SELECT o_orderkey, left(sha256('orders' || chr(31) || o_orderkey), 32) AS _lineage_id FROM orders)
SELECT o_orderkey, _lineage_id FROM o WHERE CAST('0x' || left(md5(_lineage_id), 15) AS BIGINT) % 10 = 0""")
def lineage_sample(spark, sf):
    """About one in ten ids, always the same ones."""
    o = lineage.start(read_table(spark, sf, "orders"), "orders", ["o_orderkey"])
    return o.where(lineage.sampled(F.col(lineage.ID), 10)).select("o_orderkey", lineage.ID)


from . import more_queries  # noqa: E402, F401  registers its queries here

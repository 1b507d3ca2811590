import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregates, ai, enrich, joins, ordering, routing, rules, transforms, windows
from tidemill.plans import lineage, metrics, resilience
from tidemill.plans.pipeline import Context, GraphError, Pipeline


def test_rules_and_policies(spark):
    df = spark.createDataFrame([(1, "a"), (-1, ""), (2, None)], "n int, s string")
    checks = [rules.Rule("positive", F.col("n") > 0, "n"), rules.Rule("text", F.col("s") != "", "s", "No text.")]
    good, bad = rules.split(df, checks)
    assert [r.n for r in good.collect()] == [1]
    assert {(r.n, r.rule, r.value, r.message) for r in bad.collect()} == {(-1, "positive", "-1", "Validation failed for rule 'positive'."), (2, "text", None, "No text.")}
    kept, dead = rules.apply_rules(df, checks, rules.SKIP_REFUSED)
    assert kept.count() == 1 and dead.count() == 0
    kept, dead = rules.apply_rules(df, checks, rules.TO_DEAD_LETTERS)
    assert kept.count() == 1 and dead.count() == 2
    for n, rule in ((-1, "positive"), (2, "text")):  # one row that breaks a rule: which of several stops the job first is open
        with pytest.raises(Exception, match=f"rule broken: {rule}"):
            rules.apply_rules(df.where(F.col("n") == n), checks)[0].collect()
    assert rules.apply_rules(df, [])[0].count() == 3


def test_policies_lose_no_rows_in_silence(spark):
    df = spark.createDataFrame([(1,), (-1,), (2,)], "n int")
    checks = [rules.Rule("positive", F.col("n") > 0, "n")]
    for wrong in ("dead-letter", "ignore", None):
        with pytest.raises(ValueError, match="unknown actions"):
            rules.Policy({"validation": wrong})
        with pytest.raises(ValueError, match="unknown actions"):
            rules.Policy().on("validation", wrong)
    with pytest.raises(ValueError, match="unknown actions"):
        rules.Policy(otherwise="retry twice")
    with pytest.raises(ValueError, match="can't be retried"):
        rules.apply_rules(df, checks, rules.Policy({"validation": rules.RETRY}))
    for action in (rules.SKIP, rules.DEAD_LETTER):
        kept, dead = rules.apply_rules(df, checks, rules.Policy({"validation": action}))
        assert kept.count() + dead.count() == (2 if action == rules.SKIP else 3)


def dictionaries(left, right, how, capacity=None):
    """The one-to-one join as two dictionaries."""
    wait_l, wait_r, out = {}, {}, []
    for k, v in left:
        if k not in wait_l and (capacity is None or len(wait_l) < capacity):
            wait_l[k] = v
    for k, v in right:
        if k in wait_l:
            out.append((k, wait_l.pop(k), v))
        elif k not in wait_r and (capacity is None or len(wait_r) < capacity):
            wait_r[k] = v
    if how in ("left", "full"):
        out += [(k, v, None) for k, v in wait_l.items()]
    if how in ("right", "full"):
        out += [(k, None, v) for k, v in wait_r.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("capacity", [None, 1, 2])
def test_keyed_join_is_the_dictionary_algorithm(spark, how, capacity):
    rng = random.Random(f"{how}{capacity}")
    cases = [([(1, "a"), (1, "b"), (2, "c"), (4, "d")], [(1, "x"), (1, "y"), (3, "z"), (3, "w")])]
    cases += [tuple([(rng.randint(0, 5), f"{s}{i}") for i in range(rng.randint(0, 12))] for s in "lr") for _ in range(2)]
    for left, right in cases:
        l = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(left)], "k int, i int, v string")  # noqa: E741
        r = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(right)], "k int, i int, v string")
        got = joins.keyed_join(l, r, ["k"], ["i"], ["i"], how, capacity)
        got = sorted(((x.k, x.l and x.l.v, x.r and x.r.v) for x in got.collect()), key=str)
        assert got == dictionaries(left, right, how, capacity), (left, right)


def test_keyed_join_leaves_null_keys_out(spark):
    l = spark.createDataFrame([(None, 1), (1, 2)], "k int, i int")  # noqa: E741
    assert [x.k for x in joins.keyed_join(l, l, ["k"], ["i"], ["i"], "full").collect()] == [1]


def test_self_join_pairs(spark):
    l = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d")], "k int, v string")  # noqa: E741
    r = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "w")], "k int, v string")
    pairs = lambda how: {(x.l and x.l.v, x.r and x.r.v) for x in joins.self_join(l, "k", how=how, other=r).collect()}
    assert pairs("inner") == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}
    assert pairs("full") == pairs("inner") | {("c", None), ("d", None), (None, "z"), (None, "w")}


def test_windowed_join_emits_once_per_shared_window(spark):
    l = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 6))], "k string, t timestamp")  # noqa: E741
    r = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 7))], "k string, t timestamp")
    ten, five = timedelta(minutes=10), timedelta(minutes=5)
    assert joins.windowed_join(l, r, ["k"], "t", "t", ten, five).count() == 2
    assert joins.windowed_join(l, r, ["k"], "t", "t", ten).count() == 1


def test_lookup_and_enrich(spark):
    df = spark.createDataFrame([(1, "old", 0), (2, "old", 5), (3, None, 0)], "k int, v string, n int")
    dim = spark.createDataFrame([(1, "new"), (1, "newer"), (2, None)], "k int, v string")
    got = {r.k: (r.v, r.hit) for r in joins.lookup(df, dim, "k", "k", {"v": "v"}, hit="hit").collect()}
    assert got == {1: ("new", True), 2: (None, True), 3: (None, False)}
    kept = {r.k: r.v for r in enrich.Enricher().lookup("v", "k", dim, "k", "v").apply(df).collect()}
    assert kept == {1: "new", 2: None, 3: None}
    out = enrich.Enricher().set("n", "k", dim.withColumn("n", F.lit(9)), "k", "n").default_if_zero("n", 7).default_if_blank("v", "-").apply(df)
    assert {r.k: (r.v, r.n) for r in out.collect()} == {1: ("old", 9), 2: ("old", 9), 3: ("-", 7)}
    assert [r[0] for r in df.select(joins.lookup_map("k", {1: "x"})).collect()] == ["x", None, None]


def test_windows(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 6),), (datetime(2024, 1, 1, 0, 10),)], "t timestamp")
    got = [r[0] for r in df.select(windows.windows_of(F.col("t"), timedelta(minutes=10), timedelta(minutes=5))).collect()]
    assert got[0] == [datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1)]
    assert got[1] == [datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 1, 0, 5)]
    week = spark.createDataFrame([(datetime(2024, 1, 3),)], "t timestamp").select(windows.spark_window(F.col("t"), timedelta(days=7)).alias("w")).first().w
    assert week.start == datetime(2024, 1, 1)
    gap = df.select(windows.windows_of(F.col("t"), timedelta(minutes=2), timedelta(minutes=5))).collect()
    assert [len(r[0]) for r in gap] == [1, 1]


def test_late_rows(spark):
    times = [(0, 10, 0), (1, 10, 10), (2, 10, 5), (3, 10, 3)]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1, h, m)) for i, h, m in times], "i int, t timestamp")
    for keys in ([], ["k"]):
        marked = ordering.late_marks(df.withColumn("k", F.lit(1)), "t", ["i"], 5 * 60_000_000, keys)
        assert [r.late for r in marked.orderBy("i").collect()] == [False, False, False, True]


def test_routing(spark):
    df = spark.createDataFrame([(102,), (101,), (4,), (3,)], "x int")
    make = lambda mode, **o: routing.Router(mode, **o).when("big", F.col("x") > 100).when("even", F.col("x") % 2 == 0)
    got = lambda r: sorted((x.x, x.route) for x in r.route(df).collect())
    assert got(make("first", otherwise="rest")) == [(3, "rest"), (4, "even"), (101, "big"), (102, "big")]
    assert got(make("all", otherwise="rest")) == [(3, "rest"), (4, "even"), (101, "big"), (102, "big"), (102, "even")]
    assert got(make("all")) == [(4, "even"), (101, "big"), (102, "big"), (102, "even")]
    with pytest.raises(Exception, match="no route"):
        make("first", no_match="throw").route(df).collect()
    with pytest.raises(ValueError):
        make("first").when("big", F.lit(True))
    parts = make("first", otherwise="rest").split(df)
    assert {k: v.count() for k, v in parts.items()} == {"big": 2, "even": 1, "rest": 1}


def test_merge_and_branch(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v, r.s) for r in routing.concatenate(a, b, index="s").collect()) == [(1, "a", 0), (1, "b", 1), (2, "b", 1)]
    assert sorted((r.k, r.v) for r in routing.priority_merge(["k"], ["v"], a, b).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        routing.interleave(a, a.withColumn("k", F.lit("x")))
    seen = []
    assert routing.branch(a, [lambda df: seen.append(df.count())]) is a and seen == [1]
    with pytest.raises(ExceptionGroup):
        routing.branch(a, [lambda df: 1 / 0])
    said = []
    routing.branch(a, [lambda df: 1 / 0], routing.LOG_AND_CONTINUE, said.append)
    assert len(said) == 1
    routing.branch(a, [lambda df: 1 / 0, lambda df: df.count()], lambda e, df: said.append((type(e), df)))
    assert said[1] == (ZeroDivisionError, a)


def test_batches(spark):
    df = spark.range(7).toDF("i")
    b = ordering.batches(df, 3, ["i"])
    assert sorted(r.n for r in b.collect()) == [1, 3, 3]
    assert [r.i for r in ordering.unbatch(b).orderBy("batch", "position").collect()] == list(range(7))
    assert ordering.batches(df.limit(0), 3, ["i"]).count() == 0
    with pytest.raises(ValueError):
        ordering.batches(df, 0, ["i"])
    assert [r.n for r in ordering.numbered(spark.range(100).toDF("i"), ["i"], "n").orderBy("i").collect()] == list(range(1, 101))


def test_transforms_and_aggregates(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 4)], "g int, o int, v int")
    folded = transforms.fold(["g"], "o", "v", F.lit(0), lambda a, x: a * 10 + x)(df)
    assert {r.g: r.result for r in folded.collect()} == {1: 23, 2: 4}
    tapped, seen = transforms.tap(df, "t")
    tapped.collect()
    assert seen.get == {"rows": 3}
    assert transforms.set_properties(df, [("v", lambda c: c + 1), ("v", lambda c: c * 2)]).agg(F.sum("v")).first()[0] == 24
    top = aggregates.top_k(df, ["g"], [F.desc("v")], 1)
    assert {(r.g, r.v) for r in top.collect()} == {(1, 3), (2, 4)}
    assert transforms.opaque(df, lambda frames: (f[f.v > 2] for f in frames), df.schema).count() == 2


def test_ai(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "p string")
    model = lambda prompts: [{"n": len(p)} for p in prompts]
    assert sorted((r.p, r.n) for r in ai.ai_enrich(df, "p", model, "n int").collect()) == [("a", 1), ("bb", 2)]
    assert sorted(r.n for r in ai.ai_transform(df, "p", model, "n int").collect()) == [1, 2]
    parts = ai.ai_route(df, "p", model, "n int", routing.Router(otherwise="rest").when("long", F.col("n") > 1))
    assert parts["long"].count() == 1
    with pytest.raises(ValueError):
        ai.ask(lambda p: [], ["x"])


def test_pipeline_graph(spark):
    found = []
    p = Pipeline().source("a", lambda c: c.spark.range(c.parameters["n"])).route("r", routing.Router(otherwise="odd").when("even", F.col("id") % 2 == 0))
    p.sink("evens", lambda df: found.append(df.count())).sink("odds", lambda df: df.count())
    p.connect("a", "r").connect("r", "evens", port="even").connect("r", "odds", port="odd")
    graph = p.build()
    assert graph.run(Context(spark, {"n": 5})) == {"evens": None, "odds": 2} and found == [3]
    assert "r{r}" in graph.mermaid() and "r (route)" in graph.describe()
    bad = Pipeline().source("a", lambda c: None).transform("b", lambda d: d).transform("b", lambda d: d).connect("a", "x").connect("b", "b")
    with pytest.raises(GraphError) as e:
        bad.build()
    assert len(e.value.problems) >= 4
    loop = Pipeline().source("s", None).transform("a", None).transform("b", None).sink("o", None).connect("s", "a", "b", "a").connect("b", "o")
    with pytest.raises(GraphError, match="loop"):
        loop.build()


def test_resilience():
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert resilience.retry(work, 3, resilience.exponential(1, 2), sleep=waits.append) == "done" and waits == [1, 2]
    now = [0.0]
    c = resilience.CircuitBreaker(failures=2, open_s=10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            c.call(lambda: 1 / 0)
    with pytest.raises(resilience.CircuitOpen):
        c.call(lambda: 1)
    now[0] = 11
    assert c.call(lambda: 1) == 1 and c.state == "closed"
    for kind in ("full", "equal", "decorrelated", "none"):
        assert 0 <= resilience.Jitter(kind, seed=1)(4.0) <= 12


def test_lineage_and_metrics(spark):
    df = lineage.start(spark.range(10).toDF("i"), "src", ["i"])
    checks = [rules.Rule("small", F.col("i") < 6), rules.filter_rule(F.col("i") != 3)]
    got = lineage.outcomes(df, "n", checks, rules.Policy({"validation": rules.DEAD_LETTER, "filter": rules.SKIP})).groupBy("_outcome").count().collect()
    assert {r._outcome: r["count"] for r in got} == {"Emitted": 5, "DeadLettered": 4, "FilteredOut": 1}
    twice = lineage.start(spark.createDataFrame([(1, 5), (1, 50)], "k int, v int"), "src", ["k"])  # two rows of one key
    got = lineage.outcomes(twice, "n", [rules.Rule("small", F.col("v") < 9)], rules.TO_DEAD_LETTERS).select("v", "_outcome")
    assert {r.v: r._outcome for r in got.collect()} == {5: "Emitted", 50: "DeadLettered"}
    assert {r._outcome for r in lineage.outcomes(twice, "n", [rules.Rule("small", F.col("v") < 0)], rules.Policy()).collect()} == {"Error"}
    hops = lineage.exploded(df, df.where("i > 2").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), "twice")
    assert sorted((r.hop.outcome, r.hop.took_in, r.hop.gave) for r in hops.collect()) == [("ConsumedWithoutEmission", 1, 0)] * 3 + [("Emitted", 1, 2)] * 7
    with pytest.raises(ValueError):
        lineage.hop("n", "Emitted", "2:3")
    m = metrics.Metrics()
    m.timed("half", lambda: m.node("half", lambda d: d.where("i < 5"))(spark.range(10).toDF("i")).collect())
    got = m.report()["half"]
    assert got["processed"] == 10 and got["emitted"] == 5 and got["retries"] == 0 and got["rows_per_second"] > 0
    assert m.totals()["processed"] == 10 and m.totals()["seconds"] == m.durations["half"]


def test_per_item(spark):
    df = spark.createDataFrame([(1,), (0,), (2,)], "x int")
    inverse = lambda r: {"y": 1 / r["x"]}
    assert sorted(r.y for r in transforms.per_item(df, inverse, "y double", on_error="skip").collect()) == [0.5, 1.0]
    out = transforms.per_item(df, inverse, "y double", retries=1, on_error="dead_letter")
    assert sorted((r.y or 0, r._item) for r in out.collect()) == [(0, '{"x": 0}'), (0.5, None), (1.0, None)]
    assert "ZeroDivisionError" in transforms.dead_letters(out.where("_error is not null"))[0]["_error"]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        transforms.per_item(df, inverse, "y double").collect()


def test_per_item_by_policy(spark):
    df = spark.createDataFrame([(1,), (0,), (2,)], "x int")

    def work(row, tries={}):  # noqa: B006
        tries[row["x"]] = tries.get(row["x"], 0) + 1
        if row["x"] == 2 and tries[2] < 3:
            raise TimeoutError("busy")
        return {"y": 1 / row["x"]}

    policy = rules.Policy({"TimeoutError": rules.RETRY, "ArithmeticError": rules.SKIP})
    began = time.monotonic()
    done = transforms.per_item(df.coalesce(1), work, "y double", 2, policy=policy, backoff=resilience.fixed(0.3), jitter=resilience.Jitter("none"))
    assert sorted(r.y for r in done.collect()) == [0.5, 1.0] and time.monotonic() - began >= 0.6
    with pytest.raises(Exception, match="TimeoutError"):  # too few tries
        transforms.per_item(df.coalesce(1), lambda r: (_ for _ in ()).throw(TimeoutError("busy")), "y double", 1, policy=policy).collect()
    with pytest.raises(Exception, match="ZeroDivisionError"):  # not named: fail
        transforms.per_item(df, lambda r: {"y": 1 / r["x"]}, "y double", policy=rules.Policy({"TimeoutError": rules.RETRY})).collect()
    letters = transforms.per_item(df, lambda r: {"y": 1 / r["x"]}, "y double", policy=rules.Policy(otherwise=rules.DEAD_LETTER))
    assert letters.where("_error is not null").count() == 1


def test_nodes_that_fail_while_they_run(spark):
    broken = lambda: spark.range(3).withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    assert resilience.or_empty(broken, "id long, x int", spark).collect() == []
    assert resilience.or_empty(lambda: spark.range(3), "id long", spark).count() == 3
    runs = []

    def twice():
        runs.append(1)
        return broken() if len(runs) < 3 else spark.range(2)

    assert resilience.restarted(twice, 2).count() == 2 and len(runs) == 3
    with pytest.raises(Exception, match="broken"):
        resilience.restarted(broken, 1)
    p = lambda **how: Pipeline().source("s", lambda c: c.spark.range(2)).transform("t", lambda df: broken(), **how).sink("o", lambda df: df.count()).connect("s", "t", "o").build()
    assert p(or_schema="id long, x int").run(Context(spark)) == {"o": 0}
    with pytest.raises(Exception, match="broken"):
        p(restarts=1).run(Context(spark))


def test_a_source_of_several_nodes_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    p = Pipeline().source("s", lambda c: c.spark.range(10).mapInPandas(count, "id long"))
    for n in "abc":
        p.sink(n, lambda df: df.agg(F.sum("id")).first()[0]).connect("s", n)
    assert p.build().run(Context(spark)) == {"a": 45, "b": 45, "c": 45} and seen.value == 10


def test_lint():
    from tidemill.plans import lint

    assert lint.check_resumable("SELECT * FROM t") and lint.check_resumable("SELECT * FROM (SELECT * FROM t ORDER BY a)")
    assert lint.check_resumable("SELECT * FROM t ORDER BY t.a, b DESC LIMIT 5", ("B",)) == [] and lint.check_resumable("SELECT * FROM t ORDER BY a", ("id",))
    p = Pipeline().source("s", None).transform("t", None, or_schema="x int").transform("idle", None).sink("o", None).connect("s", "t", "o").connect("s", "idle").build()
    assert len(lint.check_graph(p)) == 3


def test_timed_batches(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(i, t(m)) for i, m in enumerate([0, 1, 2, 3, 11, 12, 21])], "i int, t timestamp")
    got = ordering.timed_batches(df, 3, timedelta(minutes=10), "t", ["i"]).collect()
    assert sorted([x.i for x in r["items"]] for r in got) == [[0, 1, 2], [3], [4, 5], [6]]


def test_exact_percentile_of_many_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), None if rng.random() < 0.1 else rng.randint(0, 9) / 2) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v double")
    for p in (0.0, 0.37, 0.5, 1.0):
        want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", p).alias("p")).collect()}
        got = {r.k: r.percentile for r in aggregates.exact_percentile(df, ["k"], "v", p).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_testing_kit(spark):
    from tidemill import testing

    out = testing.Capture()
    p = Pipeline().source("s", testing.memory_source([(1,), (2,)], "x int")).transform("t", lambda d: d.where("x > 1")).sink("o", out).connect("s", "t", "o")
    testing.run(p, Context(spark))
    assert out.rows == [(2,)]
    testing.assert_rows(spark.range(2), [(1,), (0,)])
    with pytest.raises(AssertionError):
        testing.assert_rows(spark.range(2), [(1,), (1,)])

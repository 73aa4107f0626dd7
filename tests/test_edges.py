"""State, pages, rules and analytics on small rows: nulls, ties, empty tables, names that clash."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import analytics, graph, paging, rules, state, tables, validation


def test_update_log(spark):
    log = [("a", 1, "state.n", "increment", None, None), ("a", 2, "state.n", "set", 5.0, None), ("a", 3, "state.n", "increment", 2.0, None), ("a", 4, "state.m", "merge", 1.0, "x"), ("a", 5, "state.m", "merge", 2.0, "x"), ("b", 6, "state.l", "append", 1.0, None)]
    rows = spark.createDataFrame([(k, i, p, op, f, n, None) for k, i, p, op, n, f in log], "key string, i int, path string, op string, field string, number double, text string")
    got = {(r.key, r.path, r.field): (r.number, r["items"]) for r in state.fold_updates(rows, "key", ["i"]).collect()}
    assert got == {("a", "state.n", None): (7.0, 0), ("a", "state.m", "x"): (2.0, 0), ("b", "state.l", None): (None, 1)}
    sets = state.fold_updates(rows.where("path = 'state.m'"), "key", ["i"], merge_as_set=True).collect()
    assert [(r.field, r.number) for r in sets] == [(None, 2.0)]
    assert state.fold_updates(rows.limit(0), "key", ["i"]).count() == 0
    paths = spark.createDataFrame([("state.a",), ("raw.a.b",), ("computed.a",), ("a",), ("state.",), (None,)], "p string")
    assert [r[0] for r in paths.select(state.writable(F.col("p"))).collect()] == [True, True, False, False, False, None]


def test_versions_in_order(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, None), ("b", 1, 1)], "k string, i int, e int")
    got = {(r.k, r.i): (r.accepted, r.version) for r in state.accepted_updates(rows, "k", ["i"], "e").collect()}
    assert got == {("a", 1): (True, 1), ("a", 2): (False, 1), ("a", 3): (True, 2), ("a", 4): (True, 3), ("b", 1): (False, 0)}


def test_pages_never_pass_their_budget(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 200, 5, 5, 5, 1, 90])], "s string, i int, chars int")
    got = {r.i: r.page for r in paging.pages(rows, "s", ["i"], "chars", 10).collect()}
    room = paging.most_chars(10)
    assert int(room / 3.5 * 1.1) == 10 and int((room + 1) / 3.5 * 1.1) > 10
    for page in set(got.values()):
        own = [n for i, n in enumerate([5, 200, 5, 5, 5, 1, 90]) if got[i] == page]
        assert len(own) == 1 or sum(own) + len(own) - 1 + 12 <= room
    assert sorted(got.values()) == [got[i] for i in range(7)]
    assert [r.i for r in paging.page_after(rows, "i", "chars", 10, cursor=0).collect()] == [1]
    assert [r.i for r in paging.page_after(rows, "i", "chars", 10, cursor=99).collect()][0] == 0
    assert paging.page_after(rows.limit(0), "i", "chars", 10).count() == 0


def test_pages_by_jumps_are_the_same(spark):
    import random

    r = random.Random(2)
    rows = [(k, i, r.choice([1, 5, 30, 70, 400]), "x") for k in ("a", "b", None) for i in range(120)] + [("one", 0, 999, "x"), ("two", 0, 1, "x"), ("two", 1, 1, "x")]
    frame = spark.createDataFrame(rows, "s string, i int, chars int, before string").repartition(5)
    shown = lambda f: sorted(map(str, f.collect()))
    for budget in (10, 40, 2000):
        streamed = paging.pages(frame, "s", ["i"], "chars", budget)
        assert shown(paging.pages_by_jumps(frame, "s", ["i"], "chars", budget)) == shown(streamed)
        assert shown(paging.pages(frame, "s", ["i"], "chars", budget, most=50)) == shown(streamed)
    assert paging.pages_by_jumps(frame.limit(0), "s", ["i"], "chars", 10).count() == 0


def test_orders_in_two_levels(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in ("a", None) for v in [3, 1, 2, 2, 9]] + [("b", None)], "k string, v double")
    at = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}
    got = {r.k: (r.low, r.mid, r.high) for r in tables.order_statistics(rows, "k", "v", at).collect()}
    assert got == {"a": (1.0, 2.0, 9.0), None: (1.0, 2.0, 9.0)}
    numbered = spark.createDataFrame([(k, i, i, "x") for k in ("a", None) for i in range(50)], "k string, i int, n int, base string")
    got = tables.running_total(numbered, "k", [F.col("i")], F.col("n"), "before").collect()
    assert all(r.before == sum(range(r.i)) for r in got) and len(got) == 100


def test_groups_by_budget(spark):
    groups = spark.createDataFrame([("s", 1, "individual", 1, 50), ("s", 2, "individual", 1, 60), ("s", 3, "pattern_group", 4, 80), ("s", 4, "individual", 1, 1)], "s string, i int, kind string, rules long, tokens long")
    got = [(r.i, r.taken_rules, r.taken_tokens, r.partial) for r in rules.fit_groups(groups, "s", ["i"], 100).orderBy("i").collect()]
    assert got == [(1, 1, 50, False), (3, 2, 40, True)]
    assert rules.fit_groups(groups.limit(0), "s", ["i"], 100).count() == 0


def test_values_by_kind(spark):
    rows = spark.createDataFrame([(1, 1.0, "1", True, None), (0, float("nan"), " ", False, None)], "i int, f double, t string, b boolean, n string")
    v = {c: X.Value.of(rows, c) for c in rows.columns}
    null = X.Value.literal(None)
    got = rows.select(
        X.loose_equals(v["i"], v["t"]).alias("a"), X.loose_equals(v["b"], v["i"]).alias("b"), X.strict_equals(v["i"], v["f"]).alias("c"), X.loose_equals(v["n"], null).alias("d"), X.loose_equals(v["f"], v["f"]).alias("e"),
        X.plus(v["b"], v["t"]).alias("f"), X.compare(v["n"], "<", v["i"]).alias("g"), X.truthy(v["t"]).alias("h"),
    ).collect()
    assert tuple(got[0]) == (True, True, False, True, True, "True1", True, True)
    assert tuple(got[1]) == (False, True, False, True, False, "False ", False, True)
    with pytest.raises(ValueError, match="separator"):
        X.split_text(F.col("t"), "")
    with pytest.raises(Exception, match="modulo"):
        rows.select(X.modulo(F.col("i"), F.lit(0))).collect()


def test_loops_and_guards(spark):
    rows = spark.createDataFrame([(1, 7), (2, 0), (3, None)], "id int, n int")
    got = {r.id: (r.n, r.iterations) for r in state.while_loop(rows, F.col("n") > 0, lambda r: r.withColumn("n", F.col("n") - 2), settle_every=2).collect()}
    assert got == {1: (-1, 4), 2: (0, 0), 3: (None, 0)}
    capped = state.while_loop(rows, F.col("n") > -99, lambda r: r.withColumn("n", F.col("n") - 1), most=3).collect()
    assert {r.id: r.iterations for r in capped} == {1: 3, 2: 3, 3: 0}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {(r.src, r.dst) for r in graph.closure(edges).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")}
    assert graph.closure(edges.limit(0)).count() == 0
    choice = spark.createDataFrame([("2",), ("9",), (None,), ("blue",)], "t string").select(validation.converted_input(F.col("t"), "choice", ("red", "blue"))).collect()
    assert [r[0] for r in choice] == ["blue", None, None, "blue"]


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "k string, ts timestamp, v double")
    assert analytics.error_summary(none, "ts", F.lit("low"), F.col("k")).count() == 0
    assert analytics.state_sizes(none, "k", ["ts"], "v").count() == 0
    assert analytics.agent_states(none, "k", "ts", F.lit(False), 5).count() == 0
    assert analytics.health(none, "k", "ts", F.lit(False)).count() == 0

"""Expression semantics and templates on small rows, nulls and odd values among them."""

import math

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.templates import render, shortened
from tessera.operators import reliability, retrieval


def test_numbers(spark):
    rows = spark.createDataFrame([("12", 2.0), ("", 0.0), (None, 5.0), ("x", 1.0)], "s string, v double")
    odd = spark.createDataFrame([(x,) for x in ("1e3", "1d", "\t", " 7\n", "1.5e2", ".5", "1_000", "-3.", "inf")], "s string").select(X.to_number(F.col("s")).alias("n")).collect()
    assert [None if math.isnan(r.n) else r.n for r in odd] == [None, None, 0.0, 7.0, 150.0, 0.5, 1000.0, -3.0, None]
    assert rows.select(X.less(F.lit(None).cast("double"), F.lit(1)).alias("x")).first().x is True
    got = rows.select(X.to_number(F.col("s")).alias("n"), X.less(F.col("v"), X.to_number(F.col("s"))).alias("less"), X.divide(X.to_number(F.col("s")), F.col("v")).alias("q")).collect()
    assert [r.n for r in got[:3]] == [12.0, 0.0, 0.0] and math.isnan(got[3].n)
    assert [r.less for r in got] == [True, False, False, False]
    assert [r.q for r in got[:3]] == [6.0, -math.inf, 0.0] and math.isnan(got[3].q)


def test_slices(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), ([],)], "w array<string>")
    cases = [(1, None, ["b", "c"]), (-2, None, ["b", "c"]), (0, -1, ["a", "b"]), (2, 1, []), (9, None, [])]
    for start, end, want in cases:
        assert [r.x for r in rows.select(X.sliced(F.col("w"), start, end).alias("x")).collect()] == [want, []]


def test_templates(spark):
    rows = spark.createDataFrame([("Ann", 3), (None, 4)], "name string, n int")
    fields = {"name": F.col("name"), "n": F.col("n")}
    assert [r[0] for r in rows.select(render("{{ name }}: {{n}} {{x.y}}", fields)).collect()] == ["Ann: 3 <x.y>", "<name>: 4 <x.y>"]
    assert rows.select(render(" {{n}} ", fields).alias("n")).schema["n"].dataType.simpleString() == "int"
    assert rows.select(shortened(F.lit("a" * 101))).first()[0] == "a" * 97 + "..."


def test_circuit_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", i, kind) for i, kind in enumerate("eeseen")], "k string, i int, kind string")
    got = reliability.circuit_states(rows, "k", ["i"], F.col("kind") == "e", 2).orderBy("i").collect()
    assert [(r.failures, r.state) for r in got] == [(1, "closed"), (2, "open"), (0, "closed"), (1, "closed"), (2, "open"), (0, "closed")]
    none = rows.limit(0)
    assert reliability.circuit_states(none, "k", ["i"], F.col("kind") == "e", 2).count() == 0
    assert retrieval.budget_skip(none, "k", [F.col("i")], "i", 5).count() == 0
    assert reliability.nearest_percentiles(none, "k", "i", {"p": 0.5}).count() == 0


def test_nearest_percentiles_are_not_interpolated(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("a", None), ("b", 7.0)], "k string, v double")
    got = {r.k: (r.p50, r.p99) for r in reliability.nearest_percentiles(rows, "k", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (5.0, 9.0), "b": (7.0, 7.0)}

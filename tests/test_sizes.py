"""Steps that grow with their texts: no side of theirs is broadcast by a guess of its size, and costly values are computed once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, components, graph, metrics, paths
from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources import code, symbols, trees


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    """A folder with 1,003 parts of one brand."""
    rows = spark.range(1, 1004).select(F.col("id").alias("p_partkey"), F.lit("big red bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["module_graph", "conditional_paths", "after_classes"])
def test_nothing_is_broadcast(spark, parts, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, parts))


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that these modules settle."""
    seen = []
    for module in (graph, paths, components):
        kept = module.settled
        monkeypatch.setattr(module, "settled", lambda df, kept=kept: seen.append(plan(df)) or kept(df))
    return seen


@pytest.mark.parametrize(
    "run", [lambda e: graph.closure(e, sources=e.select("src")), lambda e: paths.cycles(e, 3), lambda e: components.component_summary(e)], ids=["closure", "cycles", "components"],
)
def test_no_round_broadcasts(spark, plans, run):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4)], "src long, dst long")
    found = run(edges)
    assert found.count() and len(plans) > 1 and not [p for p in [*plans, plan(found)] if "Broadcast" in p]


def test_module_edges_take_the_first_candidate(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/y",), ("a/y.ts",), ("a/z/index.ts",), ("a/z/index.js",), ("main.ts",)], "path string")
    rows = [("a/x.ts", 1, "named", m) for m in ("./y", "./z", "./x", "../main", "./none", "pkg", "./z/index")]
    found = spark.createDataFrame(rows, "file string, line_no int, kind string, module string")
    got = sorted(r.dst for r in code.module_edges(found, files, "path").collect())
    assert got == ["a/x.ts", "a/y", "a/z/index.ts", "main.ts"]


def test_hint_names_as_in_sql(spark, parts):
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{parts}/part.parquet/*.parquet'")
    want = con.execute(f"select name, id from ({ORACLES['hint_files']}) order by id").fetchall()
    assert [(r.name, r.id) for r in QUERIES["hint_files"](spark, parts).orderBy("id").collect()] == want


@pytest.mark.parametrize("make,times", [(code.definitions, 1), (code.calls, 1), (code.call_edges, 2), (code.imports, 1), (code.exports, 1), (trees.syntax_nodes, 1)], ids=lambda x: getattr(x, "__name__", x))
def test_tokens_are_computed_once(spark, make, times):
    files = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("function f() { g(); }"), "id").alias("text"))
    assert optimized(make(files, "path", "text")).count("regexp_extract_all(") == times


def test_references_compute_tokens_once(spark):
    files = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("class A extends B { run() { } }"), "id").alias("text"))
    assert optimized(code.references(files, "path", "text", "run")).count("regexp_extract_all(") == 1


def test_updated_edges_broadcast_no_table_of_files(spark, parts):
    assert "Broadcast" not in plan(QUERIES["incremental_edges"](spark, parts))


def test_totals_of_modes_are_exact(spark):
    # 0.1 + 0.2 + 0.3 is above 0.6 in doubles, and 6.41 / 6.4 = 1.0015625 is rounded up
    rows = [("a", "click", 0.6), *[("a", "view", v) for v in (0.1, 0.2, 0.3)], ("b", "click", 6.4), *[("b", "view", v) for v in (5.81, 0.3, 0.2, 0.1)], ("c", "click", 1e300), ("c", "view", 1e300), ("d", "click", 1e-15), ("d", "view", 2e-15)]
    events = spark.createDataFrame(rows, "user string, kind string, value double").coalesce(1)
    got = {r.user: (r.speedup, r.recommended) for r in analytics.compared_modes(events, "user", "kind", "click", "view", "value", "value").collect()}
    assert got == {"a": (1.0, "view"), "b": (1.001563, "click"), "c": (1.0, "view"), "d": (2.0, "click")}


def test_symbol_uses_cut_lines_once(spark):
    files = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("class A {}\nfunction g() { new A(); g(); }\n// g A").alias("text"))
    uses = symbols.symbol_uses(files, "path", "text")
    assert optimized(uses).count("regexp_extract_all(") == 1
    assert sorted({(r.name, r.kind, r.line_no, r.uses) for r in uses.collect()}) == [("A", "class", 1, 3), ("g", "function", 2, 3)]


def modes_of_sql(spark, folder, rows):
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    names = "user_id, speedup, time_saved, memory_overhead, recommended"
    want = con.execute(f"select {names} from ({ORACLES['execution_modes']}) order by 1").fetchall()
    return [tuple(r) for r in QUERIES["execution_modes"](spark, str(folder)).orderBy("user_id").select(*names.split(", ")).collect()], want


def test_modes_at_a_half_as_in_sql(spark, tmp_path):
    # 136.71 / 134.4 is 1.0171875, whose double product with a million is below 1017187.5
    pairs = [(136.71, 134.4), *[(a / 100, b / 100) for a in range(3, 4000, 97) for b in (640, 3200, 12800, 13440, 16000)]]
    got, want = modes_of_sql(spark, tmp_path, [(i, kind, v) for i, pair in enumerate(pairs) for kind, v in zip(("click", "view"), pair)])
    assert got == want and got[0][3] == 1.017187


def test_modes_without_a_total_are_left_out_as_in_sql(spark, tmp_path):
    rows = [(1, "click", 0.0), (1, "view", 2.0), (2, "click", 2.0), (2, "view", 0.0), (3, "click", 0.0), (3, "view", 0.0), (4, "click", 4.0), (4, "view", 1.0), (4, "view", 0.0), (5, "click", None), (5, "view", 1.0), (6, "view", 1.0)]
    got, want = modes_of_sql(spark, tmp_path, rows)
    assert got == want == [(4, 0.25, -3.0, 4.0, "view")]


def test_totals_of_modes_are_summed_as_in_sql(spark, tmp_path):
    # in doubles 0.1 + 0.2 + 0.3 is above 0.6 and 0.3 + 0.2 + 0.1 isn't
    rows = [(u, "view", v) for u, vs in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for v in vs] + [(1, "click", 0.6), (2, "click", 0.6), (3, "click", 0.3), (3, "view", 0.1), (3, "view", None), (3, "view", 0.2)]
    got, want = modes_of_sql(spark, tmp_path, rows)
    assert got == want and [r[4] for r in got] == ["click", "view", "click"]


def test_rounding_as_in_sql(spark, tmp_path):
    values = [0.0, 1.0000005, 2.0000015, -2.0000015, 1.0171875, 0.0000005, 123456.7890125, 9007199254.7409925, 1e15 + 0.3, 1e305, -1e308, float("inf"), None, *[k / 128 / 625 for k in range(1, 4000, 3)]]
    spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1).write.parquet(f"{tmp_path}/v")
    want = duckdb.sql(f"select i, round(v, 6) from '{tmp_path}/v/*.parquet' order by i").fetchall()
    rows = spark.read.parquet(f"{tmp_path}/v").orderBy("i")
    assert [tuple(r) for r in rows.select("i", metrics.r6(F.col("v"))).collect()] == want
    assert str(spark.sql("select double('NaN') as v").select(metrics.r6(F.col("v"))).first()[0]) == "nan"

import pytest
from pyspark.sql import functions as F

from tessera.operators import paths, retrieval
from tessera.sources.code import condition_complexity, imports
from tessera.sources.reports import jest_files, pytest_summary, word_summary


def test_budget_skip_goes_on_after_a_row_that_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 99), ("b", 5, 10), (None, 6, 3)], "k string, i int, tokens long")
    got = retrieval.budget_skip(rows, "k", [F.col("i")], "tokens", 10).collect()
    assert sorted(r.i for r in got) == [1, 3, 5, 6]


def test_relevance_ladder(spark):
    cases = [("src/api/a.ts", "api", [], [], "required", 1.2), ("src/a.ts", "x", ["src"], [], "important", 1.1), ("src/a.ts", "x", [], ["*.ts"], None, 0.8), ("my-api/a.ts", "api", [], [], "other", 0.6), ("src/login.ts", "", ["LOGIN"], [], None, 0.4), ("a1.ts", None, None, ["a[1].t?"], None, 0.8), ("a[1].ts", None, None, ["a[1].t?"], None, 0.0), ("a.ts", "", None, None, None, 0.0)]
    rows = spark.createDataFrame(cases, "path string, category string, tags array<string>, globs array<string>, priority string, want double")
    got = rows.select("path", "want", retrieval.relevance(*[F.col(c) for c in ("path", "category", "tags", "globs", "priority")]).alias("score")).collect()
    for r in got:
        assert r.score == pytest.approx(r.want), r.path


def test_cycles_and_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    assert {(r.cycle, r.severity) for r in paths.cycles(edges, 4).collect()} == {("a>b", "warning"), ("a>b>c", "error"), ("d", "error")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {(r.node, r.level) for r in paths.topo_levels(chain, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(Exception, match="deeper"):
        paths.topo_levels(chain, 1).collect()


def test_reports(spark):
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    assert tuple(pytest_summary(one("x\n=== 2 failed, 10 passed, 1 skipped in 3.5s ===")).first()) == (13, 10, 2, 1, 3.5)
    assert tuple(pytest_summary(one("nothing")).first()) == (0, 0, 0, 0, 0.0)
    assert tuple(word_summary(one("PASS a\nfailed b\npassed c\nbypass")).first()) == (3, 2, 1)
    report = '{"testResults":[{"name":"a.js","startTime":1,"endTime":5,"assertionResults":[{"status":"passed"},{"status":"failed"}]}]}'
    assert tuple(jest_files(one(report)).first()) == ("a.js", 2, 1, 4, "failed")


def test_imports_and_conditions(spark):
    text = "import a from 'm1';\nimport {b} from \"m2\";\nimport 'm3';\nconst c = require('m4');\nimport('m5')"
    assert {r.module for r in imports(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t").collect()} == {"m1", "m2", "m3", "m4", "m5"}
    got = spark.createDataFrame([("a && b",), ("x",), ("((((((((((a",)], "c string").select(condition_complexity(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [0.2, 0.1, 1.0]

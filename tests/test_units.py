import pytest

from tessera.functions.text import glob_regex
from tessera.plans.cascade import levels
from tessera.sources.diagnostics import lint_issues, tsc_diagnostics


def test_levels_follow_dependencies_and_name_cycles():
    assert levels({"c": ("a", "b"), "b": ("a",), "a": ("x",)}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="a, b"):
        levels({"a": ("b",), "b": ("a",)})


def test_globs():
    import re

    assert re.match(glob_regex("src/**/*.{ts,tsx}"), "src/a/b.tsx")
    assert re.match(glob_regex("src/**/*.ts"), "src/b.ts")
    assert not re.match(glob_regex("*.ts"), "a/b.ts")
    assert re.match(glob_regex("a{b"), "a{b")


def test_tool_output(spark):
    text = "src/a.ts(3,7): error TS2304: Cannot find name 'x'.\nnoise\nb.ts(1,1): warning TS1: m"
    rows = tsc_diagnostics(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.file, r.line, r.column, r.severity, r.code) for r in rows] == [("src/a.ts", 3, 7, "error", "TS2304"), ("b.ts", 1, 1, "warning", "TS1")]
    report = '[{"filePath":"a.js","messages":[{"line":1,"column":2,"severity":2,"ruleId":"r","message":"m","fix":{"text":""}},{"line":2,"column":1,"severity":1,"ruleId":"s","message":"n"}]}]'
    rows = lint_issues(spark.createDataFrame([(report,)], "value string")).collect()
    assert [(r.severity, r.fixable) for r in rows] == [("error", True), ("warning", False)]


def test_repeated_errors_each_get_an_action(spark):
    from tessera.operators import lookups

    errors = spark.createDataFrame([("e", 1.0)] * 2 + [("e", 90.0), ("x", 5.0), (None, 1.0)], "kind string, v double")
    rules = spark.createDataFrame([("e", 80.0, 1, "restart"), ("e", 0.0, 2, "retry")], "kind string, least double, priority int, action string")
    got = sorted(((r.kind, r.v, r.action) for r in lookups.recovery_plan(errors, rules, "kind", "v").collect()), key=str)
    assert got == sorted([("e", 1.0, "retry"), ("e", 1.0, "retry"), ("e", 90.0, "restart"), ("x", 5.0, "escalate"), (None, 1.0, "escalate")], key=str)

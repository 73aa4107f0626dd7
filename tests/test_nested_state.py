"""Nested state against a plain fold of the log, key by key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import nested_state as N

SHAPE = "k string, i int, path string, op string, value string"


def fold(log, deep=False):
    states = {}
    for k, _, path, op, value in sorted(log, key=lambda r: r[1]):
        v = None if value is None else json.loads(value)
        at, (*way, last) = states.setdefault(k, {}), path.split(".")
        for p in way:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(path)
        if op == "set":
            at[last] = v
        elif op == "increment":
            at[last] = at.get(last, 0) + (1 if v is None else v)
        elif op == "append":
            at.setdefault(last, []).append(v)
        else:
            merge(at.setdefault(last, {}), v, deep)
    return states


def merge(old, new, deep):
    for f, v in new.items():
        if deep and isinstance(v, dict) and v:
            merge(old.setdefault(f, {}), v, deep)
        else:
            old[f] = v


@pytest.mark.parametrize("seed,deep", [(1, False), (2, False), (3, True)])
def test_logs_fold_as_by_hand(spark, seed, deep):
    r = random.Random(seed)
    log = []
    for k in ["a", "b", None, "d", "e", "f"]:
        for _ in range(25):
            op = r.choice(["set", "set", "increment", "append", "merge"])
            value = {
                "set": lambda: r.choice(['{"x": {"y": 1, "z": [1, 2]}}', "5", '"t\\"e"', "[1]", "{}", None, "true", "2.5"]),
                "increment": lambda: r.choice(["2", None, "0.5"]), "append": lambda: r.choice(["1", '{"q": 1}', '"s"', None]), "merge": lambda: r.choice(['{"x": 1}', '{"x": {"y": 2}}', "{}", '{"u": [3], "x": {"w": 4}}']),
            }[op]()
            row = (k, len(log), r.choice(["state.a", "state.b.c", "state.b", "state.n.x", "this.d.e.f", "state.a.x", "state.a.x.y", "state.it's"]), op, value)
            try:  # only logs that have a result
                fold([*log, row], deep)
                log.append(row)
            except (ValueError, TypeError, AttributeError):
                pass
    frame = spark.createDataFrame([*log, ("z", 1, None, "set", "1")], SHAPE).repartition(3)
    got = {x.k: json.loads(x.s) for x in N.fold_nested(frame, "k", ["i"], deep=deep).select("k", F.to_json("state").alias("s")).collect()}
    assert got == fold(log, deep) and len(log) > 60
    assert N.fold_nested(frame.limit(0), "k", ["i"]).count() == 0


@pytest.mark.parametrize("ops,words", [([("a", "set", "1"), ("a.b", "set", "2")], "no object"), ([("a", "set", '"x"'), ("a", "increment", None)], "no number"), ([("a", "set", "1"), ("a", "append", "2")], "no array"), ([("a", "merge", "3")], "only objects")])
def test_updates_that_do_not_fit_are_errors(spark, ops, words):
    rows = spark.createDataFrame([("k", i, *x) for i, x in enumerate(ops)], SHAPE)
    with pytest.raises(Exception, match=words):
        N.fold_nested(rows, "k", ["i"]).collect()


def test_reads_by_path(spark):
    doc = spark.createDataFrame([('{"a": {"b": [10, {"c": "x"}]}, "n": 2}',)], "t string").select(F.parse_json("t").alias("s"))
    got = doc.select(N.read(F.col("s"), "a.b.1.c"), N.read(F.col("s"), "a.b.0", "int"), N.read(F.col("s"), "a.q"), N.read(F.col("s"), "n", "bigint")).first()
    assert tuple(got) == ("x", 10, None, 2)
    sub = spark.createDataFrame([("k", 1, "a", "set", '{"x": 1}'), ("k", 2, "a", "merge", '{"y": 2}')], SHAPE)
    assert json.loads(N.fold_nested(sub, "k", ["i"], merge_as_set=True).select(F.to_json("state").alias("s")).first().s) == {"a": {"y": 2}}

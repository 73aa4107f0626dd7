"""Concurrency and cheapest ways against plain loops."""

import random

import pytest

from tessera.operators import concurrency, migration


def test_most_at_once_by_counting(spark):
    r = random.Random(4)
    rows = [(k, b, b + r.randrange(0, 30) if r.random() < 0.95 else None) for k in ("a", "b", None) for b in [r.randrange(200) for _ in range(80)]] + [("c", 5, 3), ("c", None, 4), ("d", 7, 7)]
    frame = spark.createDataFrame(rows, "k string, b int, e int").selectExpr("k", "timestamp_seconds(b) b", "timestamp_seconds(e) e").repartition(4)
    got = {x.k: (x.most, x.most_ms, x.busy_ms) for x in concurrency.most_at_once(frame, "k", "b", "e").collect()}
    for k in ("a", "b", None):
        own = [(b, e) for kk, b, e in rows if kk == k]
        last = max(max(b, e or 0) for b, e in own)
        level = [sum(b <= t and (e is None or t < e) for b, e in own) for t in range(last)]
        still = sum(e is None for _, e in own)
        assert got[k] == (max([*level, still]), 1000.0 * level.count(max(level)), 1000.0 * sum(x > 0 for x in level))
    assert "c" not in got and "d" not in got
    assert concurrency.most_at_once(frame.limit(0), "k", "b", "e").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_ways_by_relaxing(spark, seed):
    r = random.Random(seed)
    steps = [(r.randrange(12), r.randrange(12), r.randrange(9)) for _ in range(40)]
    want = {}
    for s, d, c in steps:
        if s != d:
            want[s, d] = min(want.get((s, d), (c, 2, (s, d))), (c, 2, (s, d)))
    for _ in range(12):
        for s, d, c in steps:
            for a in range(12):
                if (a, s) in want and a != d and s != d:
                    cost, n, way = want[a, s]
                    if d not in way:
                        want[a, d] = min(want.get((a, d), (cost + c, n + 1, (*way, d))), (cost + c, n + 1, (*way, d)))
    frame = spark.createDataFrame([*steps, (None, 1, 1)], "src int, dst int, cost int")
    got = {(x.src, x.dst): (x.cost, len(x.way), tuple(x.way)) for x in migration.cheapest_ways(frame).collect()}
    assert got == want
    asked = spark.createDataFrame([(0, 0), (0, 5), (77, 1)], "src int, dst int")
    plans = {(x.src, x.dst): (x.cost, x.compatible) for x in migration.plans(frame, asked).collect()}
    assert plans == {(0, 0): (0, True), (0, 5): (want[0, 5][0], True) if (0, 5) in want else (None, False), (77, 1): (None, False)}
    with pytest.raises(ValueError, match="less than nothing"):
        migration.cheapest_ways(spark.createDataFrame([(1, 2, -1)], "src int, dst int, cost int"))

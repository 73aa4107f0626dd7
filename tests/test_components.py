"""Components, witnesses and canonical cycles against plain searches on random graphs."""

import random

import pytest

from tessera.operators import components as C


def reach(edges, nodes):
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            out[n] |= {z for y in list(out[n]) for z in out[y]}
    return out


@pytest.mark.parametrize("seed,n,m,trims", [(1, 40, 50, 0), (2, 40, 70, 2), (3, 12, 40, 1), (4, 30, 20, 2)])
def test_components_by_search(spark, seed, n, m, trims):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 125)]
    rows = spark.createDataFrame([*edges, (None, 1), (2, None), edges[0]], "src int, dst int")
    nodes = {x for e in edges for x in e}
    far = reach(edges, nodes)
    want = {x: min([x] + [y for y in nodes if y in far[x] and x in far[y]]) for x in nodes}
    found = C.settled(C.strong_components(rows, trims))
    got = {x.node: (x.component, x.nodes) for x in found.collect()}
    assert got == {x: (c, list(want.values()).count(c)) for x, c in want.items()}
    cyclic = {want[x] for x in nodes if x in far[x]}
    seen = {w.component: w for w in C.witness_cycles(rows, found).collect()}
    assert set(seen) >= {c for c in cyclic if list(want.values()).count(c) > 1 or (c, c) in edges} and set(seen) <= cyclic
    for c, w in seen.items():
        ring = [*w.cycle, w.cycle[0]]
        assert w.cycle[0] == c and len(set(w.cycle)) == len(w.cycle) == w.length and all(e in edges for e in zip(ring, ring[1:]))
        level, steps, here = 0, None, {c}
        while steps is None:
            level, here = level + 1, {b for a, b in edges if a in here and want[b] == c}
            steps = level if c in here else None
        assert w.length == steps and w.severity == ("error" if w.nodes > 2 else "warning")


def test_turns_of_a_cycle_are_one(spark):
    rows = spark.createDataFrame([(["b", "c", "a"],), (["c", "a", "b"],), (["a", "c", "b"],), (["x"],)], "c array<string>")
    assert sorted(r.c for r in C.distinct_cycles(rows, "c").collect()) == [["a", "b", "c"], ["a", "c", "b"], ["x"]]


def test_a_cycle_is_spelt_in_the_error(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    C.require_acyclic(line)
    C.require_acyclic(line.limit(0))
    with pytest.raises(ValueError, match="circular dependency: 3 -> 4 -> 5 -> 3"):
        C.require_acyclic(line.union(spark.createDataFrame([(5, 3)], "src int, dst int")))
    with pytest.raises(ValueError, match="7 -> 7"):
        C.require_acyclic(spark.createDataFrame([(7, 7)], "src int, dst int"))


def test_rounds_keep_plans_and_guesses_small(spark, monkeypatch):
    guesses, leaves, kept = [], [], C.settled

    def seen(df):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        guesses.append((out := kept(df))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(C, "settled", seen)
    ring = spark.range(14).selectExpr("id as src", "(id + 1) % 14 as dst")
    assert [tuple(r) for r in C.component_summary(ring).collect()] == [(0, 14, 14, "error")]
    assert len(guesses) > 28 and max(guesses) < 2**64 and max(leaves) <= 5


def test_settled_tables_of_unknown_size_keep_rows_and_types(spark):
    rows = spark.sql("select 1 as i, cast(null as string) as t, array(struct(1.5D as d, date'2024-02-03' as day)) as a, timestamp_ntz'2024-01-01 00:00:01' as n, cast(2.50 as decimal(9,2)) as m")
    wide = rows
    for k in range(12):
        wide = wide.crossJoin(spark.range(1).withColumnRenamed("id", f"x{k}"))
    out = C.settled(wide)
    assert out.schema == wide.schema and out.collect() == wide.collect()
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64

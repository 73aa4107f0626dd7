"""Reach kept up by differences against reach from scratch, and how much of it a change touches."""

import random

import pytest

from tessera.operators import graph, reach

EDGE = "src int, dst int"


def closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 15, 22), (2, 25, 20), (3, 8, 30)])
def test_batches_equal_reach_from_scratch(spark, seed, n, m):
    r = random.Random(seed)
    pick = lambda k: [(r.randrange(n), r.randrange(n)) for _ in range(k)]
    edges = pick(m)
    removed, added = r.sample(edges, 6) + [(99, 98)], pick(5) + [(50, 51), (51, 52), (0, 50), edges[0]]
    after = (set(edges) - set(removed)) | set(added)
    frame = lambda rows: spark.createDataFrame(rows, EDGE)
    changes = reach.reach_changes(frame(closure(set(edges))), frame(edges + [(None, 1)]), frame(added + [(3, None)]), frame(removed)).collect()
    got = closure(set(edges)) - {(x.src, x.dst) for x in changes if x.change == "removed"} | {(x.src, x.dst) for x in changes if x.change == "added"}
    assert got == closure(after) and len(changes) == len(closure(set(edges)) ^ closure(after))


def test_untouched_pairs_are_left_alone(spark, monkeypatch):
    """Of 40 chains one loses an edge: only its pairs are derived again, whatever the others hold."""
    edges = [(c * 100 + i, c * 100 + i + 1) for c in range(40) for i in range(8)]
    kept = graph.closure(spark.createDataFrame(edges, EDGE)).select("src", "dst")
    seen = []
    inner = reach._derived_again
    monkeypatch.setattr(reach, "_derived_again", lambda k, e, lost: seen.append(lost.count()) or inner(k, e, lost))
    changes = reach.reach_changes(kept, spark.createDataFrame(edges, EDGE), spark.createDataFrame([], EDGE), spark.createDataFrame([(703, 704)], EDGE))
    assert changes.count() == 4 * 5 and {x.src // 100 for x in changes.collect()} == {7} and seen == [4 * 5]
    assert reach.applied(kept, changes).count() == 40 * 36 - 20
    empty = spark.createDataFrame([], EDGE)
    assert reach.reach_changes(empty, empty, empty, empty).count() == 0

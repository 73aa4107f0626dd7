"""Reachability kept up by differences: after edges go and come, only pairs that a change can touch are looked at.

Removals delete first and derive again: a pair goes if a way between its ends could lead over a removed edge, and comes back if an edge that is left
leads to a node from which the pair's end is still reached. Additions join what reaches a new edge's beginning with what its end reaches, and
pairs over several new edges by doubling. The kept pairs are read by joins with the changed nodes; none is derived anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled

PAIR = ["src", "dst"]


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(*PAIR).where("src is not null and dst is not null").distinct()


def _around(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that a way over one of ``edges`` joins: what reaches its beginning (or is it) with what its end reaches (or is it)."""
    edge = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    begins, ends = edge.select("u").distinct(), edge.select("v").distinct()
    into = kept.join(begins, kept["dst"] == begins["u"]).select("u", F.col("src").alias("from")).union(begins.select("u", "u"))
    out = kept.join(ends, kept["src"] == ends["v"]).select("v", F.col("dst").alias("to")).union(ends.select("v", "v"))
    # first to the far ends, once each, so that a node with many ways in and out isn't multiplied for each of its edges
    over = edge.join(out, "v").select("u", "to").distinct()
    return into.join(over, "u").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def _derived_again(kept: DataFrame, edges: DataFrame, lost: DataFrame) -> DataFrame:
    """Those of ``lost`` that still hold by edges that are left: round by round, by the pairs found in the round before."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    mine = settled(step.join(lost.select(F.col("src").alias("a")).distinct(), "a", "left_semi"))
    # a first step to the pair's end, or to a node that reaches it by a way that nothing has touched
    steps = lost.join(mine, lost["src"] == mine["a"]).select("src", "dst", "b")
    back = settled(steps.where("b = dst").select(*PAIR).union(steps.join(kept.select(F.col("src").alias("b"), "dst"), ["b", "dst"], "left_semi").select(*PAIR)).distinct())
    front = back
    while front.take(1):
        near = mine.join(front, mine["b"] == front["src"]).select(F.col("a").alias("src"), "dst").distinct()
        front = settled(near.join(lost, PAIR, "left_semi").join(back, PAIR, "left_anti"))
        back = back.unionByName(front)
    return back


def _joined(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs that aren't in ``kept`` and hold by ways over ``added`` edges, however many: in each round twice as many edges in a row."""
    over = settled(_around(kept, added))
    fresh = front = settled(over.join(kept, PAIR, "left_anti"))
    while front.take(1):
        ends = lambda rows, a, b: rows.select(F.col("src").alias(a), F.col("dst").alias(b))
        left = ends(front, "x", "y").join(ends(over, "y", "z"), "y").select(F.col("x").alias("src"), F.col("z").alias("dst"))
        right = ends(over, "x", "y").join(ends(front, "y", "z"), "y").select(F.col("x").alias("src"), F.col("z").alias("dst"))
        found = left.union(right).distinct()
        front = settled(found.join(fresh, PAIR, "left_anti").join(kept, PAIR, "left_anti"))
        fresh, over = fresh.unionByName(front), over.unionByName(front)
    return fresh


def reach_changes(kept: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``src, dst, change`` (``removed`` or ``added``): what turns the reach ``kept`` of ``edges`` into that of the edges after a batch.

    ``edges`` are those before the batch. An edge that is both removed and added stays. Repeated edges count once, an edge that isn't there can't be
    removed, edges with a null end aren't read. Pairs whose ways no changed edge can lie on aren't joined with anything but the changed nodes.
    """
    kept, edges, added, removed = (settled(_pairs(x)) for x in (kept, edges, added, removed))
    gone = settled(removed.join(added, PAIR, "left_anti").join(edges, PAIR, "left_semi"))
    come = settled(added.join(edges, PAIR, "left_anti"))
    left = edges.join(gone, PAIR, "left_anti")
    touched = settled(_around(kept, gone).join(kept, PAIR, "left_semi"))
    safe = kept.join(touched, PAIR, "left_anti")
    lost = settled(touched.join(_derived_again(safe, left, touched), PAIR, "left_anti"))
    still = kept.join(lost, PAIR, "left_anti")
    fresh = settled(_joined(still, come))
    # what goes by a removed edge and comes back by an added one hasn't changed
    removed_pairs = lost.join(fresh, PAIR, "left_anti").withColumn("change", F.lit("removed"))
    return removed_pairs.unionByName(fresh.join(lost, PAIR, "left_anti").withColumn("change", F.lit("added")))


def applied(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """The reach after ``changes``."""
    gone = changes.where("change = 'removed'").select(*PAIR)
    return kept.select(*PAIR).join(gone, PAIR, "left_anti").unionByName(changes.where("change = 'added'").select(*PAIR))

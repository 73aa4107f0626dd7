"""Cycles of any length in a graph: strongly connected components and a witness for each.

Components come from reach in both directions: every node takes the least label among the nodes that reach it and among those it reaches. A
node whose two labels are one and the same node lies on a cycle with it; an edge between nodes with unlike labels is in no cycle and goes. Labels are
numbers in a random order, so the parts that are left shrink quickly. Work is joins in checkpointed rounds, and only nodes whose label has changed pass it on.
Joins are by sorting: a settled table keeps the size that Spark guessed before it was made, which may be far too small. A round's state is one settled
table, never a union of all rounds' tables, so that a round's plan and its number of tasks, which the driver keeps, don't grow from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """``edges`` without those at nodes that nothing leads to or from; each round takes one layer."""
    for _ in range(rounds):
        begun, ended = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = settled(edges.join(begun.hint("merge"), "src", "left_semi").join(ended.hint("merge"), "dst", "left_semi").select("src", "dst"))
    return edges


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, id`` of the nodes of ``edges``, their ids distinct and in a random order, and the edges as ``src, dst`` between ids."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    ids = settled(nodes.repartition("node").sortWithinPartitions(F.xxhash64("node")).select("node", F.monotonically_increasing_id().alias("id")))
    ends = [ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")).hint("merge") for c in ("src", "dst")]
    return ids, settled(edges.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))


def _least_labels(edges: DataFrame) -> DataFrame:
    """``node, ahead, behind``: the least of the nodes that a node reaches and that reach it, itself included; ``edges`` are between numbers.

    Edges and their turned copies are one graph of places, twice a node's number and, on the turned side, one more.
    """
    ways = settled(edges.select((2 * F.col("src")).alias("from"), (2 * F.col("dst")).alias("place")).union(edges.select(2 * F.col("dst") + 1, 2 * F.col("src") + 1)))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = settled(nodes.select(F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("at"), F.col("node").alias("label"), F.lit(True).alias("new")))
    while (front := labels.where("new").select("at", "label")).take(1):
        offers = front.join(ways.hint("merge"), F.col("at") == F.col("from")).select("place", "label", F.lit(None).cast("long"))
        least = labels.select(F.col("at").alias("place"), "label", F.col("label").alias("own")).union(offers).groupBy("place").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        labels = settled(least.select(F.col("place").alias("at"), "label", (F.col("label") < F.col("own")).alias("new")))
    side = lambda turned: F.max(F.when(F.col("at") % 2 == turned, F.col("label")))
    return labels.groupBy(F.floor(F.col("at") / 2).alias("node")).agg(side(0).alias("behind"), side(1).alias("ahead"))


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """``node, component, nodes``: each node's strongly connected component, named by its smallest node, and that one's size.

    ``trims`` layers of nodes that nothing leads to or from go before labels are passed. Repeated edges and edges of a node to itself change nothing;
    edges with a null end aren't read.
    """
    whole = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    ids, left = _numbered(_trimmed(whole.where("src <> dst"), trims))
    found = None
    while left.take(1):
        labels = settled(_least_labels(left))
        done = labels.where(F.col("ahead") == F.col("behind")).select("node", F.col("ahead").alias("pivot"))
        found = done if found is None else settled(found.unionByName(done))
        open_ = labels.where(F.col("ahead") != F.col("behind"))
        ends = [open_.select(F.col("node").alias(c), F.struct("ahead", "behind").alias(f"{c}_labels")) for c in ("src", "dst")]
        left = _trimmed(settled(left.join(ends[0].hint("merge"), "src").join(ends[1].hint("merge"), "dst").where("src_labels = dst_labels").select("src", "dst")), 1)
    nodes = whole.select(F.col("src").alias("node")).union(whole.select("dst")).distinct()
    if found is None:
        return nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("nodes"))
    found = settled(ids.join(found.withColumnRenamed("node", "id").hint("merge"), "id").select("node", "pivot"))
    named = found.groupBy("pivot").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("nodes"))
    members = found.join(named.hint("merge"), "pivot").select("node", "component", "nodes")
    return nodes.join(members.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("nodes", F.lit(1).cast("long")).alias("nodes"))


def witness_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``component, nodes, cycle, length, severity``: for each component with a cycle a shortest one through its smallest node.

    ``cycle`` is an array that begins with that node. Two nodes that depend on each other, and a node on itself, are a warning; larger components an
    error. One table holds the nodes reached so far, and only those found last carry their way along; steps end when all components have a cycle.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    of = components.select(F.col("node").alias("src"), "component", "nodes")
    inner = settled(e.join(of.hint("merge"), "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("other")).hint("merge"), "dst").where("component = other").select("component", "nodes", "src", "dst"))
    wanted = inner.select("component").distinct().count()
    back, key = F.col("at") == F.col("component"), ["component", "nodes", "at"]
    reached = settled(inner.where("src = component").select("component", "nodes", F.col("dst").alias("at"), F.lit(True).alias("new"), F.array("src").alias("cycle")))
    while True:
        closed, open_ = reached.agg(F.count_if(back), F.count_if(F.col("new") & ~back)).first()
        if closed >= wanted or not open_:
            break
        front = reached.where(F.col("new") & ~back).select("at", F.array_append("cycle", F.col("at")).alias("cycle"))
        onward = front.join(inner.hint("merge"), F.col("at") == F.col("src")).select("component", "nodes", F.col("dst").alias("at"), F.lit(True), "cycle")
        known = reached.select(*key, F.lit(False).alias("new"), F.when(back, F.col("cycle")).alias("cycle"))
        # of a node's rows the known one is least, else the one with the least way
        reached = settled(known.union(onward).groupBy(*key).agg(F.min(F.struct("new", "cycle")).alias("way")).select(*key, "way.new", "way.cycle"))
    severity = F.when(F.col("nodes") <= 2, "warning").otherwise("error")
    return reached.where(back).select("component", "nodes", "cycle", F.size("cycle").cast("long").alias("length"), severity.alias("severity"))


def canonical_cycle(cycle: Column) -> Column:
    """A cycle (an array of its nodes) turned so that its smallest node comes first; equal for all turns of one cycle."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def distinct_cycles(cycles: DataFrame, column: str) -> DataFrame:
    """Each cycle once, whatever node it was found from."""
    return cycles.select(canonical_cycle(F.col(column)).alias(column)).distinct()


def require_acyclic(edges: DataFrame) -> None:
    """Raises an error that spells a cycle, where there is one."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loop = e.where("src = dst").select(F.array("src").alias("cycle")).take(1) or witness_cycles(e, strong_components(e)).orderBy("length", "component").select("cycle").take(1)
    if loop:
        names = [str(x) for x in loop[0]["cycle"]]
        raise ValueError(f"circular dependency: {' -> '.join([*names, names[0]])}")


def component_summary(edges: DataFrame) -> DataFrame:
    """``component, nodes, length, severity`` of each component that holds a cycle, with the length of its witness."""
    e = settled(edges.select("src", "dst").distinct())
    return witness_cycles(e, settled(strong_components(e))).select("component", "nodes", "length", "severity")

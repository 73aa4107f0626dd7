"""Simple paths, cycles and levels of a dependency graph, grown by one join a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled


def simple_paths(edges: DataFrame, depth: int, from_smallest: bool = False) -> DataFrame:
    """``path``: arrays of 2 to ``depth`` + 1 nodes along the edges, none twice; ``from_smallest`` grows only those whose first node is their smallest."""
    step = settled(edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).where("_from <> _to").distinct())
    grows = F.col("_to") > F.col("path")[0] if from_smallest else F.lit(True)
    front = step.select(F.array("_from", "_to").alias("path"), "_to").where(grows).select("path")
    found = front
    for _ in range(depth - 1):
        onward = front.join(step.hint("merge"), F.element_at("path", -1) == F.col("_from")).where(grows & ~F.array_contains("path", F.col("_to")))
        front = settled(onward.select(F.array_append("path", F.col("_to")).alias("path")))
        if not front.take(1):
            break
        found = found.unionByName(front)
    return found


def cycles(edges: DataFrame, depth: int) -> DataFrame:
    """``cycle, length, severity``: each cycle of at most ``depth`` nodes once, from its smallest node; two nodes are a warning."""
    step = settled(edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct())
    loops = step.where("_from = _to").select(F.array("_from").alias("path"))
    open_paths = simple_paths(step.select(F.col("_from").alias("src"), F.col("_to").alias("dst")), depth - 1, from_smallest=True)
    closed = open_paths.join(step.hint("merge"), (F.element_at("path", -1) == F.col("_from")) & (F.col("path")[0] == F.col("_to")), "left_semi")
    return loops.unionByName(closed).select(
        F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"), F.when(F.size("path") == 2, "warning").otherwise("error").alias("severity")
    )


def topo_levels(edges: DataFrame, depth: int) -> DataFrame:
    """``node, level``: the longest way from a node without predecessors; a graph that is deeper (or has a cycle) is an error."""
    step = settled(edges.select("src", "dst").distinct())
    front = step.select(F.col("src").alias("node")).distinct().join(step.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(0))
    reached = front
    for level in range(1, depth + 2):
        front = settled(front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("level", F.lit(level)))
        if level > depth or not front.take(1):
            break
        reached = reached.unionByName(front)
    deeper = F.when(F.col("level") > depth, F.raise_error(F.lit("the graph is deeper than allowed or has a cycle")).cast("int")).otherwise(F.col("level"))
    return reached.unionByName(front).select("node", deeper.alias("level")).groupBy("node").agg(F.max("level").alias("level"))

"""Graph analytics over edge tables: closure, cycles and levels, by semi-naive joins with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled


def closure(edges: DataFrame, depth: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, hops``: pairs within ``depth`` hops (all, without a depth), at their smallest number of hops.

    Only pairs found in the last step are joined on, and each step is settled; it ends when a step finds nothing new. ``sources``
    (one column) limits where ways begin. Joins are by sorting: a settled table keeps the size that Spark guessed before it was made.
    """
    step = settled(edges.select("src", "dst").distinct())
    on = step.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    front = step if sources is None else step.join(sources.toDF("src").hint("merge"), "src", "left_semi")
    reached = front = settled(front.withColumn("hops", F.lit(1)))
    hops = 1
    while (depth is None or hops < depth) and front.take(1):
        hops += 1
        onward = front.join(on.hint("merge"), F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst")).distinct()
        front = settled(onward.join(reached.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        reached = reached.unionByName(front)
    return reached


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other, smaller name first."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.join(back, ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, predecessors, successors``: direct ones, each counted once."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("predecessors"), F.sum("o").alias("successors"))


def without_cycles(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """``src, dst, placeholder``: edges rid of each cycle's closing one (``cycle``: names joined by ``>``), with an edge to a placeholder in its place."""
    nodes = F.split("cycle", ">")
    closing = cycles.select(F.element_at(nodes, -1).alias("src"), F.element_at(nodes, 1).alias("dst")).distinct()
    left = edges.select("src", "dst").distinct().join(closing, ["src", "dst"], "left_anti").withColumn("placeholder", F.lit(False))
    return left.union(closing.select("src", F.concat(F.lit("<cycle:"), "dst", F.lit(">")), F.lit(True)))


def max_depth(paths: DataFrame) -> DataFrame:
    """One row: the longest path's edges."""
    return paths.agg((F.max(F.size("path")) - 1).alias("depth"))


def closes_cycle(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``src, dst, cycle``: for each wanted edge whether its end leads back to its beginning already (an inclusion that includes itself)."""
    reached = closure(edges, sources=wanted.select("dst").distinct()).select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct().withColumn("back", F.lit(True))
    return wanted.join(reached, ["src", "dst"], "left").select("src", "dst", (F.coalesce("back", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("cycle"))


def resolved_methods(parents: DataFrame, methods: DataFrame, depth: int = 10) -> DataFrame:
    """``name, method, owner``: each class's methods, its own or those of the nearest ancestor (``parents``: name, parent; ``methods``: name, method)."""
    up = closure(parents.select(F.col("name").alias("src"), F.col("parent").alias("dst")), depth)
    own = parents.select(F.col("name").alias("src")).union(parents.select("parent")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))
    found = up.select("src", "dst", "hops").union(own).join(methods.select(F.col("name").alias("dst"), "method"), "dst")
    return found.groupBy(F.col("src").alias("name"), "method").agg(F.min_by("dst", F.struct("hops", "dst")).alias("owner"))

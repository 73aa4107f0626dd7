"""Cheapest ways through a graph of steps, such as migrations from version to version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled


def cheapest_ways(steps: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, cost, way``: for each pair that steps (``src, dst, cost``, none below 0) join, the cheapest way as the nodes on it.

    Of equally cheap ways the one with fewer steps, then the smaller nodes, is taken. Each round only ways that became better in the last one go a step
    on, and of those that reach a pair the best is kept; it ends when none is better. ``sources`` (one column) limits where ways begin.
    """
    edges = settled(steps.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost")).where("src <> dst"))
    bad = edges.where("cost < 0").take(1)
    if bad:
        raise ValueError(f"a step costs less than nothing: {bad[0].src} to {bad[0].dst}")
    on = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("cost").alias("more"))
    best = F.struct("cost", F.size("way").alias("steps"), "way")
    begin = edges if sources is None else edges.join(sources.toDF("src"), "src", "left_semi")
    ways = front = settled(begin.select("src", "dst", "cost", F.array("src", "dst").alias("way")))
    while front.take(1):
        onward = front.join(on, F.col("dst") == F.col("mid")).where(F.col("to") != F.col("src"))
        offered = onward.select("src", F.col("to").alias("dst"), (F.col("cost") + F.col("more")).alias("cost"), F.array_append("way", F.col("to")).alias("way")).groupBy("src", "dst").agg(F.min(best).alias("offer"))
        known = ways.select("src", "dst", best.alias("known"))
        better = settled(offered.join(known, ["src", "dst"], "left").where("known is null or offer < known").select("src", "dst", "offer.cost", "offer.way"))
        ways, front = settled(ways.join(better, ["src", "dst"], "left_anti").unionByName(better)), better
    return ways


def plans(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``src, dst``) with ``cost``, ``way`` and ``compatible``: none is needed from a version to itself, null where no way leads."""
    ways = cheapest_ways(steps, wanted.select("src").distinct()).withColumnsRenamed({"src": "s", "dst": "d"})
    met = wanted.join(ways, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left")
    same = F.col("src") == F.col("dst")
    cost = F.when(same, F.lit(0)).otherwise(F.col("cost"))
    return met.select(*wanted.columns, cost.alias("cost"), F.when(same, F.array("src")).otherwise(F.col("way")).alias("way"), cost.isNotNull().alias("compatible"))

"""Operations that run at once: a sweep over the beginnings and ends of intervals, with running sums by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import settled


def levels(operations: DataFrame, key: str, begins: str, ends: str) -> DataFrame:
    """``key, at, level, until``: how many operations of a key run from one moment at which that changes to the next.

    An operation runs from its beginning up to, not including, its end; one without an end runs on, one that ends before it begins isn't counted.
    Moments are dealt out by ranges of key and time: totals of the ranges are summed first, then moments within a range, so a key that holds a third of
    all operations is many tasks' work.
    """
    valid = operations.where(F.col(begins).isNotNull() & (F.col(ends).isNull() | (F.col(ends) >= F.col(begins))))
    moment = lambda c, step: valid.where(F.col(c).isNotNull()).select(F.col(key).alias("k"), F.col(c).alias("at"), F.lit(step).alias("step"))
    moments = moment(begins, 1).unionByName(moment(ends, -1)).groupBy("k", "at").agg(F.sum("step").alias("step")).where("step <> 0")
    dealt = settled(moments.repartitionByRange("k", "at").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("key").orderBy("of")  # a row for each key and range
    ranges = dealt.groupBy(F.col("k").alias("key"), F.col("part").alias("of")).agg(F.sum("step").alias("sum"), F.min("at").alias("first"))
    bases = ranges.select("key", "of", F.coalesce(F.sum("sum").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(own).alias("beyond"))
    inside = Window.partitionBy("k", "part").orderBy("at")
    swept = dealt.withColumns({"here": F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("at").over(inside)})
    met = swept.join(bases, F.col("k").eqNullSafe(F.col("key")) & (F.col("part") == F.col("of")))
    return met.select(F.col("k").alias(key), "at", (F.col("base") + F.col("here")).alias("level"), F.coalesce("next", "beyond").alias("until"))


def most_at_once(operations: DataFrame, key: str, begins: str, ends: str) -> DataFrame:
    """``key, most, most_ms, busy_ms``: the most operations of a key at once, for how long that many ran, and how long any did."""
    swept = levels(operations, key, begins, ends)
    ms = (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1000
    at_level = swept.groupBy(key, "level").agg(F.sum(ms).alias("ms"))
    return at_level.groupBy(key).agg(F.max("level").alias("most"), F.round(F.max_by("ms", "level"), 3).alias("most_ms"), F.round(F.sum(F.when(F.col("level") > 0, F.col("ms"))), 3).alias("busy_ms"))

"""Tables that cut lineage, and orders over rows that are found in two levels, so that no key is one task's."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode without that setting."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def guessed_size(df: DataFrame) -> float:
    """The bytes that Spark guesses for ``df``; infinite where they have more digits than Python reads."""
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except ValueError:
        return math.inf


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder.

    A settled table keeps the size that Spark guessed for its plan, and a join's is the product of its sides': in loops its digits multiply, to megabytes
    for each step of a plan, all on the driver. A guess that no table can have is dropped; such a table has Spark's size for unknown ones.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()
    if guessed_size(done) < 2**63:
        return done
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def spread(rows: DataFrame, key: str, per_task: int = 4_000) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as their number asks for.

    For rows whose table is too small for Spark to split and that grow when they're worked on (a text's lines and tokens).
    """
    return rows.repartition(max(1, math.ceil(rows.count() / per_task)), key)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_total(rows: DataFrame, key: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows of the key before this one, in ``order``, as ``name``.

    Rows are dealt out by ranges of key and order; totals of the ranges are summed first, then rows within a range, so a key
    that holds a third of all rows is many tasks' work. Ties in ``order`` take any order.
    """
    part, inside, base, own = (unused(rows, x) for x in ("part", "inside", "base", "own"))
    dealt = settled(rows.repartitionByRange(F.col(key), *order).withColumn(part, F.spark_partition_id()))
    before = Window.unboundedPreceding
    sums = dealt.groupBy(F.col(key).alias(own), F.col(part).alias(base)).agg(F.sum(amount).alias(inside))
    # a row for each key and range
    bases = sums.select(own, F.col(base).alias("of"), F.coalesce(F.sum(inside).over(Window.partitionBy(own).orderBy(base).rowsBetween(before, -1)), F.lit(0)).alias("base_sum"))
    row = F.coalesce(F.sum(amount).over(Window.partitionBy(key, part).orderBy(*order).rowsBetween(before, -1)), F.lit(0))
    placed = dealt.withColumn(inside, row).join(bases, F.col(key).eqNullSafe(F.col(own)) & (F.col(part) == F.col("of")))
    return placed.withColumn(name, F.col("base_sum") + F.col(inside)).select(*rows.columns, name)


def order_statistics(rows: DataFrame, key: str, value: str, positions: dict[str, Column]) -> DataFrame:
    """``key`` and, for each name, the value at a 0-based position of the key's sorted values; positions are columns over ``n``, their number.

    Equal values are counted first; the distinct ones are dealt out by ranges of key and value, as many as Spark makes of them, and counted through
    (``running_total``), so a range doesn't grow with its key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = running_total(counts, "k", [F.col("v")], F.col("c"), "first")
    sizes = placed.groupBy(F.col("k").alias("own")).agg(F.sum("c").alias("n"))
    met = placed.join(sizes, F.col("k").eqNullSafe(F.col("own")))
    at = {name: F.max(F.when((F.col("first") <= p) & (p < F.col("first") + F.col("c")), F.col("v"))).alias(name) for name, p in positions.items()}
    return met.groupBy(F.col("k").alias(key)).agg(F.max("n").alias("n"), *at.values())

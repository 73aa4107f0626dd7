"""Changes of files as a stream: listings come in, snapshots and changes go out, each under its batch's number.

A batch's result is made from the snapshot of the batch before and written in a folder of its own number, so a batch that is run again
writes the same once more, and a reader never sees a part of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COLUMNS = "path string, hash string"


def _before(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The newest snapshot of a batch before this one; empty where there is none."""
    try:
        known = spark.read.parquet(f"{root}/snapshot")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], COLUMNS)
    newest = known.where(F.col("batch") < batch).agg(F.max("batch")).first()[0]  # one number
    return known.where(F.col("batch") == F.lit(-1 if newest is None else newest)).select("path", "hash")


def merge_listing(listed: DataFrame, batch: int, root: str) -> None:
    """Writes ``snapshot/batch=<n>`` and ``changes/batch=<n>``: what the newest listing of this batch (``listing, path, hash``) holds, and how it differs.

    A listing names every file there is, so files that it lacks are deleted. A batch without rows changes nothing. Repeated rows count once; of unlike
    hashes of one path in a listing the largest stands.
    """
    spark = listed.sparkSession
    rows = listed.select("listing", "path", "hash").where("path is not null")
    newest = rows.agg(F.max("listing").alias("newest"))
    now = rows.join(newest, F.col("listing") == F.col("newest")).groupBy("path").agg(F.max("hash").alias("hash"))
    old = _before(spark, root, batch)
    if not rows.take(1):
        now = old
    both = old.withColumnRenamed("hash", "was").join(now.withColumnRenamed("hash", "is"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    both.select("path", change.alias("change")).where("change is not null").write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    now.write.mode("overwrite").parquet(f"{root}/snapshot/batch={batch}")


def watch(listings: DataFrame, root: str, checkpoint: str, on_changes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the stream over ``listings`` and ends it when all there is has been merged; ``on_changes`` gets each batch's changes."""

    def each(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        merge_listing(rows, batch, root)
        rows.unpersist()
        if on_changes:
            on_changes(rows.sparkSession.read.schema("path string, change string").parquet(f"{root}/changes/batch={batch}"), batch)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash`` as of the newest batch."""
    return _before(spark, root, 1 << 62)


def change_log(spark: SparkSession, root: str) -> DataFrame:
    """``batch, path, change`` of all batches."""
    return spark.read.parquet(f"{root}/changes").select("batch", "path", "change")

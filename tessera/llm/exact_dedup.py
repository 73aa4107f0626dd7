"""Exact dedup by a heavy-hitter split.

A Misra-Gries sketch (the JVM's mergeable frequent-items aggregate) names the digests that may be
frequent. An exact count over those alone verifies them and finds the row that stays; these winners
are at most ``winners`` rows, so they are broadcast and their copies are resolved where they are read.
Only the other digests are shuffled, and no group among them is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed, unused


def frequent_digests(digests: DataFrame, winners: int, counters: int, fan_in: int = 256) -> DataFrame:
    """Candidates (``probe`` long, at most ``winners`` rows) for the frequent values of ``probe``.

    Each of ``fan_in`` slices of the input has a sketch; their counters are summed by value and the largest stay.
    """
    return (
        digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("slice"))
        .agg(F.expr(f"approx_top_k(probe, {winners}, {counters})").alias("found"))
        .select(F.explode("found").alias("found"))
        .groupBy(F.col("found.item").alias("probe"))
        .agg(F.sum("found.count").alias("seen"))
        .orderBy(F.desc("seen"), "probe")
        .limit(winners)
        .select("probe")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    winners: int = 1024,
    counters: int = 8192,
    min_copies: int = 64,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text counts as empty, and empty texts are equal to each
    other. Of equal texts the row with the largest id stays. Repeated rows of one id count as copies and
    share ``kept``. An empty table gives no rows; other columns, whatever their names, aren't read.
    ``winners`` bounds the broadcast; ``min_copies`` is the count from which a digest is resolved there.
    """
    thin = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        )
    )
    probed = thin.withColumn("probe", F.xxhash64("text_sha256"))
    candidates = frequent_digests(probed, winners, counters)
    verified = checkpointed(
        probed.join(F.broadcast(candidates), "probe")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= min_copies)
    )
    marked = thin.join(F.broadcast(verified), "text_sha256", "left")
    same = Window.partitionBy("text_sha256")
    ordinary = (
        marked.where(F.col("group_size").isNull())
        .select("doc_id", "text_sha256")
        .withColumns({"keep_id": F.max("doc_id").over(same), "group_size": F.count(F.lit(1)).over(same)})
    )
    return (
        marked.where(F.col("group_size").isNotNull())
        .unionByName(ordinary)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document stays: of equal texts those with the largest id.

    Rows with a null id stay only where no row with an id has their text. Repeated rows of an id and text stay or go together.
    """
    digest, own = unused(docs, "digest"), unused(docs, "own")
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return docs.join(kept, (sha == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(own)), "left_semi")

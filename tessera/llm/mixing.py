"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; within its source, documents are
taken in the order of their keys until the token budget is met. Whole epochs come first: a source whose
target is 1.3 times its size gives every document once and then 0.3 of its size by order of keys.
The order within a source is found in two levels (key ranges, then rows), so that a source that holds
a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed, unused

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(id_column: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 48 bits of an md5 of seed and id: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), id_column.cast("string"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 48))) / weight


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight``: twice the weight for documents labelled good (``quality`` 1); the others weigh 1."""
    return labels.groupBy("doc_id").agg((F.lit(1.0) + F.max("quality")).alias("weight"))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size, rows: one row per source) with ``target``.

    Sources by code point, null last, weigh as ``cycle`` repeats. They share ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the rest share the excess by weight. The level that
    solves this is the largest of the levels found when the first k sources, by cap over weight, are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (
        sizes.withColumn("weight", F.get(weights, ((F.row_number().over(order) - 1) % len(cycle)).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("full")) / F.col("open")).over(everything))
        .select("source", "source_size", "rows", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: DataFrame | None = None,
    cycle: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    whole: bool = False,
    range_rows: int = 50_000,
    broadcast_sources: int = 20_000,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, epochs, taken``.

    ``size`` counts words (null or empty text: 0). ``weight`` (doc_id, weight > 0; ids once) holds quality
    weights, 1 where absent. ``taken`` is ``epochs`` times the size plus what the fractional selection
    takes: the document at which a source's budget ends gives only the words that are left, or, with
    ``whole``, all or none of its words, whichever is nearer. Equal keys go by id; repeated rows of an id
    get the same key and either may come first. No document exceeds ``most`` times its size. An empty table gives no rows.
    """
    thin = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    if weight is None:
        thin = thin.withColumn("w", F.lit(1.0))
    else:
        own = weight.select(F.col("doc_id"), F.col("weight").cast("double").alias("w"))
        thin = thin.join(own, "doc_id", "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    thin = checkpointed(
        thin.withColumn("key", exponential_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("w"), seed))
    )
    sizes = thin.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.avg("w").alias("rate")
    )
    rates = sizes.select(F.col("source").alias("s"), "rate")
    targets = source_targets(sizes.drop("rate"), cycle, share, most)
    targets = checkpointed(
        targets.join(rates, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("ranges", (F.least(F.ceil(F.col("rows") / 64), F.lit(256)) + F.ceil(F.col("rows") / range_rows)).cast("long"))
        .withColumnRenamed("source", "s")
    )
    few = targets.count() <= broadcast_sources
    # keys follow 1 - exp(-rate * key) nearly evenly, so equal steps of it hold about equally many rows
    ranged = (
        thin.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("s")))
        .drop("s", "w")
        .withColumn("range", F.least(F.col("ranges") - 1, F.floor(F.col("ranges") * (1 - F.exp(-F.col("key") * F.col("rate"))))).cast("long"))
        .withColumn("group", F.xxhash64(F.col("source").isNull(), "source"))
    )
    before = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(F.col("group").alias("g"), F.col("range").alias("r"))
        .agg(F.sum("size").alias("inside"))
        .withColumn("base", F.coalesce(F.sum("inside").over(before), F.lit(0)))
        .drop("inside")
    )
    row = Window.partitionBy("group", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.col("within")
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - ahead))
    extra = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else left
    return (
        ranged.withColumn("within", F.coalesce(F.sum("size").over(row), F.lit(0)))
        .join(bases, (F.col("group") == F.col("g")) & (F.col("range") == F.col("r")))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (0 to ``most`` times), columns as they are, whatever their names.

    Documents are taken whole. A null, empty or blank text costs nothing and is taken once. Rows with a null id are one document,
    as are repeated rows of an id: each is taken as often as the one that is taken most. An empty table gives no rows.
    """
    own, times, nth = (unused(docs, x) for x in ("own", "times", "nth"))
    taken = mix_sources(docs, id_col, text_col, source_col, whole=True, **options)
    copies = taken.groupBy(F.col("doc_id").alias(own)).agg(F.max(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")).alias(times))
    both = docs.join(copies, F.col(id_col).eqNullSafe(F.col(own))).where(F.col(times) > 0)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)

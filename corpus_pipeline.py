"""A training-data pipeline over ``documents``: each stage calls one operator of tessera.llm.

language ID, line dedup, n-gram Jaccard join, mixing to target weights, packing. Each stage reads all that the one
before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language import keep_known_languages
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mixed_documents, quality_weights
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.storage import new_folder, unused

#: A character other than white space, controls and format marks.
VISIBLE = r"[^\p{Z}\p{Cc}\p{Cf}]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a posterior of one half or more.

    Null, empty and letterless texts go, whatever their id; so do all where nothing is labelled. Equal texts and repeated rows stay or go
    together. Very long texts are read whole. Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    return keep_known_languages(docs, public_tokenizers.path("piece_bpe_32k.model"), least=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that earlier documents have; a document left with nothing visible goes.

    Rows with a null id and null, empty and blank texts stay as they are. Of documents with a template in common the one with the smallest id keeps
    its lines; repeated rows of an id are one document. ``n_chars`` is counted anew where lines went. An empty table stays empty.
    """
    own = unused(docs, "n_dropped")
    cut = dedup_lines(docs if own == "n_dropped" else docs.withColumnRenamed("n_dropped", own)).where((F.col("n_dropped") == 0) | F.col("text").rlike(VISIBLE))
    counted = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else cut
    return counted.select(*[F.col(own).alias(c) if c == "n_dropped" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more, the smallest id stays.

    Rows with a null id and texts without words link with nothing and stay. Repeated rows of an id that stays all stay. Other columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those labelled good go first twice as readily.

    Texts without words are taken once. Rows with a null id, and repeated rows of an id, are one document each. Other columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    return mixed_documents(docs, weight=quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of ids for training, a row for each.

    A null or empty text is its end id alone. Copies and rows with a null id are packed one by one. Very long texts are cut like others;
    an empty table gives no sequences.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Language models, shingles and tokenizers are beyond SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

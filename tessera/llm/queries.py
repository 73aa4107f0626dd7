"""The registered queries over the driver's tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align_documents
from tessera.llm.conversations import repair_conversations
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.language import identify_languages
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix_sources, quality_weights
from tessera.llm.near_dedup import jaccard_groups
from tessera.llm.packing import pack_documents
from tessera.llm.quality import FOUR_WORDS, GAP, MENU, NAVIGATION, NOTICES, NOT_WORD, SENTENCE_END, WORD, clean_documents
from tessera.llm.sharding import shard_documents
from tessera.llm.storage import new_folder
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.toxicity import score_toxicity
from tessera.llm.vector_dedup import vector_groups

#: The rules of quality.py again; windows of words are counted as lists, not as hashes.
QUALITY_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS ws, string_split(t, chr(10)) AS ls FROM d),
    g AS (SELECT r, i, ws[i:i + 7] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    p AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS same FROM g), range(0, 8) AS s(k) WHERE same > 1 GROUP BY r),
    l AS (SELECT r, unnest(ls) AS l FROM w),
    j AS (SELECT r, l, regexp_matches(l, '{WORD}') AS worded, length(l) - length(regexp_replace(l, '{NOT_WORD}', '', 'g')) AS marks,
            length(regexp_replace(l, '{GAP}', '', 'g')) AS seen FROM l),
    f AS (SELECT r, l, worded, seen, worded AND (NOT regexp_matches(l, '{SENTENCE_END.replace("'", "''")}') AND regexp_matches(l, '{FOUR_WORDS}') OR marks >= 4 AND 100 * marks > 25 * length(l)
            OR regexp_matches(l, '{MENU}') OR regexp_matches(l, '{NAVIGATION}') OR {" OR ".join(f"contains(lower(l), '{x}')" for x in NOTICES)}) AS fails FROM j),
    a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (worded) - count(DISTINCT l) FILTER (worded) AS dups, count(*) FILTER (fails) AS removed,
            coalesce(sum(seen) FILTER (fails), 0)::BIGINT AS lost FROM f GROUP BY r),
    b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{GAP}+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            dups AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, n_lines, removed AS n_removed, lost AS lost_chars FROM w JOIN a USING (r) LEFT JOIN p USING (r))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept FROM b"""

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weight=quality_weights(_table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_documents(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "lost_chars")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"), damage=True)


OPERATORS = (
    op1_exact_dedup,
    op2_vector_dedup,
    op3_token_files,
    op4_language_id,
    op5_mix_sources,
    op6_jaccard_join,
    op7_line_dedup,
    op8_toxicity_chain,
    op9_shard_documents,
    op10_pack_documents,
    op11_cross_tokenizer,
    op12_quality_rules,
    op13_conversation_repair,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op5_mix_sources": r"""
            WITH d AS (
              SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                     -ln((('0x' || md5('mix' || doc_id::VARCHAR)[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
                       / coalesce(q.weight, 1.0) AS key
              FROM documents LEFT JOIN (SELECT doc_id, 1.0::DOUBLE + max(quality) AS weight FROM labels GROUP BY doc_id) q USING (doc_id)),
            s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
                    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
            o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
                    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
            t AS (SELECT source, source_size, least(cap, weight * max((total - filled) / open_weight) OVER ()) AS target FROM o),
            e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
            b AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS budget FROM e),
            p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget,
                    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
                  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
            SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken FROM p""",
        "op12_quality_rules": QUALITY_SQL,
    }

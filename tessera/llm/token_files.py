"""Token files: each document's ids compressed apart with one shared zstandard dictionary.

Layout of a folder:

* ``data/<name>.tok``: 8 bytes ``TSRTOK01``, 32 bytes sha256 of the dictionary, then zstandard frames, one
  for each document, of its ids as little-endian unsigned integers (16 bits where the vocabulary allows, else 32).
* ``index`` (Parquet): doc_id, part, file, offset, length, n_tokens, first (ids before it in its part). Parts ascend by doc_id;
  a part is one task's and has one file or, where it is large, several in a row.
* ``meta`` (Parquet, one row): dictionary, its sha256, bytes of an id, end id.

A task writes its data file under a name of its own and reports it in the index, which Spark commits; files of
failed or repeated attempts are in no index and are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.memory import frugal, small_batches
from tessera.llm.tokens import encoder, with_end

MAGIC = b"TSRTOK01"
#: Documents that are read back at a time.
READ_ROWS = 1_000


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _sample(docs: DataFrame, tokenizer: str, end_id: int, width: int, n: int, most: int) -> list[bytes]:
    """The first ``most`` bytes of serialised ids of ``n`` documents, chosen by a hash of the id.

    Thin hashes are ranked first; only the chosen documents' texts are read. Of a repeated id any row may stand for it.
    """
    spark = docs.sparkSession
    place = F.xxhash64("doc_id")
    total = docs.count()
    # about twice as many as needed lie below this bound, so few rows are ranked, however many there are
    bound = int(min(1.0, (2 * n + 64) / max(1, total)) * (2**64 - 1)) - 2**63
    ranked = docs.where(place <= F.lit(min(bound, 2**63 - 1))).select(place.alias("h")).distinct().orderBy("h").limit(n)
    chosen = [r["h"] for r in ranked.collect()]  # n numbers at most
    if not chosen:
        return []

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, *coded in encoder(tokenizer).slices(b.column("text")):
                ids, at = with_end(*coded, end_id)
                raw = [ids[i:j].astype(f"<u{width}").tobytes()[:most] for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([pa.array(raw, pa.binary())], names=["raw"])

    own = spark.createDataFrame([(h,) for h in chosen], "h long")
    texts = docs.withColumn("h", place).join(F.broadcast(own), "h", "left_semi").select("text").limit(2 * n)
    return sorted(r["raw"] for r in texts.mapInArrow(frugal(serialised), "raw binary").collect())  # 2 n * most bytes at most


def train_dictionary(samples: list[bytes], dictionary_bytes: int) -> bytes:
    """A zstandard dictionary; empty where the samples are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = 32 << 20,
    most_parts: int = 16_384,
    dictionary_bytes: int = 64 << 10,
    sample_docs: int = 512,
    sample_bytes: int = 8 << 10,
    level: int = 3,
) -> None:
    """Writes all documents in ascending order of id. A null or empty text is the end id alone.

    Texts move once, to the part of their id's range, and are encoded and written there. There is a part for each
    ``file_bytes`` of text, ``most_parts`` at most; a large part's file is followed by another when it holds ``file_bytes``.
    Null ids come first. Repeated ids lie side by side, ordered by a hash of the text, equal texts are written as often as they occur;
    many rows of one id may span parts. An empty table makes an empty index. Other columns aren't read, whatever their names.
    The dictionary is trained on a bounded sample: ``sample_docs`` documents, ``sample_bytes`` of each; texts are written whole.
    """
    small_batches(docs.sparkSession, 4_000)  # pieces repeat, so larger slices have less to encode
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(-(-total // file_bytes), rows.sparkSession.sparkContext.defaultParallelism), most_parts)

    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(_sample(rows, tokenizer, end_id, width, sample_docs, sample_bytes), dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        store, root = _files(folder)
        name, out, offset, first, own = "", None, 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for row, *coded in encoder(tokenizer).slices(b.column("text")):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{root}/data", recursive=True)
                    name = f"{uuid.uuid4().hex}.tok"
                    out = store.open_output_stream(f"{root}/data/{name}")
                    out.write(MAGIC + digest)
                    offset = len(MAGIC) + len(digest)
                ids, at = with_end(*coded, end_id)
                raw = memoryview(ids.astype(f"<u{width}").tobytes())
                frames = [packer.compress(raw[i * width : j * width]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lengths = np.fromiter(map(len, frames), np.int64, len(frames))
                out.write(b"".join(frames))
                n = len(frames)
                yield pa.record_batch(
                    [b.column("doc_id").slice(row, n), pa.array(np.full(n, own, np.int32)), pa.array([name] * n), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(np.diff(at)), pa.array(first + at[:-1])],
                    names=["doc_id", "part", "file", "offset", "length", "n_tokens", "first"],
                )
                offset += int(lengths.sum())
                first += int(at[-1])
        if out is not None:
            out.close()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    order = ("doc_id", F.xxhash64("text"))
    index = (
        rows.repartitionByRange(int(parts), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(frugal(write), f"doc_id {id_type}, part int, file string, offset long, length long, n_tokens long, first long")
    )
    index.write.parquet(f"{folder}/index")
    meta = [(bytearray(dictionary), digest.hex(), width, end_id)]
    rows.sparkSession.createDataFrame(meta, "dictionary binary, sha256 string, width int, end_id int").coalesce(1).write.parquet(f"{folder}/meta")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ids are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. A filter on ``doc_id`` reaches the index, so that
    single documents are read by their offsets. A dictionary or file whose hash differs is refused.
    """
    meta = spark.read.parquet(f"{folder}/meta").first()
    dictionary, digest, width = bytes(meta["dictionary"]), bytes.fromhex(meta["sha256"]), meta["width"]
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError(f"the dictionary in {folder}/meta doesn't have the hash it is listed with")

    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, `most_parts` at most
    bases = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        store, root = _files(folder)
        name, source = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, READ_ROWS):
                b, raw = batch.slice(k, READ_ROWS), []
                for file, offset, length in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True):
                    if file != name:
                        name, source = file, store.open_input_file(f"{root}/data/{file}")
                        if source.read_at(len(MAGIC) + len(digest), 0) != MAGIC + digest:
                            raise ValueError(f"{file} was written with another dictionary")
                    ids = np.frombuffer(unpacker.decompress(source.read_at(length, offset)), f"<u{width}")
                    raw.append(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("first"), b.column("n_tokens"), pa.array(raw, pa.binary())], names=["doc_id", "part", "first", "n_tokens", "ids"])

    id_type = index.schema["doc_id"].dataType.simpleString()
    return (
        index.mapInArrow(frugal(read, "token files"), f"doc_id {id_type}, part int, first long, n_tokens long, ids binary")
        .join(F.broadcast(bases.withColumnRenamed("part", "p")), F.col("part") == F.col("p"), "left")
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
    )

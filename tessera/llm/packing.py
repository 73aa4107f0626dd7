"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of the sequence length and, for the rest, of the powers of two that sum to
it, longest first. A sequence is one piece: sequences of one length form a bucket, none crosses documents
and none needs padding. Sequences are numbered within their buckets where pieces are made, so nothing is shuffled;
``write_buckets`` lays the buckets out as folders of their own, from which batches of one length are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import frugal, give_back, small_batches
from tessera.llm.tokens import encoder, with_end

#: Bits of a sequence's number within its bucket and task, and of the task's number.
NUMBER_BITS, TASK_BITS = 36, 22
#: Pieces that a worker keeps, and bytes of text that it cuts at a time. An executor has more idle workers than tasks, and each keeps its own.
CACHED, SLICE_BYTES = 200_000, 1 << 20


def decompose(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``tokens`` ids each: every piece's document, start and length, in order."""
    powers = 1 << np.arange(longest.bit_length() - 1)[::-1]
    whole = tokens // longest
    rest = (tokens % longest)[:, None] & powers[None, :]
    n = whole + (rest > 0).sum(1)
    doc = np.repeat(np.arange(len(tokens)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    length = np.full(len(doc), longest, np.int64)
    length[nth >= whole[doc]] = rest[rest > 0]  # rows of rest are in the order of the documents
    ends = np.cumsum(length)
    return doc, ends - length - np.repeat(np.cumsum(tokens) - tokens, n), length


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    longest: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit integers; each document ends with ``end_id`` and a null or empty
    text is that id alone. ``longest`` is a power of two. ``sequence_id`` is unique: the bucket (0 for
    length 1, 1 for length 2 and so on), the task, then the number within the two, so ids of one bucket lie together. Each sequence
    is one piece, so ``offset`` is 0. Repeated rows and rows with a null id are packed as often as they occur, equal texts alike;
    very long texts are cut like others. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() % (1 << TASK_BITS)
        made = np.zeros(longest.bit_length(), np.int64)
        for b in batches:
            for first, *slice_ in encoder(tokenizer, CACHED).slices(b.column("text"), SLICE_BYTES):
                ids, at = with_end(*slice_, end_id)
                tokens = np.diff(at)
                doc, start, length = decompose(tokens, longest)
                offsets = np.append(at[doc] + start, at[-1]) * 4
                wide = offsets[-1] >= 1 << 31
                raw = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])
                bucket = np.log2(length).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                n = np.bincount(bucket, minlength=len(made))
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(made, n)
                made += n
                sequence = (bucket << (TASK_BITS + NUMBER_BITS)) + (task << NUMBER_BITS) + number
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(first + doc)), pa.array(start), pa.array(length), raw, pa.array(tokens[doc]), pa.array(sequence), pa.array(np.zeros(len(doc), np.int64))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        frugal(pack), f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Writes packed sequences as Parquet with a folder for each bucket (``length=<n>``); rows are sorted by bucket where they lie, none moves."""
    packed.write.partitionBy("length").parquet(folder)

"""Sharding by histogram sort.

Documents are ordered by (hash of the text, id), so equal texts lie side by side. Splitters that cut this
order into shards of equal bytes are found by probing: each round counts, over all partitions, the exact
bytes below candidate boundaries, and asks finer probes where a splitter isn't yet within tolerance. When all
are, the documents move once, each straight to its shard. Only the boundaries between shards are asked for, so what is
sent doesn't grow with the data; a large shard's rows are dealt to several tasks by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.memory import frugal
from tessera.llm.storage import checkpointed

#: Keys are 128 bits: the text's hash above the id, both shifted to be unsigned.
_TOP, _SIGN = 1 << 128, 1 << 63


def _key_parts(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    high = np.array([k >> 64 for k in keys], dtype=np.uint64)
    low = np.array([k & (2**64 - 1) for k in keys], dtype=np.uint64)
    return high, low


def _slots(h: np.ndarray, d: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row's key (h, d): how many of the sorted probes are at most the key."""
    first, last = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
    out = last.copy()
    for i in np.unique(first[first < last]):  # rows whose hash is a probe's: their ids decide
        rows = first == i
        j = last[rows][0]
        same = rows & (last == j)
        out[same] = i + np.searchsorted(low[i:j], d[same], "right")
    return out


def _unsigned(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def find_splitters(keys: DataFrame, pieces: int, tolerance: float, probes: int = 32, rounds: int = 24) -> list[int]:
    """Boundaries of ``pieces`` shards of about equal bytes in the order of (``h``, ``d``); ``size`` weighs.

    Each round sends at most ``pieces * probes`` boundaries out and as many sums back. A splitter is done
    when the bytes below it are within ``tolerance`` of a piece of its goal, or no row lies between probes.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total or pieces < 2:
        return [_TOP] * (pieces - 1)
    goals = [total * i / pieces for i in range(1, pieces)]
    # for each splitter: a boundary known to lie below with its bytes, one above, and rows between
    spans = [(0, 0, _TOP, total, None) for _ in goals]
    done: list[int | None] = [None] * len(goals)
    for _ in range(rounds):
        ask = set()
        for (lo, _, hi, _, _), d in zip(spans, done, strict=True):
            if d is None:
                n = probes if lo or hi < _TOP else pieces * probes
                ask.update(lo + (hi - lo) * k // n for k in range(1, n))
                ask.update((lo, hi))
        ask = sorted(a for a in ask if 0 < a < _TOP)
        high, low = _key_parts(ask)
        n = len(ask) + 1

        def count(batches: Iterator[pa.RecordBatch], high=high, low=low, n=n) -> Iterator[pa.RecordBatch]:
            size, rows = np.zeros(n), np.zeros(n)
            for b in batches:
                at = _slots(_unsigned(b.column(0)), _unsigned(b.column(1)), high, low)
                size += np.bincount(at, b.column(2).to_numpy(zero_copy_only=False), n)
                rows += np.bincount(at, minlength=n)
            at = np.flatnonzero(rows)
            yield pa.record_batch([pa.array(at), pa.array(size[at].astype(np.int64)), pa.array(rows[at].astype(np.int64))], names=["at", "size", "rows"])

        found = (
            keys.select("h", "d", "size")
            .mapInArrow(frugal(count), "at long, size long, rows long")
            .groupBy("at")
            .agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
            .collect()  # a row for each probe at most
        )
        sizes, counts = np.zeros(n), np.zeros(n)
        for r in found:
            sizes[r["at"]], counts[r["at"]] = r["size"], r["rows"]
        below, rows_below = np.cumsum(sizes), np.cumsum(counts)
        edges = [0, *ask, _TOP]
        at_edge, rows_at = np.concatenate([[0], below]), np.concatenate([[0], rows_below])
        for i, goal in enumerate(goals):
            if done[i] is not None:
                continue
            j = int(np.searchsorted(at_edge, goal, "right")) - 1  # bytes below edges[j] <= goal
            j = min(max(j, 0), len(edges) - 2)
            near = min((j, j + 1), key=lambda e: abs(at_edge[e] - goal))
            if abs(at_edge[near] - goal) <= tolerance * total / pieces or rows_at[j + 1] - rows_at[j] <= 1 or edges[j + 1] - edges[j] <= 1:
                done[i] = edges[near]
            else:
                spans[i] = (edges[j], at_edge[j], edges[j + 1], at_edge[j + 1], None)
        if all(d is not None for d in done):
            break
    return [d if d is not None else s[0] for d, s in zip(done, spans, strict=True)]


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bytes: int = 256 << 20,
    tolerance: float = 0.001,
) -> DataFrame:
    """All documents as ``doc_id, text, size, shard, slot``; shards are of nearly equal bytes.

    ``size`` is the text's UTF-8 bytes plus 16 (null: 16); a very long text is cut nowhere, so its shard may be larger by it.
    The rows of shards above ``piece_bytes`` are dealt to several tasks, and ``slot`` counts on from piece to piece, gapless
    from 0 in each shard. Null and empty texts share a hash. Ids of any type are ordered by a hash unless they are integers.
    Equal texts lie side by side in the order and are parted only where a shard ends among them; of repeated rows that agree
    in id and text all go to one shard. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-_SIGN)) if whole else F.xxhash64(id_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        d.alias("d"),
    )
    keys = checkpointed(sized.select("h", "d", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (shards * piece_bytes)))
    pieces = int(shards * per_shard)
    high, low = _key_parts_closed(find_splitters(keys, shards, tolerance))

    @F.arrow_udf("int")
    def shard(h: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array(_slots(_unsigned(h), _unsigned(d), high, low).astype(np.int32))

    piece = (F.col("shard") * F.lit(per_shard) + F.pmod(F.xxhash64("d", "h"), F.lit(per_shard))).cast("int")
    placed = sized.withColumn("shard", shard("h", "d")).withColumn("piece", piece)  # the texts stay in the JVM
    counts = keys.select("h", "d").withColumn("shard", shard("h", "d")).select("shard", piece.alias("p")).groupBy("shard", "p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    bases = counts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("piece").orderBy("h", "d")
    numbered = placed.repartitionById(pieces, F.col("piece")).withColumn("n", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(bases) if pieces <= 100_000 else bases, F.col("piece") == F.col("p"), "left")
    return joined.select("doc_id", "text", "size", "shard", (F.col("base") + F.col("n") - 1).alias("slot"))


def _key_parts_closed(splitters: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Splitters at the top of the key space keep every row below them."""
    return _key_parts([min(s, _TOP - 1) for s in splitters])

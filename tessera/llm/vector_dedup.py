"""Near-duplicate vectors with a forest of random-projection trees.

Each tree cuts the vectors by random directions, again and again. A cut is placed where few vectors lie, and those
within a margin of it go to both sides (spill), so that close vectors seldom part; a pair that one
tree parts meets in another. Vectors are compared in double precision within leaves only. A pair is counted in the
first leaf that both share, so each link counts once and no list of pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.memory import frugal
from tessera.llm.storage import checkpointed, written


@dataclass
class Tree:
    """Inner nodes have a direction, a cut and two children; leaves are numbered from ``first_leaf``."""

    directions: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)  # >= 0: a node; < 0: leaf -1 - x
    leaves: int = 0


def fit_tree(sample: np.ndarray, seed: int, leaf: int, margin: float, tries: int = 6) -> Tree:
    """A tree over unit vectors; nodes of at most ``leaf`` sampled vectors, or that no cut splits well, are leaves."""
    random, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        best = None
        if len(rows) > leaf:
            for _ in range(tries):
                d = random.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                x = np.sort(sample[rows] @ d)
                for q in np.linspace(0.3, 0.7, 9):
                    cut = x[int(q * (len(x) - 1))]
                    left, right = np.searchsorted(x, cut + margin, "left"), len(x) - np.searchsorted(x, cut - margin, "right")
                    cost = max(left, right) / len(x) + 0.5 * (left + right - len(x)) / len(x)
                    if best is None or cost < best[0]:
                        best = (cost, d, cut, max(left, right))
        if best is None or best[3] > 0.9 * len(rows):
            tree.leaves += 1
            return -tree.leaves
        _, d, cut, _ = best
        at = len(tree.cuts)
        tree.directions.append(d)
        tree.cuts.append(float(cut))
        tree.children.append([0, 0])
        side = sample[rows] @ d - cut
        tree.children[at] = [grow(rows[side < margin]), grow(rows[side > -margin])]
        return at

    grow(np.arange(len(sample)))
    return tree


def leaves_of(tree: Tree, vectors: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, leaf) for each leaf that a vector falls or spills into."""
    found_rows, found = [], []
    open_nodes = [(0 if tree.cuts else -1, np.arange(len(vectors)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if not len(rows):
            continue
        if node < 0:
            found_rows.append(rows)
            found.append(np.full(len(rows), -1 - node))
            continue
        side = vectors[rows] @ tree.directions[node] - tree.cuts[node]
        low, high = tree.children[node]
        open_nodes += [(low, rows[side < margin]), (high, rows[side > -margin])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_rows), np.concatenate(found)


def compare_leaf(own: int, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, leaves: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the weight of the rows it links with here, and the smallest id reached by links found here.

    Rows ``left`` meet rows ``right`` (``same``: one set). A pair that shares an earlier leaf is left to that one.
    """
    links = vectors[left] @ vectors[right].T >= cosine
    if same:
        np.fill_diagonal(links, False)
    hit = np.union1d(left[links.any(1)], right[links.any(0)])
    earlier = {x: i for i, x in enumerate(sorted({x for r in hit for x in leaves[r] if x < own}))}
    if earlier:
        shared = np.zeros((len(ids), len(earlier)), np.float32)
        for r in hit:
            shared[r, [earlier[x] for x in leaves[r] if x < own]] = 1
        links &= shared[left] @ shared[right].T == 0
    counts = np.zeros(len(ids), np.int64)
    counts[left] += links @ weights[right]
    if not same:
        counts[right] += weights[left] @ links
    low = ids.copy()
    a, b = np.nonzero(links)
    u, v = left[a], right[b]
    while len(u):
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        if (new == low).all():
            break
        low = new
    return counts, low


def _fitted(firsts: DataFrame, dim: int, total: int, trees: int, fit_rows: tuple[int, int], leaf_rows: int, margin: float) -> list[Tree]:
    """A forest for the vectors of one length, fitted on a bounded sample: one in 32 of them, within ``fit_rows``."""
    n = min(fit_rows[1], max(fit_rows[0], total // 32))
    place = F.xxhash64(F.lit(11), "vec_id")
    # about twice as many as needed lie below this bound, so few are ranked
    bound = min(2**63 - 1, int(min(1.0, (2 * n + 64) / max(1, total)) * (2**64 - 1)) - 2**63)
    sampled = firsts.where((F.size("v") == dim) & (place <= F.lit(bound))).orderBy(place, "vec_id").limit(n).select("v").toArrow().column("v")
    sample = sampled.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) if len(sampled) else np.zeros((0, dim))
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    per_leaf = max(16, int(leaf_rows * len(sample) / max(1, total)))
    return [fit_tree(sample, t, per_leaf, margin) for t in range(trees)]


def vector_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.9,
    trees: int = 6,
    fit_rows: tuple[int, int] = (16_384, 131_072),
    leaf_rows: int = 512,
    spill: float = 0.25,
    block: int = 512,
    most_lengths: int = 64,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing; vectors of unlike lengths don't
    link. Equal vectors are compared once and count as links of each other. Of repeated ids each row counts as a vector; a null id
    links with nothing. An empty table gives no rows; other columns aren't read, whatever their names.
    Each length has a forest, fitted on a bounded sample (one vector in 32, ``fit_rows`` at least and at most), and all
    vectors are dealt to leaves; ``spill`` is the margin as a part of the largest distance that links. Lengths of ``leaf_rows`` vectors or
    fewer, and those beyond the ``most_lengths`` most frequent, are one leaf each.
    Leaves of more than ``block`` vectors are compared in block pairs by several tasks: nothing is capped.
    """
    spark = vectors.sparkSession
    source = vectors.schema[vector_col].dataType
    single = getattr(getattr(source, "elementType", None), "typeName", lambda: "")() == "float"  # sent as they are, compared in double precision
    kind, raw_type = ("float", np.float32) if single else ("double", np.float64)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    keyed = written(raw.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), F.col("v")).alias("v")).withColumns({"k": F.xxhash64("v"), "h": F.xxhash64(F.lit(7), "v")}), "vectors")
    valid = keyed.where("v is not null")
    firsts = checkpointed(valid.groupBy("k", "h").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    lengths = firsts.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > leaf_rows).orderBy(F.desc("c"), "n").limit(most_lengths).collect()
    forests, base = {}, 0
    for n, c in lengths:
        margin = spill * np.sqrt(2 - 2 * cosine) / np.sqrt(n)
        forest = _fitted(firsts, n, c, trees, fit_rows, leaf_rows, margin)
        bases = base + np.cumsum([0, *(t.leaves for t in forest)])
        forests[n], base = (forest, bases[:-1], margin), int(bases[-1])
    shared = spark.sparkContext.broadcast(forests)  # directions of at most `trees` * `fit_rows` / 16 nodes for each length

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                own = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(raw_type).reshape(len(at), n)
                if n in shared.value:
                    forest, bases, margin = shared.value[n]
                    x = own.astype(float)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    rows, leaf = (np.concatenate(p) for p in zip(*((r, le + first) for t, first in zip(forest, bases, strict=True) for r, le in [leaves_of(t, x, margin)]), strict=True))
                else:
                    rows, leaf = np.arange(len(at)), np.full(len(at), -1 - n)
                order = np.lexsort((leaf, rows))
                rows, leaf = rows[order], leaf[order].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(at) + 1)).astype(np.int32)), pa.array(leaf))
                sent = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * n * own.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(took) for c in ("k", "vec_id", "weight")), sent, listed], names=["k", "vec_id", "weight", "raw", "leaves"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, a, b = key
        ids, weights = rows["vec_id"].to_numpy(), rows["weight"].to_numpy()
        x = np.frombuffer(b"".join(rows["raw"]), raw_type).astype(float).reshape(len(rows), -1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rows["part"].to_numpy()
        counts, low = compare_leaf(own, ids, weights, x, list(rows["leaves"]), np.flatnonzero(side == a), np.flatnonzero(side == b), a == b, cosine)
        out = (counts > 0) | (low != ids)
        return pd.DataFrame({"k": rows["k"].to_numpy()[out], "vec_id": ids[out], "links": counts[out], "low": low[out]})

    found_type = "k long, vec_id long, links long, low long"
    dealt = written(firsts.select("k", "vec_id", "weight", "v").mapInArrow(frugal(deal), "k long, vec_id long, weight long, raw binary, leaves array<int>"), "dealt")
    sizes = dealt.select(F.explode("leaves").alias("l")).groupBy("l").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    few = base + most_lengths < 1_000_000  # a row for each leaf
    placed = dealt.withColumn("leaf", F.explode("leaves")).join(F.broadcast(sizes) if few else sizes, F.col("leaf") == F.col("l"), "left").withColumn("part", F.pmod(F.xxhash64("k"), "parts").cast("int"))
    meeting = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "k", "vec_id", "weight", "raw", "leaves")
    found = checkpointed(meeting.groupBy("leaf", "a", "b").applyInPandas(compare, found_type))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))  # by vector: rows of a repeated id may hold several
    components = connected_components(found.select(F.col("vec_id").alias("u"), F.col("low").alias("v")))
    groups = checkpointed(
        firsts.select("k", "h", "vec_id", "weight")
        .join(links, "k", "left")
        .join(components, F.col("vec_id") == F.col("node"), "left")
        .select(F.col("k").alias("_k"), F.col("h").alias("_h"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    able = F.col("v").isNotNull()
    return (
        keyed.select("vec_id", "k", "h", able.alias("able"))
        .join(groups, (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")) & F.col("able"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )

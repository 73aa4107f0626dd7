"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import checkpointed, release


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b) and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, low = union(b.column(0).to_numpy(), b.column(1).to_numpy())
        out = nodes != low
        yield pa.record_batch([pa.array(nodes[out]), pa.array(low[out])], names=["u", "v"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for each node of ``edges`` (columns u, v: long, no nulls) that isn't its component's smallest.

    Edges are contracted where they lie, then each round hangs every node's neighbours under the smallest of them;
    rows never grow beyond the edges. A round costs shuffles of two-column rows.
    """
    now = checkpointed(edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = down.join(low, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = checkpointed(small)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            del both, low, large, down, small
            release(edges.sparkSession)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError(f"no end after {rounds} rounds")

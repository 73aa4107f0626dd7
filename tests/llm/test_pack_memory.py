"""Packing keeps little in a worker: short slices, few remembered pieces, the same ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm import packing
from tessera.llm.tokens import encoder


def test_slices_are_short_and_ids_stay(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([f"some words, {k} of them. " * 12_000 for k in range(12)] + [None, "", "x " * 800_000])
    one = encoder(path, packing.CACHED)
    firsts, ids, bounds = zip(*one.slices(texts, packing.SLICE_BYTES), strict=True)
    sizes = [sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) for a, b in zip(firsts, [*firsts[1:], len(texts)], strict=True) if b - a > 1]
    assert len(firsts) > 4 and max(sizes) <= packing.SLICE_BYTES < 4 << 20
    assert one.cache == packing.CACHED < encoder(path).cache
    whole, at = encoder(path).encode(texts)
    assert np.array_equal(np.concatenate(ids), whole) and sum(len(b) - 1 for b in bounds) == len(at) - 1


def test_packing_asks_for_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        packed = packing.pack_documents(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 1)
        assert spark.conf.get(name) == "1000" and sum(r.length for r in packed.collect()) == 5
    finally:
        spark.conf.set(name, before)

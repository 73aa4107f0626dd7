"""The pipeline's mixing stage against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def copies(rows, weight):
    """Copies per id: whole epochs, then whole documents in the order of -ln(u) / weight."""
    names = sorted({s for _, _, s in rows})
    size = {i: len(t.split()) for i, t, _ in rows}
    own = {s: [i for i, _, x in rows if x == s] for s in names}
    total = {s: sum(size[i] for i in own[s]) for s in names}
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2.0 * total[s] <= level * w[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * w[s]
        left -= sum(2.0 * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = Counter()
    for s in names:
        epochs = math.floor(target[s] / total[s])
        budget = math.floor(target[s] - epochs * total[s])
        key = {i: -math.log((int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)) / weight.get(i, 1.0) for i in own[s]}
        for i in sorted(own[s], key=lambda i: (key[i], i)):
            out[i] = epochs + (2 * max(0, min(size[i], budget)) >= size[i])
            budget -= size[i]
    return +out


def test_mix_weighs_by_quality(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(5)
    rows = [(i, "word " * r.randrange(1, 60), "abc"[i % 3]) for i in range(600)]
    labels = [(i, r.randrange(2), 0) for i in range(600) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = c.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path))
    want = copies(rows, {i: 1.0 + q for i, q, _ in labels})
    assert Counter(x.doc_id for x in got.collect()) == want != copies(rows, {})

"""Large stars of near copies: the centre first, then only what doesn't link with it."""

import random

import pytest


def groups(sets, percent):
    low = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in range(len(sets)):
        before = dict(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low
    return low


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_one_text(spark, seed):
    from tessera.llm.near_dedup import jaccard_groups

    r = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):  # some close to the base, some close to each other alone
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 8])):
            words[r.randrange(len(words))] = f"x{r.randrange(4)}"
        texts.append(" ".join(words[: 120 - r.randrange(3)]))
    texts += texts[:20] + [" ".join(f"y{r.randrange(9)}" for _ in range(60)) for _ in range(20)]
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in enumerate(t.split() for t in texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.component_id for x in jaccard_groups(docs, 3, 90, star=8, block=16).collect()}
    assert got == groups(sets, 90)

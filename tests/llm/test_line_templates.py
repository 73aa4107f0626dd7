"""Line templates: places that vary in plain words, short lines, scripts without spaces."""

import random

import pytest


def test_lines_that_differ_in_plain_words_share_a_template(spark):
    from tessera.llm.line_dedup import dedup_lines

    r = random.Random(2)
    passage = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    rows, want = [], {}
    for i in range(40):  # a passage of which each copy has another word, a name in a sentence, a line of its own
        own = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12))
        words = list(passage)
        words[5 + i] = "changed"
        named = "The report was written by our friend {} in the spring of last year".format(["Anna", "Boris", "Chloe"][i % 3])
        rows.append((i, "\n".join([own, " ".join(words), named])))
        want[i] = rows[0][1] if i == 0 else own
    far = ["The same two words lead to quite other things here", "The same two words lead on where nothing else agrees"]
    rows += [(100 + i, x) for i, x in enumerate(far)]
    want |= {100 + i: x for i, x in enumerate(far)}
    assert {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


def test_lines_that_agree_have_a_key_in_common():
    import numpy as np

    from tessera.llm.line_dedup import DIFFER, part_keys

    rng = np.random.default_rng(4)
    for n in range(5, 80):
        a = rng.integers(1, 1 << 32, n, np.uint64)
        for _ in range(5):
            b = a.copy()
            b[rng.choice(np.arange(2, n), n // DIFFER, replace=False)] += np.uint64(7)
            keys, of = part_keys(np.concatenate([a, b]), np.array([0, n, 2 * n]), 2)
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


@pytest.mark.parametrize("n,far", [(700, (2, 4)), (60, (3, 4)), (1300, (4, 4))])
def test_no_agreeing_pair_is_lost_in_a_large_leaf(spark, n, far):
    """Lines of 20 tokens that differ from a common line, which isn't there, at some places: merged as by comparing all with all."""
    import numpy as np

    from tessera.llm.line_dedup import DIFFER, dedup_lines

    r = random.Random(n)
    base = [f"word{'abcdefghijklmnopqrstuvw'[i]}" for i in range(20)]
    lines = []
    for _ in range(n):
        own = list(base)
        for k in r.sample(range(2, 20), r.choice(far)):
            own[k] = "w" + "".join(r.choice("abcdefghij") for _ in range(6))
        lines.append(own)
    coded = {t: i for i, t in enumerate({t for x in lines for t in x})}
    rows = np.array([[coded[t] for t in x] for x in lines])
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(n):
        for j in np.flatnonzero((rows[:i] == rows[i]).sum(1) >= 20 - 20 // DIFFER):
            root[find(i)] = find(int(j))
    want = n - len({find(i) for i in range(n)})
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(4)
    assert dedup_lines(docs).where("n_dropped > 0").count() == want

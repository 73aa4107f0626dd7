"""Alignment against whole texts encoded by the two libraries and plain loops over byte ranges."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest

P = pytest.importorskip("public_tokenizers")

ODD = ["a  b   c ", " ", "   ", "\n\n x\r\n\ty", "<|endoftext|> and </s> <unk> <0x41>", "café naïve 你好世界 \U0001f600\U0001f468‍\U0001f469 ไทย", "mark ▁ inside", "\x00null", "é", "don't we'll 12345 ::: ---", "x" * 3000, "", None]


def brute(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = {}, 256
    for x in range(256):
        letters[chr(x if x in shown else free)] = x
        free += x not in shown
    name = {i: t for t, i in a.get_vocab().items()}
    out = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spelt_a = [bytes(letters[c] for c in name[i]) for i in ids_a]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(spelt_a) != (" " + t).encode() or b"".join(spelt_b) != (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = list(accumulate(map(len, spelt_a))), list(accumulate(map(len, spelt_b)))
        groups, links, i, j = [], [], 0, 0
        both = set(ends_a) & set(ends_b)
        while i < len(ids_a):
            k, n = i, j
            while ends_a[k] not in both:
                k += 1
            while ends_b[n] not in both:
                n += 1
            groups.append(",".join(map(str, ids_a[i : k + 1])) + "|" + ",".join(map(str, ids_b[j : n + 1])))
            links.append((ids_a[k], ids_b[n]))
            i, j = k + 1, n + 1
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def expected(texts):
    found = brute(texts)
    count = Counter(p for *_, links in found for p in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    return [
        (n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", ";".join(groups))
        for n_a, n_b, groups, links in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("batch", [1 << 24, 300])
def test_odd_texts_align_as_by_hand(spark, monkeypatch, batch):
    from tessera.llm import alignment

    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)  # goes to the tasks with the function that reads it
    texts = ODD + ODD[:6] + [f"word {i} of many, many words." for i in range(40)]
    rows = [(i if i != 7 else None, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string, pairs int").repartition(3)
    got = alignment.align_documents(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), groups=True).collect()
    want = {i if i != 7 else None: x for i, x in enumerate(expected(texts))}
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(rows)
    assert alignment.align_documents(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_ends_by_span_are_all_ends():
    import numpy as np

    from tessera.llm import alignment

    g = np.random.default_rng(3)
    ends_a, ends_b = (np.unique(np.append(g.integers(1, 5_000_000, 40_000), 5_000_000)) for _ in range(2))
    got = alignment.shared_ends(ends_a, ends_b)
    common, at_a, at_b = np.intersect1d(ends_a, ends_b, return_indices=True)
    assert np.array_equal(got[0], at_a) and np.array_equal(got[1], at_b) and len(common) > 100
    assert all(len(x) == 0 for x in alignment.shared_ends(ends_a[:0], ends_b[:0]))


def test_registered_query_matches_brute_force(spark):
    from tessera.llm.queries import op11_cross_tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: x[:-1] for d, x in zip(docs, expected([d.text for d in docs]), strict=True)}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS[:-1]) for r in op11_cross_tokenizer(spark, "/root/testdata/sf0.001").collect()}
    assert got == want

"""Operators against brute force on small tables: languages, mixes, shards, vectors, chains, line templates, odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")


def test_a_words_likelihood_sums_all_segmentations():
    from tessera.llm.language import START, _table, log_likelihood

    pieces = {p: i for i, p in enumerate([START, START + "a", "a", "b", "ab", "ba", "aba", START + "ab"])}
    p = np.random.default_rng(1).random((len(pieces), 2)) / 8
    table = _table(p)

    def total(text, lang):
        if not text:
            return 1.0
        out = 1e-7 * total(text[1:], lang)  # a bare character
        for n in range(1, 5):
            if text[:n] in pieces and len(text) >= n:
                own = p[pieces[text[:n]], lang]
                out += own * total(text[n:], lang) - (1e-7 * total(text[1:], lang) if n == 1 else 0)  # a piece of one character in its place
        return out

    for word in ("a", "ab", "abab", "baab", "aba"):
        got = log_likelihood([word], pieces, table, 4)[0]
        assert got == pytest.approx([math.log(total(START + word, k)) for k in (0, 1)])


def test_mix_follows_the_order_of_keys(spark):
    from tessera.llm.mixing import mix_sources

    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(0, 30)), r.choice(["a", "b", "c", None]) if i % 3 else "a") for i in range(200)]
    weights = [(i, 1.0 + i % 2) for i in range(0, 200, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {x.doc_id: x for x in mix_sources(docs, weight=spark.createDataFrame(weights, "doc_id long, weight double"), range_rows=20).collect()}
    weight = dict(weights)

    def key(i):
        u = (int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -math.log(u) / weight.get(i, 1.0)

    for s in ("a", "b", "c", None):
        own = sorted((key(i), i, len(t.split())) for i, t, x in rows if x == s)
        size = sum(n for *_, n in own)
        epochs = math.floor(got[own[0][1]].target / size)
        left = math.floor(got[own[0][1]].target - epochs * size)
        for _, i, n in own:
            extra = max(0, min(n, left))
            left -= extra
            assert (got[i].size, got[i].source_size, got[i].taken) == (n, size, epochs * n + extra)


def test_shards_are_even_and_keep_equal_texts_together(spark):
    from tessera.llm.sharding import shard_documents

    r = random.Random(5)
    texts = ["".join(r.choice("abé") for _ in range(r.randrange(40, 80))) for _ in range(900)]
    rows = [(i, texts[i] if i % 6 else texts[0], "x") for i in range(900)] + [(1000, None, "x"), (1001, "", "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    for pieces in (1 << 28, 2000):  # the second deals a shard to several tasks
        got = shard_documents(docs, shards=5, piece_bytes=pieces).collect()
        assert sorted(x.doc_id for x in got) == sorted(x[0] for x in rows)
        total = sum(x["size"] for x in got)
        for s in range(5):
            own = [x for x in got if x.shard == s]
            assert sorted(x.slot for x in own) == list(range(len(own)))
            assert abs(sum(x["size"] for x in own) - total / 5) <= 0.02 * total / 5 + 200
        assert all(x["size"] == len((x.text or "").encode()) + 16 for x in got)
        for t in {x.text for x in got if x.text and x.text != texts[0]}:
            assert len({x.shard for x in got if x.text == t}) == 1
    named = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    assert {x.doc_id for x in shard_documents(named, shards=2).collect()} == {"a", "b"}


def test_registered_shards_show_their_texts_crc(spark):
    from tessera.llm.queries import op9_shard_documents

    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for x in op9_shard_documents(spark, "/root/testdata/sf0.001").collect():
        assert x.text_crc32 == zlib.crc32((docs[x.doc_id] or "").encode())


@pytest.mark.parametrize("leaf_rows", [40, 4000])
def test_vectors_of_all_lengths(spark, leaf_rows):
    from tessera.llm.vector_dedup import vector_groups

    g = np.random.default_rng(6)
    rows = []
    for dim, n in ((8, 150), (5, 60), (3, 4), (2, 3)):
        base = g.standard_normal((n, dim)).astype(np.float32)
        base[n // 2 :] = base[: n - n // 2] + 0.02 * g.standard_normal((n - n // 2, dim)).astype(np.float32)
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(base)]
    rows += [(5, rows[7][1]), (900, [0.0] * 8), (901, None), (None, rows[0][1]), (902, [float("inf")] * 3)]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), trees=12, leaf_rows=leaf_rows, block=32).collect()
    assert len(got) == len(rows)
    able = [(i, np.array(v, float)) for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v)]
    links, low = [0] * len(able), [i for i, _ in able]
    pairs = [(a, b) for a in range(len(able)) for b in range(a) if len(able[a][1]) == len(able[b][1]) and able[a][1] @ able[b][1] / (np.linalg.norm(able[a][1]) * np.linalg.norm(able[b][1])) >= 0.9]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(20):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    want = sorted((i, n, c) for (i, _), n, c in zip(able, links, low, strict=True) if i != 5)
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got if x.vec_id is not None and x.vec_id not in (5, 900, 901, 902)) == want
    assert all(x.n_links == 0 and x.kept for x in got if x.vec_id in (900, 901, 902))


def test_chain_feeds_earlier_probabilities(spark):
    from tessera.llm.toxicity import ToxicityChain, score_toxicity

    import pyarrow as pa

    chain = ToxicityChain(("a", "b"), {"bad": 0, "good": 1}, [np.array([2.0, -1.0, 0.5]), np.array([1.0, 0.0, 3.0, -2.0])])
    got = chain.probabilities(pa.array(["bad bad", "Good.", "", None, "bad good"]))
    s = lambda z: 1 / (1 + math.exp(-z))
    first = [s(2.5), s(-0.5), s(0.5), s(0.5), s(1.5)]
    assert got[:, 0] == pytest.approx(first)
    assert got[:, 1] == pytest.approx([s(w + 3 * p - 2) for w, p in zip([1, 0, 0, 0, 1], first, strict=True)])
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    scored = score_toxicity(docs, labels).collect()
    assert len(scored) == 5 and len({x.p_toxic for x in scored if x.doc_id == 3}) == 1


def test_line_templates_by_brute_force(spark):
    from tessera.llm.line_dedup import DIFFER, dedup_lines

    r = random.Random(8)
    names = ["alice", "bob", "carol", "dora", "emil"]
    docs = {}
    for i in range(60):
        lines = [f"Posted by {r.choice(names)} in {r.choice(['general', 'sports'])} news today", f"{r.choice(['Seen', 'Read'])} {r.randrange(99)} times by the people of this town", " ".join(r.choice("pqrstuv") * 6 for _ in range(r.randrange(3, 9))), "short"]
        docs[i] = [x for x in lines if r.random() < 0.8]

    def masked(line):
        return tuple(None if any(c.isdigit() for c in t) else t for t in line.split())

    every = sorted({masked(x) for lines in docs.values() for x in lines}, key=str)
    group = {m: m for m in every}

    def judged(m):
        return sum(t is not None for t in m) >= 5 or sum(len(t) for t in m if t) >= 16

    def root(m):
        while group[m] != m:
            m = group[m]
        return m

    for a in every:
        for b in every:
            same = [x == y for x, y in zip(a, b)] if len(a) == len(b) else []
            if judged(a) and judged(b) and len(a) >= 5 and len(a) == len(b) and a[:2] == b[:2] and sum(same) >= len(a) - len(a) // DIFFER and sum(s and x is not None for s, x in zip(same, a)) >= 5:
                group[root(b)] = root(a)
    held = {}
    for i, lines in docs.items():
        for x in lines:
            if judged(masked(x)):
                held.setdefault(root(masked(x)), set()).add(i)
    want = {i: "\n".join(x for x in lines if not judged(masked(x)) or len(held[root(masked(x))]) < 2 or min(held[root(masked(x))]) == i) for i, lines in docs.items()}
    got = dedup_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.text for x in got} == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, own string, gone string, cut string, row string, found string, times int, hashed string, nth int"


def test_stages_with_odd_tables(spark):
    import corpus_pipeline as c

    line = "the same line of many words comes back again and again here"
    rows = [(None, line, "en"), (None, None, None), (1, line + "\n" + line, "en"), (1, line, "en"), (2, "", "en"), (3, " \n", None), (4, line + " more " * 5000, "en"), (4, line + " more " * 5000, "en")]
    docs = spark.createDataFrame([(i, t, lang, None, 0, "o", "g", "c", "r", "f", 1, "h", 2) for i, t, lang in rows], ODD)
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        assert all(x.own == "o" and x.row == "r" for x in out.collect())
    packed = c.pack(spark, docs, "/root/testdata/sf0.001").collect()
    assert sum(x.start == 0 for x in packed) == len(rows)


def test_exact_dedup_keeps_lone_null_ids(spark):
    from tessera.llm.exact_dedup import drop_exact_duplicates

    rows = [(None, "alone"), (None, "shared"), (2, "shared"), (1, "shared"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("d"))
    assert sorted(((x.doc_id, x.text) for x in drop_exact_duplicates(docs).collect()), key=str) == sorted([(None, "alone"), (2, "shared"), (4, "")], key=str)


def test_buckets_hold_one_length(spark, tmp_path):
    from tessera.llm.packing import pack_documents, write_buckets

    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(30)] + [(None, "x")], "doc_id long, text string").repartition(3)
    packed = pack_documents(docs, P.path("word_bpe_49k.json"), 1, longest=64)
    rows = packed.collect()
    assert len({x.sequence_id for x in rows}) == len(rows) and all(x.sequence_id >> 58 == x.length.bit_length() - 1 for x in rows)
    write_buckets(packed, str(tmp_path / "b"))
    assert {int(d.name.split("=")[1]) for d in (tmp_path / "b").iterdir() if "=" in d.name} == {x.length for x in rows}


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tessera.llm.tokens import PieceEncoder

    t = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "a b": 3, " b": 4}, merges=[(" ", "b"), ("a", " b")]))
    t.pre_tokenizer = pre_tokenizers.Split("zzz", "isolated")
    t.save(str(tmp_path / "t.json"))
    e = PieceEncoder(str(tmp_path / "t.json"))
    ids, at = e.encode(pa.array(["a b", None, "b"]))
    assert not e.apart and ids.tolist() == [3, 1] and at.tolist() == [0, 1, 1, 2]
    assert all(PieceEncoder(P.path(n)).apart for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

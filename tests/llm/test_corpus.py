"""The corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, piece int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = [w + x for w in ("the", "of", "Éte", "zu", "Ha") for x in ("a", "b.", "ré", "ing,", "12")]
    texts = [None, "", " \n ", "a", "The a b", "x" * 5000, "日本 語 テスト", "<|endoftext|>s don't"]
    for _ in range(40):
        words = [r.choice(vocabulary) + str(r.randrange(40)) for _ in range(r.randrange(3, 120))]
        texts.append(" ".join(words))
        if r.random() < 0.5:
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        if r.random() < 0.3:
            texts.append(texts[-1])
    texts.append("word " * 30000)
    return [(i, t, "en" if i % 3 else None, [None, "a", "b"][i % 3], 0, True, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    from tessera.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    got = {r.doc_id: r for r in exact_duplicates(docs, min_copies=2).collect()}
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert drop_exact_duplicates(docs).columns == docs.columns
    assert exact_duplicates(empty).count() == 0


def test_mixing(docs, rows, empty):
    from tessera.llm.mixing import mix_sources, mixed_documents

    got = mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6 * total
    for s in (None, "a", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and all(r.taken <= 2 * r.size for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs.repartition(2)).collect()), key=str)
    assert mixed_documents(docs).columns == docs.columns
    assert mix_sources(empty).count() == 0


def test_sharding(docs, rows, empty):
    from tessera.llm.sharding import shard_documents

    got = shard_documents(docs, shards=4).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and 0 <= s < 4
    assert shard_documents(empty, shards=4).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(rows, name):
    import pyarrow as pa

    from tessera.llm.tokens import PieceEncoder

    r = random.Random(1)
    texts = [t for _, t, *_ in rows] + ["".join(r.choice("ab Z.,;\n\t  éÉß×́'s1| 日") for _ in range(30)) for _ in range(500)]
    e = PieceEncoder(P.path(name), cache=50)
    ids, at = e.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_files_and_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack_documents
    from tessera.llm.storage import new_folder
    from tessera.llm.token_files import read_token_files, write_token_files

    folder, path = new_folder(spark, "t"), P.path("byte_bpe_50k.json")
    write_token_files(docs, folder, path, end_id=2, file_bytes=20_000)
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in read_token_files(spark, folder).collect()}
    packed = {}
    for r in pack_documents(docs, path, end_id=2, longest=64).collect():
        packed.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        pieces = sorted(packed[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in pieces)
    assert len({r.sequence_id for p in packed.values() for r in p}) == sum(map(len, packed.values()))
    folder = new_folder(spark, "t")
    write_token_files(empty, folder, path, end_id=2)
    assert read_token_files(spark, folder).count() == 0 and pack_documents(empty, path, 2).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, rows, empty, words, percent):
    from tessera.llm.near_dedup import drop_near_duplicates, jaccard_groups

    sets, low = {}, {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        low[i] = i
    for _ in range(3):
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs, words, percent, star=4, block=4).collect()}
    assert got == {i: (len(sets[i]), low[i]) for i in sets}
    assert drop_near_duplicates(docs, words, percent).columns == docs.columns
    assert jaccard_groups(empty).count() == 0


def test_vectors(spark):
    from tessera.llm.vector_dedup import vector_groups

    r = np.random.default_rng(1)
    base = r.standard_normal((300, 16))
    near = base[:60] + 0.05 * r.standard_normal((60, 16))
    table = [(i, v.tolist()) for i, v in enumerate([*base, *near, *base[:5]])]
    table += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0, None] * 8)]
    got = {x.vec_id: x for x in vector_groups(spark.createDataFrame(table, "vec_id long, embedding array<float>"), block=50, leaf_rows=64).collect()}
    v = np.array([t[1] for t in table[:365]], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = ((v @ v.T) >= 0.9).sum(1) - 1
    assert len(got) == len(table) and all(got[i].n_links <= want[i] for i in range(365))
    assert sum(got[i].n_links for i in range(365)) >= 0.98 * want.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1005))
    assert vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_and_toxicity(spark, empty):
    from tessera.llm.language import identify_languages
    from tessera.llm.toxicity import score_toxicity

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = P.path("piece_bpe_32k.model")
    found = identify_languages(docs, path).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in identify_languages(odd, path).collect()} == {("und", 0.0)}
    assert identify_languages(empty, path).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = score_toxicity(docs, labels).join(labels, "doc_id")
    assert scored.where("toxic = 1 and is_toxic").count() >= 0.8 * scored.where("toxic = 1").count()
    assert scored.where("toxic = 0 and is_toxic").count() <= 0.02 * scored.count()
    assert score_toxicity(empty, labels.limit(0)).count() == 0


def test_lines(docs, empty, spark):
    from tessera.llm.line_dedup import dedup_lines

    line = "one two three four five six on {}"
    t = spark.createDataFrame([(1, line.format(5) + "\nown line of the first document here"), (2, "short\n" + line.format(17)), (3, None), (4, "short")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(t).collect()} == {1: line.format(5) + "\nown line of the first document here", 2: "short", 3: None, 4: "short"}
    assert dedup_lines(docs).count() == docs.count() and dedup_lines(empty).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
    assert c.run(spark, "/root/testdata/sf0.001").where(F.col("length") > 2048).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_key_and_pass_the_bitmaps(percent):
    from tessera.llm.near_dedup import Side, bitmap, segment_keys, side_pairs

    rng = np.random.default_rng(percent)
    sets = []
    for size in [1, 2, 3, 4, 5, 9, 15, 20, 28, 31, 33, 36, 64, 65, 127, 300, 900]:
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for changed in {0, 1, size // 20, size // 12, size // 6, size // 3}:
            fresh = rng.integers(0, 1 << 63, changed, np.uint64)
            sets += [np.unique(np.concatenate([base[changed:], fresh])), np.unique(np.concatenate([base, fresh]))]
            sets.append(np.unique(base[changed:]))
    sets = [s for s in sets if len(s)]
    keys = [set(segment_keys(s, percent).tolist()) for s in sets]
    a, b = (Side(list(range(len(sets))), [len(s) for s in sets], [bitmap(s) for s in sets]) for _ in range(2))
    own = {(min(u, v), max(u, v)) for us, vs in side_pairs(a, a, percent) for u, v in zip(us.tolist(), vs.tolist())}
    across = {(u, v) for us, vs in side_pairs(a, b, percent) for u, v in zip(us.tolist(), vs.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                assert keys[i] & keys[j] and (j, i) in own and {(i, j), (j, i)} <= across

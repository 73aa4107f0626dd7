"""Alignment keeps little in a worker: short slices, few remembered pieces, links looked up where they lie; the same results."""

import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from tessera.llm import alignment


def test_slices_are_short_and_few_pieces_stay():
    texts = pa.array([f"some words, {k} of them. " * 12_000 for k in range(12)] + [None, "", "x " * 800_000])
    found = list(alignment._slices(texts))
    assert max(len(data) for first, data, bounds in found if len(bounds) > 2) <= 1 << 20 and max(len(data) for _, data, _ in found) == 1_600_001
    assert b"".join(bytes(data) for _, data, _ in found).decode() == "".join(f" {t}" if t else "" for t in texts.to_pylist())
    one = alignment.aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert one.a.cache == one.b.cache == alignment.CACHED <= 200_000


def test_spans_of_ends_are_short():
    ends = np.arange(1, 2_000_001)
    tracemalloc.start()
    try:
        at_a, at_b = alignment.shared_ends(ends, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(at_a, ends - 1) and np.array_equal(at_b, ends - 1)
    assert peak < 150_000_000  # both results twice, and the dictionaries of one span


def test_links_are_summed_where_they_lie(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 7)
    g = np.random.default_rng(5)
    pairs = np.unique(g.integers(0, 1 << 40, 50))
    best, total = g.random(len(pairs)) < 0.4, g.integers(1, 1 << 40, len(pairs))
    at = [g.integers(0, len(pairs), n) for n in (3, 0, 20, 7, 0, 1, 0)]
    rows = pa.array([pairs[i].astype("<i8").tobytes() for i in at], pa.binary())
    for first, n in ((0, 7), (1, 5), (2, 1), (4, 1), (6, 1)):
        got = alignment.link_sums(rows.slice(first, n), pairs, best, total)
        own = at[first : first + n]
        assert [x.tolist() for x in got] == [[len(i) for i in own], [int(best[i].sum()) for i in own], [int(total[i].sum()) for i in own]]


def test_looking_up_many_links_takes_less_than_they_do():
    pairs = np.arange(1000, dtype="<i8")
    links = pa.array([np.resize(pairs, 1_000_000).tobytes()] * 4, pa.binary())
    tracemalloc.start()
    try:
        n, n_best, count_sum = alignment.link_sums(links, pairs, pairs < 500, pairs + 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n.tolist() == [1_000_000] * 4 and n_best.tolist() == [500_000] * 4 and count_sum.tolist() == [500_500_000] * 4
    assert peak < 4_000_000 * 8

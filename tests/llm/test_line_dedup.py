"""Lines that share a key, in whatever order they come."""

import pyarrow as pa

from tessera.llm import line_dedup


def test_lines_of_a_key_meet_in_any_order():
    batch = lambda rows: pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["key", "leaf"])
    rows = [(1, 5), (2, 9), (2, 3), (2, 9), (3, 8), (4, 6), (4, 7)]
    met = [r for b in line_dedup._meet(iter([batch(rows[:4]), batch(rows[4:])])) for r in b.to_pylist()]
    assert sorted((r["u"], r["v"]) for r in met) == [(3, 9), (6, 7)]

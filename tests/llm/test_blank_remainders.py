"""Documents of which line dedup leaves blank lines alone."""

import pytest

pytest.importorskip("public_tokenizers")


def test_documents_left_blank_go(spark):
    import corpus_pipeline as c

    a, b = "the first paragraph of a text that comes back", "and its second paragraph after a blank line"
    rows = [(1, f"{a}\n\n{b}"), (2, f"{a}\n \n ​\n{b}"), (3, f"{a}\nx"), (4, "\n"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in c.lines(spark, docs, "").collect()}
    assert got == {1: (f"{a}\n\n{b}", len(a + b) + 2), 3: ("x", 1), 4: ("\n", 1), 5: ("", 0), 6: (None, 0)}

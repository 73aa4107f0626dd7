"""Line-first cleaning against plain loops, its SQL and odd tables."""

import re

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

GAP = re.compile("[\x20\x09-\x0d]+")
ODD = [
    None, "", " \n\t ", "one", "a b c d e f g h " * 3, "a b c d e f g h i j k l m n o p q r s t u v w x y z.", "x " * 40 + "end.", "same line of words here.\nsame line of words here.\n\n\nother\nother\n",
    "one two three four five six seven eight nine one two three four five six seven eight ten.", "Home | About | Contact | Help\nThis is a sentence of some words, and it goes on.\nNext »\nread more",
    "All rights reserved.\nA text of its own that has enough words to be judged at all by the rules, as it goes on and on for a while.", "é#*$ <b>&amp;|</b> \U0001f600 %%", "a%%% b*** c$$$ d### e&&& f%%% g*** h$$$",
    "y z " * 3000, "\r\nline one is here.\r\nline one is here.\r\n", "Thai ไทย 你好。世界！", "v1.2 is out now yes it is", "\x0bvertical\x0ctab words here now",
]


def brute(text):
    t = text or ""
    words = [w for w in GAP.split(t) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if GAP.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_as_by_hand(spark):
    from tessera.llm.quality import clean_documents

    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "one", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, lines int")
    got = clean_documents(docs).collect()
    assert len(got) == len(rows) and clean_documents(docs.limit(0)).count() == 0
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_judge_lines(spark):
    from tessera.llm.quality import clean_documents, keep_clean, line_fails
    from pyspark.sql import functions as F

    cases = {
        "This line is a sentence.": "", "He said: “so it is.”": "", "a line of words that never ends in a mark": "punctuation", "Short title": "", "%%% *** $$$ ###": "punctuation", "10.5 and v1.2 of it": "punctuation",
        "Home | About | Contact |": "punctuationnavigation", "  Read more »": "navigation", "home": "navigation", "Homework is due.": "", "Copyright (c) 2020 by someone.": "boilerplate",
        "This page uses cookies to work.": "boilerplate", "句子没有空格。但是有句号！": "", "A.": "", "Wait...!!!": "punctuation",
    }
    lines = spark.createDataFrame([(x,) for x in cases], "l string")
    got = lines.select("l", *[c.alias(n) for n, c in line_fails(F.col("l")).items()]).collect()
    assert {r.l: "".join(n for n in ("punctuation", "navigation", "boilerplate") if r[n]) for r in got} == cases
    good = "This sentence has its words and comes to an end. " + " ".join(f"Word number {i} stands here." for i in range(9))
    bad = "\n".join(f"menu item{i} | another {i} | third{i} | and {i} so{i} on with{i} words" for i in range(9))
    docs = spark.createDataFrame([(1, good + "\nHome\n\nAll rights reserved."), (2, good[:200] + "\n" + bad)], "doc_id long, text string")
    judged = {r.doc_id: r for r in clean_documents(docs).collect()}
    assert judged[1].text == good + "\n" and judged[1].kept and judged[1].n_removed == 2
    assert not judged[2].kept and not judged[2].base_failed and judged[2].n_removed == 9
    assert [r.doc_id for r in keep_clean(docs).collect()] == [1]


def test_native_and_equal_to_its_sql(spark):
    from tessera.llm.queries import oracle_sql, op12_quality_rules

    got = op12_quality_rules(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
    columns = sorted(got.columns)
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = duckdb.sql(oracle_sql()["op12_quality_rules"])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*columns).fetchall())

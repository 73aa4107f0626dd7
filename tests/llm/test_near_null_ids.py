"""Null ids in near dedup."""


def test_rows_without_an_id_stay(spark):
    from tessera.llm.near_dedup import drop_near_duplicates

    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, "another text of its own"), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in drop_near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, text), (None, text), (None, "another text of its own"), (None, None)], key=str)

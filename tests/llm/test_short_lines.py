"""Short lines and scripts without spaces in line dedup."""


def test_short_lines_and_scripts_without_spaces(spark):
    from tessera.llm.line_dedup import dedup_lines

    same = ["All rights reserved.", "Licensed under CC BY-NC 4.0", "本网站的所有内容均受版权保护", "本文共12页，请勿转载给他人", "สงวนลิขสิทธิ์ตามกฎหมายทั้งหมด"]
    other = [*same[:1], "Licensed under CC BY-NC 3.0", same[2], "本文共345页，请勿转载给他人", same[4]]
    short = ["Of.", "The end", "目录", "第1章", "12 34 56 78 90 11"]
    rows = [(1, "\n".join(same + short)), (2, "\n".join(other + short)), (3, "これは第3回の会議の記録です。")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\n".join(short), 3: rows[2][1]}

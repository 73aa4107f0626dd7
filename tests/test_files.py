"""Scans of folders, encodings, exports; globs and braces."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import braces, glob_regex
from tessera.sources import code, exports, files


def test_scan_reads_what_matches(spark, tmp_path):
    for name, data in {"a.ts": b"one", "sub/b.ts": "zw\u00f6lf".encode("latin-1"), "sub/c.js": b"x", "node_modules/d.ts": b"no", "x.egg-info/e.ts": b"no", "u.ts": "\ufeffhi".encode("utf-16-le")}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = files.scan(spark, str(tmp_path), "*.ts")
    got = {r.path: (r.text, r.encoding, r.chars) for r in files.texts(found).collect()}
    assert got == {"a.ts": ("one", "UTF-8", 3), "sub/b.ts": ("zw\u00f6lf", "ISO-8859-1", 5), "u.ts": ("hi", "UTF-16", 2)}
    assert [r.path for r in files.scan(spark, str(tmp_path), ["/sub/*.{ts,js}"]).orderBy("path").collect()] == ["sub/b.ts", "sub/c.js"]
    with pytest.raises(ValueError, match="patterns"):
        files.pattern_list([])


def test_replacement_characters_of_a_text_stay(spark):
    rows = spark.createDataFrame([("a", bytearray("x\ufffdy".encode())), ("b", bytearray(b"x\xff")), ("c", bytearray("\ufeffa\ufffd".encode("utf-16-le")))], "path string, content binary")
    assert {r.path: (r.text, r.chars) for r in files.texts(rows).collect()} == {"a": ("x\ufffdy", 3), "b": ("x\xff", 2), "c": ("a\ufffd", 2)}


def test_globs_and_braces():
    import re

    assert braces("a{b,c{d,e}}f") == ["abf", "acdf", "acef"] and braces("}a{") == ["}a{"] and braces("{a}") == ["{a}"]
    assert re.match(glob_regex("[!a]?[0-9].ts"), "bx7.ts") and not re.match(glob_regex("[!a]?.ts"), "ax.ts")
    assert re.match(glob_regex("}a{"), "}a{")


def test_shell_patterns(spark):
    from tessera.functions.text import shell_regex

    cases = [("a[1].t?", "a1.ts", True), ("a[1].t?", "a[1].ts", False), ("*.ts", "x/y.ts", True), ("[!x]*", "y", True), ("[!x]*", "x", False), ("a.b", "axb", False), ("[", "[", True)]
    rows = spark.createDataFrame(cases, "g string, p string, want boolean")
    for r in rows.withColumn("got", F.rlike("p", shell_regex(F.col("g")))).collect():
        assert r.got == r.want, r


def test_lines_of_code(spark):
    text = "import { track, b } from './m';\nclass track {}\nx.track(1);\nconst s = 'track';\n// track\ntrack(a) {\nfoo(track);\nclass A extends track {"
    rows = spark.createDataFrame([("f", text)], "f string, t string")
    got = {r.line_no: (r.kind, r.confidence) for r in code.references(rows, "f", "t", "track").collect()}
    assert got == {1: ("import", 0.95), 2: ("class", 0.95), 3: ("call", 0.8), 6: ("definition", 0.9), 7: ("usage", 0.7), 8: ("extends", 0.9)}
    assert files.texts  # keeps the import in use
    tried = spark.createDataFrame([("../b", "x/y/a.ts"), ("./c.ts", "a.ts"), ("react", "a.ts")], "m string, f string").select(code.candidates(F.col("m"), F.col("f")).alias("c")).collect()
    assert tried[0].c[:2] == ["x/b", "x/b.ts"] and tried[1].c[0] == "c.ts" and tried[2].c is None


def test_exports_write(spark, tmp_path):
    lines = exports.csv_lines(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"))
    exports.write_text(lines, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1,", "2,b"]


def test_broken_lines_of_tools(spark):
    from tessera.sources.diagnostics import tsc_diagnostics

    got = tsc_diagnostics(spark.createDataFrame([("  src/a.ts(3,7):  error TS1:  m  \n",)], "value string")).collect()
    assert [(r.file, r.line, r.message) for r in got] == [("src/a.ts", 3, "m")]


def test_markdown_scan_and_timestamped_export(spark, tmp_path):
    from datetime import datetime

    for name in ("a.md", "sub/b.md", "sub/My-Template.md", "template/c.md", "d.txt"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text("12345")
    found = files.markdown_files(spark, str(tmp_path / "docs")).collect()
    assert sorted((r.path, r.length) for r in found) == [("a.md", 5), ("sub/b.md", 5), ("template/c.md", 5)] and all(r.modified for r in found)
    lines = spark.createDataFrame([("x",)], "line string")
    path = exports.write_timestamped(lines, str(tmp_path), at=datetime(2024, 5, 6, 7, 8, 9))
    assert path == f"{tmp_path}/workflow_metrics_20240506_070809.json" and [r.value for r in spark.read.text(path).collect()] == ["x"]
    with pytest.raises(ValueError, match="format"):
        exports.write_timestamped(lines, str(tmp_path), kind="xml")

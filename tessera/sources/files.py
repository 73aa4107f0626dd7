"""Files as tables: scans by pattern, texts with their encodings, front matter, snapshots and their changes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex

# Folders that scans leave out, as their names are listed; names with a star are patterns.
EXCLUDED = (
    "node_modules", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".eggs", "*.egg-info", "dist", "build", ".next", ".nuxt", ".cache", ".parcel-cache", "coverage", ".nyc_output",
    ".venv", "venv", "env", ".env", "virtualenv", ".idea", ".vscode", ".DS_Store", "thumbs.db", ".terraform", "vendor", "target", "out", ".gradle", ".settings", "bower_components",
)


def pattern_list(patterns: str | list[str]) -> list[str]:
    """One pattern, a list of them, or a list as JSON text."""
    if isinstance(patterns, str):
        try:
            patterns = json.loads(patterns)
        except json.JSONDecodeError:
            return [patterns]
    if not isinstance(patterns, list) or not patterns or not all(isinstance(p, str) for p in patterns):
        raise ValueError("patterns must be a text or a list of texts")
    return patterns


def matches(path: Column, patterns: str | list[str]) -> Column:
    """Whether a path relative to the root matches a pattern: one with a leading ``/`` from the root on, others at any depth."""
    hit = F.lit(False)
    for p in pattern_list(patterns):
        rooted = p.startswith("/")
        hit = hit | path.rlike(glob_regex(p[1:] if rooted else p if p.startswith("**/") else "**/" + p))
    return hit


def excluded(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any part of a path is an excluded name."""
    parts = F.split(path, "/")
    plain = F.array(*[F.lit(n) for n in names if "*" not in n])
    globs = [n for n in names if "*" in n]
    return F.arrays_overlap(parts, plain) | F.exists(parts, lambda x: x.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False))


def inside(path: Column) -> Column:
    """Whether a relative path stays under its root: it isn't absolute, and never climbs above where it began."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda d, p: F.struct((d["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(d["low"], d["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")))
    return ~path.startswith("/") & (depth["low"] >= 0)


def list_paths(paths: DataFrame, path_col: str, patterns: str | list[str]) -> DataFrame:
    """Distinct paths that match and lie in no excluded folder."""
    p = F.col(path_col)
    return paths.where(matches(p, patterns) & ~excluded(p)).select(p.alias("path")).distinct()


def scan(spark: SparkSession, root: str, patterns: str | list[str]) -> DataFrame:
    """Files under a root: ``path`` (relative), ``modified``, ``length``, ``content``; the content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace("path", f"^[a-z]+:/*{base.replace('.', chr(92) + '.')}/", "")
    found = files.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")
    return found.where(matches(F.col("path"), patterns) & ~excluded(F.col("path")))


def is_markdown(path: Column) -> Column:
    """Whether a path is a Markdown file's and its name doesn't tell a template."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return path.endswith(".md") & ~name.contains("template")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, modified, length`` of the Markdown files under a root at any depth, but for templates; no content is read."""
    return scan(spark, root, "*.md").where(is_markdown(F.col("path"))).select("path", "modified", "length")


def texts(files: DataFrame, encodings: tuple[str, ...] = ("UTF-8", "UTF-16", "ISO-8859-1")) -> DataFrame:
    """``path, text, encoding, chars``: decoded by a mark at the beginning, then UTF-8, then the encodings in turn that decode without loss.

    A file is read as Latin-1 at last, which always succeeds. Characters that a text holds stay, the replacement character (U+FFFD) included.
    """
    c = F.col("content")
    marked = F.when(F.hex(F.substring(c, 1, 2)).isin("FFFE", "FEFF"), "UTF-16")
    options = [F.when(~F.try_validate_utf8(c.cast("string")).isNull(), c.cast("string")) if e == "UTF-8" else F.decode(c, e) for e in encodings]
    picked = F.coalesce(marked, F.when(F.try_validate_utf8(c.cast("string")).isNotNull(), "UTF-8"), F.lit(encodings[-1]))
    text = F.when(picked == "UTF-16", F.decode(c, "UTF-16")).when(picked == "UTF-8", options[0]).otherwise(F.decode(c, encodings[-1]))
    return files.select("path", text.alias("text"), picked.alias("encoding")).withColumn("chars", F.length("text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """A text's leading block between two lines of ``---`` (flat ``key: value`` lines, as a map) and the rest."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\s*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    bare = lambda v: F.regexp_replace(F.trim(v), r"""^["'](.*)["']$""", "$1")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("k"), bare(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1)).alias("v")))
    # of a repeated key the last counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last), F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\s*(?:\n|\z)", "")


def snapshot(files: DataFrame, path_col: str, text_col: str, plain: Column) -> DataFrame:
    """``path, hash, plain_hash, size``: what a later snapshot is compared with."""
    text = F.col(text_col)
    return files.select(F.col(path_col).alias("path"), F.md5(text.cast("binary")).alias("hash"), F.md5(plain.cast("binary")).alias("plain_hash"), F.octet_length(text).cast("long").alias("size"))


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, cause``: changed files (``path``) and all that depend on them, directly or not (``edges``: src imports dst)."""
    from tessera.operators.graph import closure

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = closure(back, sources=changed.select("path"))
    own = changed.select("path", F.lit("changed").alias("cause"))
    return own.unionByName(reached.select(F.col("dst").alias("path")).distinct().join(changed, "path", "left_anti").select("path", F.lit("depends").alias("cause")))


def updated_edges(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after an incremental pass: those of changed files (``path``) are replaced, others stay."""
    return old.join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(new.join(changed.select(F.col("path").alias("src")), "src", "left_semi"))


def hint_records(hints: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Hints as numbered JSON records: ``key, name`` (``hint-001`` and on), ``json``, ``tokens``."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = hints.select(key, F.format_string("hint-%03d", nth).alias("name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
    return rows.withColumn("tokens", F.floor(F.length("json") / 4).cast("long"))


def parsed_hints(records: DataFrame, schema: str) -> DataFrame:
    """The records back as columns; those that aren't JSON are skipped."""
    good = records.withColumn("h", F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where(F.try_parse_json("json").isNotNull())
    return good.select(*[c for c in records.columns if c != "json"], "h.*")


def standard_index(standards: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Standards with the number of their hints, 0 where there are none."""
    counts = hints.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("hint_count"))
    return standards.join(counts, F.col(key) == F.col("of"), "left").drop("of").withColumn("hint_count", F.coalesce("hint_count", F.lit(0)).cast("long"))


def manifest_changes(manifest: DataFrame, files: DataFrame, key: str, stamp: str) -> DataFrame:
    """``new``, ``modified`` (another stamp, compared as text) and ``deleted`` standards between a manifest and the files there are."""
    a, b = manifest.select(key, F.col(stamp).cast("string").alias("was")), files.select(key, F.col(stamp).cast("string").alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")

"""Parsers of test runners' reports: text or JSON, one row per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JEST = "struct<numTotalTests:int,numPassedTests:int,numFailedTests:int,numPendingTests:int,testResults:array<struct<name:string,startTime:long,endTime:long,assertionResults:array<struct<status:string>>>>>"


def _count(summary: Column, word: str) -> Column:
    return F.coalesce(F.regexp_extract(summary, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))


def pytest_summary(output: DataFrame, text_col: str = "value") -> DataFrame:
    """``total, passed, failed, skipped, duration`` of the closing line; zeros without one."""
    line = F.regexp_extract(text_col, r"=+ ([^\n]+) in [\d.]+s =+", 1)
    took = F.coalesce(F.regexp_extract(text_col, r"=+ [^\n]+ in ([\d.]+)s =+", 1).try_cast("double"), F.lit(0.0))
    parts = output.select(*[_count(line, w).alias(w) for w in ("passed", "failed", "skipped")], took.alias("duration"))
    return parts.select((F.col("passed") + F.col("failed") + F.col("skipped")).alias("total"), "passed", "failed", "skipped", "duration")


def word_summary(output: DataFrame, text_col: str = "value") -> DataFrame:
    """Passes and failures of an unknown runner, by their words."""
    counted = output.select(*[F.regexp_count(text_col, F.lit(rf"(?i)\b{w}(ed)?\b")).alias(n) for n, w in (("passed", "pass"), ("failed", "fail"))])
    return counted.select((F.col("passed") + F.col("failed")).alias("total"), "passed", "failed")


def jest_files(output: DataFrame, text_col: str = "value") -> DataFrame:
    """``file, tests, failed, duration_ms, status`` of each file in a JSON report."""
    files = output.select(F.explode(F.from_json(text_col, JEST)["testResults"]).alias("f"))
    failed = F.size(F.filter("f.assertionResults", lambda a: a["status"] == "failed"))
    rows = files.select(F.col("f.name").alias("file"), F.size("f.assertionResults").alias("tests"), failed.alias("failed"), (F.col("f.endTime") - F.col("f.startTime")).alias("duration_ms"))
    return rows.withColumn("status", F.when(F.col("failed") == 0, "passed").otherwise("failed"))


MOCHA = "struct<stats:struct<tests:int,passes:int,failures:int,pending:int,duration:double>,failures:array<struct<fullTitle:string,err:struct<message:string>>>>"
UNUSED = "struct<issues:array<struct<file:string,exports:array<struct<name:string,line:int>>,types:array<struct<name:string,line:int>>>>,files:array<string>>"


def trailing_json(text: Column) -> Column:
    """The JSON object that output ends with, behind whatever was printed before it; the text itself where it is JSON."""
    whole = F.trim(text)
    last = F.regexp_extract(whole, r"(?s)(\{\s*\"(?:numTotalTests|testResults|stats|issues|files).*\})\s*$", 1)
    return F.when(F.try_parse_json(whole).isNotNull(), whole).when(last != "", last)


def jest_summary(output: DataFrame, text_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``total, passed, failed, skipped`` of a JSON report (also as a like runner prints it), found behind other output; counts by their names where the JSON is broken."""
    r = F.from_json(trailing_json(F.col(text_col)), JEST)
    rescue = lambda name: F.regexp_extract(text_col, rf'"{name}"\s*:\s*(\d+)', 1).try_cast("int")
    names = {"total": "numTotalTests", "passed": "numPassedTests", "failed": "numFailedTests", "skipped": "numPendingTests"}
    return output.select(*keep, *[F.coalesce(r[n], rescue(n), F.lit(0)).alias(k) for k, n in names.items()])


def mocha_summary(output: DataFrame, text_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``total, passed, failed, skipped, duration`` and the first failure of a runner's JSON with ``stats``."""
    r = F.from_json(trailing_json(F.col(text_col)), MOCHA)
    s = r["stats"]
    return output.select(*keep, s["tests"].alias("total"), s["passes"].alias("passed"), s["failures"].alias("failed"), s["pending"].alias("skipped"), s["duration"].alias("duration"), F.get(r["failures"], F.lit(0))["fullTitle"].alias("first_failure"))


def unused_items(output: DataFrame, text_col: str = "value") -> DataFrame:
    """``kind, file, name, line`` of a JSON report of unused code: files, exports and types."""
    r = output.select(F.from_json(trailing_json(F.col(text_col)), UNUSED).alias("r"))
    whole = r.select(F.explode("r.files").alias("file")).select(F.lit("file").alias("kind"), "file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"))
    issues = r.select(F.explode("r.issues").alias("i"))
    of = lambda kind, field: issues.select(F.lit(kind).alias("kind"), F.col("i.file").alias("file"), F.explode(f"i.{field}").alias("x")).select("kind", "file", "x.name", "x.line")
    return whole.unionByName(of("export", "exports")).unionByName(of("type", "types"))


def sectioned_items(output: DataFrame, key: str, text_col: str = "value") -> DataFrame:
    """The same from text: a line like ``Unused exports (3)`` opens a section, lines below it are ``name file:line`` or a file."""
    from pyspark.sql import Window

    lines = output.select(key, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(F.trim("line") != "")
    title = F.regexp_extract("line", r"^Unused (files|exports|types)\b", 1)
    own = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one report
    placed = lines.withColumn("section", F.last(F.nullif(title, F.lit("")), ignorenulls=True).over(own)).where((title == "") & F.col("section").isNotNull())
    place = r"(\S+?)(?::(\d+))?\s*$"
    named = F.col("section") != "files"
    return placed.select(key, F.regexp_replace("section", "s$", "").alias("kind"), F.regexp_extract("line", place, 1).alias("file"), F.when(named, F.regexp_extract("line", r"^\s*(\S+)", 1)).alias("name"), F.regexp_extract("line", place, 2).try_cast("int").alias("line"))


def issue_totals(issues: DataFrame, severity: str, fixable: Column, file: str) -> DataFrame:
    """One row: issues, errors, warnings, fixable ones and files."""
    return issues.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(severity) == "error").alias("errors"), F.count_if(F.col(severity) == "warning").alias("warnings"), F.count_if(fixable).alias("fixable"), F.count_distinct(file).alias("files"))

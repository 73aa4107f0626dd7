"""Parsers of tool output: text or JSON lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``file(line,column): severity TSnnnn: message`` as the TypeScript compiler prints it, with any white space around its parts.
TSC = r"^\s*(\S.*?)\((\d+),(\d+)\):\s*(error|warning)\s+(TS\d+):\s*(.*?)\s*$"
LINT = "array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,ruleId:string,message:string,fix:struct<text:string>>>>>"


def tsc_diagnostics(output: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per diagnostic line of compiler output."""
    lines = output.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.col("line").rlike(TSC))
    part = [F.regexp_extract("line", TSC, i) for i in range(1, 7)]
    return lines.select(part[0].alias("file"), part[1].cast("int").alias("line"), part[2].cast("int").alias("column"), part[3].alias("severity"), part[4].alias("code"), part[5].alias("message"))


def lint_issues(output: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per issue of a linter's JSON report; severity 2 is an error, all else a warning."""
    files = output.select(F.explode(F.from_json(text_col, LINT)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return files.select(F.col("filePath").alias("file"), "m.line", "m.column", F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"), F.col("m.ruleId").alias("rule"), "m.message", F.col("m.fix").isNotNull().alias("fixable"))


def all_diagnostics(**tools: DataFrame) -> DataFrame:
    """``tool, file, line, column, severity, code, message`` of several tools' diagnostics; what a tool calls a rule is its code."""
    out = None
    for name, rows in tools.items():
        code = F.col("code") if "code" in rows.columns else F.col("rule")
        own = rows.select(F.lit(name).alias("tool"), "file", "line", "column", "severity", code.alias("code"), "message")
        out = own if out is None else out.unionByName(own)
    return out

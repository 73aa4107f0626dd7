"""Symbols of source files: what they define, how often it is referred to, and details of their functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled
from tessera.sources import blocks, code


def symbols(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, name, kind, line_no``: classes and functions (the syntactic pass)."""
    classes = code.numbered_lines(files, file_col, text_col).where(F.col("line").contains("class ")).withColumn("name", F.regexp_extract("line", r"\bclass\s+([A-Za-z_$][\w$]*)", 1)).where("name <> ''")
    return classes.select("file", "name", F.lit("class").alias("kind"), "line_no").unionByName(code.definitions(files, file_col, text_col).select("file", "name", F.lit("function").alias("kind"), "line_no"))


def symbol_uses(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """Symbols with ``uses``: names equal to theirs in all files, their definitions left out (the semantic pass)."""
    # read twice, and dear to find
    found = settled(symbols(files, file_col, text_col))
    lines = code.meaningful(code.numbered_lines(files, file_col, text_col))
    names = code.with_value(lines, "names", code.tokens(F.col("line")), lambda toks: F.filter(toks, lambda t: t.rlike(r"^[A-Za-z_$]")))
    counts = names.select(F.explode("names").alias("used")).groupBy("used").agg(F.count(F.lit(1)).alias("seen"))
    defined = found.groupBy(F.col("name").alias("own")).agg(F.count(F.lit(1)).alias("defs"))
    # a row a name on this side, which grows with the texts
    uses = defined.join(counts.hint("merge"), F.col("own") == F.col("used"), "left").select("own", (F.coalesce("seen", F.lit(0)) - F.col("defs")).cast("long").alias("uses"))
    return found.join(uses.hint("merge"), F.col("name") == F.col("own")).select("file", "name", "kind", "line_no", "uses")


def lookup(found: DataFrame, file: str | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols by file, name or kind."""
    for column, value in (("file", file), ("name", name), ("kind", kind)):
        found = found if value is None else found.where(F.col(column) == F.lit(value))
    return found


def function_details(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, name, line, parameters, lines, calls, returns`` of each function with a body."""
    lines = code.numbered_lines(files, file_col, text_col).select(F.col("file").alias("of"), "line_no", F.col("line").alias("head"))
    own = blocks.blocks(files, file_col, text_col).where("kind = 'function'")
    found = own.join(lines, (F.col("file") == F.col("of")) & (F.col("line_no") == F.col("line")))
    body = F.col("body")
    return found.select(
        "file", "name", "line_no", F.size(blocks.parameters(F.col("head"))).alias("parameters"), (F.regexp_count(body, F.lit("\n")) + 1).alias("lines"), F.size(blocks.called_names(body)).alias("calls"),
        F.regexp_count(body, F.lit(r"\breturn\b")).alias("returns"),
    )


def confidence(base: Column, imported: Column) -> Column:
    """A reference's confidence, 0.1 more where its file imports the symbol, 1 at most."""
    return F.least(F.lit(1.0), F.round(base + F.when(imported, 0.1).otherwise(0.0), 6))


def async_patterns(text: Column) -> Column:
    """Flags of asynchronous code: ``async`` functions, ``await``, promises, timers and callbacks, with the number of awaits."""
    return F.struct(
        text.rlike(r"\basync\b").alias("is_async"), text.rlike(r"\bawait\b").alias("awaits"), text.rlike(r"\bPromise\b|\.then\s*\(").alias("promises"), text.rlike(r"\bset(Timeout|Interval)\s*\(").alias("timers"),
        text.rlike(r"\(\s*(\w+,\s*)*(callback|cb|done)\b").alias("callbacks"), F.regexp_count(text, F.lit(r"\bawait\b")).alias("n_awaits"),
    )


def dynamic_calls(text: Column) -> Column:
    """Names that are called by a computed key (``obj[key](…)``) or by ``call``, ``apply`` and ``bind``."""
    return F.array_union(F.regexp_extract_all(text, F.lit(r"\w+\[(\w+)\]\s*\("), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\w+)\.(?:call|apply|bind)\s*\("), F.lit(1)))


def example_of(text: Column, most_lines: int) -> Column:
    """An example of a few lines: imports, blank lines and comments go first, then what is beyond ``most_lines``."""
    kept = F.filter(F.split(code.without_imports(text), "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("//"))
    return F.concat(F.array_join(F.slice(kept, 1, most_lines), "\n"), F.when(F.size(kept) > most_lines, "\n// ...").otherwise(""))


def workspaces(configs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``project, depends_on``: projects by their configuration files (JSON), a row for each reference, null where there is none."""
    r = F.from_json(text_col, "references array<struct<path:string>>, name string")
    folder = F.regexp_replace(path_col, "/?[^/]*$", "")
    rows = configs.select(folder.alias("folder"), F.coalesce(r["name"], folder).alias("project"), r["references"]["path"].alias("refs"))
    steps = lambda f, p: F.aggregate(F.split(F.concat(f, F.lit("/"), p), "/"), F.array().cast("array<string>"), lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    wanted = rows.select("project", "folder", F.explode_outer("refs").alias("ref"))
    named = rows.select(F.col("folder").alias("at"), F.col("project").alias("depends_on"))
    return wanted.withColumn("to", F.array_join(steps(F.col("folder"), F.col("ref")), "/")).join(named, F.col("to") == F.col("at"), "left").select("project", "depends_on")

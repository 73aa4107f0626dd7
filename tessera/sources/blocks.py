"""Blocks of source text that brackets enclose: bodies, branches, and what they call. Brackets nest, so a small Arrow function cuts them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.code import NOT_CALLS

HEAD = re.compile(r"\b(if|else if|else|switch|try|catch|finally|for|while)\b\s*(\([^(){}]*(?:\([^()]*\)[^(){}]*)*\))?\s*\{|\bfunction\s+(\w+)\s*\([^)]*\)\s*\{|^[ \t]*(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|else\b|function\b)(\w+)\s*\([^)]*\)\s*\{", re.M)
#: Texts in quotes and comments, whose brackets don't count.
QUIET = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/', re.S)
# The share of executions that a branch is taken to have.
IF_SHARE, TRY_SHARE, CATCH_SHARE = 0.5, 0.8, 0.2

_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("depth", pa.int32()), ("body", pa.string())]))


def _blocks(text: str) -> list[dict]:
    """The blocks of one text, in order of their beginnings."""
    plain = QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    close, stack, depth_at = {}, [], {}
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            depth_at[m.start()] = len(stack)
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    out = []
    for m in HEAD.finditer(plain):
        at = m.end() - 1
        if at in close:
            name = m[3] or m[4]
            condition = text[m.start(2) + 1 : m.end(2) - 1] if m[2] else None
            out.append({"kind": "function" if name else m[1], "name": name or condition, "line": plain.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, "depth": depth_at[at], "body": text[at + 1 : close[at]]})
    return out


def blocks(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, kind, name, line, depth, body``: functions and branches with their text; ``name`` is a function's name or a branch's condition."""

    @F.arrow_udf("array<struct<kind:string,name:string,line:int,depth:int,body:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([_blocks(t) if t else [] for t in texts.to_pylist()], _TYPE)

    return files.select(F.col(file_col).alias("file"), F.explode(cut(F.col(text_col))).alias("b")).select("file", "b.*")


def called_names(body: Column) -> Column:
    """Names that a block calls, in order, repeats kept; keywords aren't calls."""
    return F.filter(F.regexp_extract_all(body, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)), lambda x: ~x.isin(*NOT_CALLS))


def branch_weights(found: DataFrame) -> DataFrame:
    """Branches with the ``weight`` of a path through them: one half for ``if`` and ``else``, one case's share of a ``switch``, 0.8 and 0.2 for ``try`` and ``catch``."""
    cases = F.greatest(F.lit(1), F.regexp_count("body", F.lit(r"\b(case|default)\b")))
    weight = (
        F.when(F.col("kind").isin("if", "else if", "else"), IF_SHARE).when(F.col("kind") == "switch", F.lit(1.0) / cases)
        .when(F.col("kind") == "try", TRY_SHARE).when(F.col("kind") == "catch", CATCH_SHARE)
    )
    return found.withColumn("weight", F.round(weight, 6)).where("weight is not null")


def first_conditions(steps: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """Each step (``keys``, ``callee``) with the first branch of its file that calls it (``line``, ``condition``), null where none does."""
    inside = branches.select("file", "line", F.col("name").alias("condition"), F.explode_outer(F.array_distinct(called_names(F.col("body")))).alias("callee")).where("callee is not null")
    first = inside.groupBy("file", "callee").agg(F.min(F.struct("line", "condition")).alias("b"))
    return steps.join(first.hint("merge"), ["file", "callee"], "left").select(*keys, "callee", "b.line", "b.condition")


def parameters(signature: Column) -> Column:
    """The parameters between a signature's brackets, split at commas that no inner bracket encloses."""
    inner = F.regexp_extract(signature, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    parts = F.split(inner, ",")
    level = lambda s: F.length(F.regexp_replace(s, r"[^<{\[(]", "")) - F.length(F.regexp_replace(F.replace(s, F.lit("=>"), F.lit("")), r"[^>}\])]", ""))
    state = F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda s, p: F.when(level(F.concat(s["open"], p)) > 0, F.struct(s["done"].alias("done"), F.concat(s["open"], p, F.lit(",")).alias("open"))).otherwise(F.struct(F.array_append(s["done"], F.trim(F.concat(s["open"], p))).alias("done"), F.lit("").alias("open"))),
    )
    return F.filter(state["done"], lambda x: x != "")


def parameter_fields(parameter: Column) -> Column:
    """A parameter's name, type, default, and whether it may be left out."""
    name = F.regexp_extract(parameter, r"^(?:\.\.\.)?([\w$]+)", 1)
    default = F.regexp_extract(parameter, r"=\s*([^>].*)$", 1)
    kind = F.trim(F.regexp_extract(parameter, r"^[^:=]*:\s*(.*?)(?:\s*=[^>].*)?$", 1))
    return F.struct(name.alias("name"), F.nullif(kind, F.lit("")).alias("type"), F.nullif(default, F.lit("")).alias("default"), (parameter.rlike(r"^(?:\.\.\.)?[\w$]+\?") | (default != "")).alias("optional"))


def generic_parts(kind: Column) -> Column:
    """``Name<A, B>`` as its name and arguments, inner brackets kept whole."""
    name = F.trim(F.regexp_extract(kind, r"^\s*([\w$.]+)", 1))
    inside = F.regexp_extract(kind, r"^\s*[\w$.]+\s*<(.*)>\s*$", 1)
    return F.struct(name.alias("name"), parameters(F.concat(F.lit("("), F.replace(F.replace(inside, F.lit("("), F.lit("{")), F.lit(")"), F.lit("}")), F.lit(")"))).alias("arguments"))

"""Checks of rows against rules: responses, inputs, breakpoints, conversions, versions, policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of true and false, and what a rule file must and must not hold.
TRUE, FALSE = ("true", "yes", "1", "on", "y"), ("false", "no", "0", "off", "n")
RULE_NEEDS, RULE_FORBIDS = ("module.exports", "meta", "create"), ("extends:", "plugins:", "env:", "parserOptions:", "globals:", "overrides:", "ignorePatterns:")


def violations(rules: dict[str, dict]) -> Column:
    """The names of rules that a row breaks, by field: ``required``, ``type``, ``min``, ``max`` (length), ``allowed``, ``pattern``, ``check`` (a function of the column).

    Absent values break ``required`` alone.
    """
    found = []
    for field, rule in rules.items():
        c, text = F.col(field), F.col(field).cast("string")
        tests = {
            "required": c.isNull() | (F.trim(text) == ""), "type": text.isNotNull() & text.try_cast(rule.get("type", "string")).isNull(), "min": F.length(text) < rule.get("min", 0), "max": F.length(text) > rule.get("max", 0),
            "allowed": ~text.isin(*rule.get("allowed", [""])), "pattern": ~text.rlike(rule.get("pattern", "")),
        }
        found += [F.when(F.coalesce(tests[k], F.lit(False)), F.lit(f"{field}:{k}")) for k in tests if rule.get(k)]
        if "check" in rule:
            found.append(F.when(~F.coalesce(rule["check"](c), F.lit(False)), F.lit(f"{field}:check")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def converted_input(text: Column, kind: str, choices: tuple[str, ...] = ()) -> Column:
    """A user's input as a value: ``string``, ``number``, ``boolean`` (several spellings) or ``choice`` (by name or number from 1); null where it isn't one."""
    bare = F.trim(text)
    if kind == "number":
        return bare.try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(bare).isin(*TRUE), True).when(F.lower(bare).isin(*FALSE), False)
    if kind == "choice":
        options = F.array(*[F.lit(c) for c in choices])
        return F.when(F.array_contains(options, bare), bare).otherwise(F.get(options, bare.try_cast("int") - 1))
    return text


def breakpoint_hits(events: DataFrame, points: DataFrame, key: str, step: str, order: list[str], condition: Callable[[], Column]) -> DataFrame:
    """Where execution stops: events at a breakpoint (``step, least, max_hits``; a small table) whose condition holds, up to its hits per key."""
    at = events.join(F.broadcast(points.withColumnRenamed("step", "at")), (F.col(step) == F.col("at")) & F.coalesce(condition(), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(key, "at").orderBy(*order))
    return at.withColumn("hit", nth).where(F.col("hit") <= F.col("max_hits"))


def version_step(old: Column, new: Column) -> Column:
    """What an upgrade is: ``same``, ``patch``, ``minor``, ``major`` or ``downgrade``; dotted versions, missing parts are 0."""
    part = lambda c, i: F.coalesce(F.get(F.split(c, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    lower = F.lit(False)
    same = F.lit(True)
    for i in range(3):
        lower = lower | (same & (part(new, i) < part(old, i)))
        same = same & (part(new, i) == part(old, i))
    return F.when(same, "same").when(lower, "downgrade").when(part(old, 0) != part(new, 0), "major").when(part(old, 1) != part(new, 1), "minor").otherwise("patch")


def valid_rule_file(text: Column) -> Column:
    """Whether a rule's source exports what it must and configures nothing; comments don't count."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    needs = [bare.contains(x) for x in RULE_NEEDS]
    forbids = [bare.contains(x) for x in RULE_FORBIDS]
    return F.coalesce(F.array_min(F.array(*needs)) & ~F.array_max(F.array(*forbids)), F.lit(False))


def permitted(requests: DataFrame, grants: DataFrame, role: str, action: str) -> DataFrame:
    """Requests with ``allowed``: whether a grant (``role, action``; ``*`` is any action) covers them."""
    given = grants.select(F.col("role").alias("r"), F.col("action").alias("a")).distinct()
    exact = requests.join(given, (F.col(role) == F.col("r")) & (F.col(action) == F.col("a")), "left").withColumn("_e", F.col("a").isNotNull()).drop("r", "a")
    any_action = given.where("a = '*'").select(F.col("r").alias("w"))
    return exact.join(any_action, F.col(role) == F.col("w"), "left").withColumn("allowed", F.col("_e") | F.col("w").isNotNull()).drop("_e", "w")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A table with new rows added and rows of the same keys replaced."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def removed(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A table without the rows of some keys."""
    return old.join(gone.select(*keys), keys, "left_anti")

"""Retrieval of rules for a session: grouping, compression, budgets, conversion and merging.

Rules are rows of ``rule_id, rule, context, pattern, complexity, rule_type, relevance`` and what an operator names besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import unused

# Tokens of a group and of a rule in it, how much groups of a kind save, groups that stay small, tokens of a mere reference.
GROUP_TOKENS, RULE_TOKENS, SAVED, SMALL, REFERENCE = 50, 30, {"pattern_group": 0.8, "complexity_group": 0.9, "context_group": 0.7, "mixed_group": 0.85}, 3, 5
# The most tokens of an example by its size, and the words of a context that make its key.
CAPS, CONTEXT_WORDS = {"minimal": 30, "standard": 150, "full": 300}, 5


def grouped(rules: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """``rules`` with ``kind`` and ``group``: ``individual`` rules are their own group.

    ``pattern``, ``complexity`` and ``context`` (its first words) group by that alone; ``hybrid`` groups by pattern, groups of more than
    three rules by pattern and complexity, and what is then still larger goes rule by rule.
    """
    own = F.concat(F.lit("rule:"), F.col("rule_id").cast("string"))
    if strategy == "hybrid":
        counted = _counted(_counted(rules, "few", "pattern"), "fewer", "pattern", "complexity")
        kind = F.when(F.col("few") == 1, "individual").when(F.col("few") <= SMALL, "pattern_group").when(F.col("fewer") <= SMALL, "mixed_group").otherwise("individual")
        name = F.when(F.col("kind") == "pattern_group", F.col("pattern")).when(F.col("kind") == "mixed_group", F.concat_ws("_", "pattern", "complexity")).otherwise(own)
        return counted.withColumn("kind", kind).withColumn("group", name).drop("few", "fewer")
    key = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("context", r"\s+", " ")), " "), 1, CONTEXT_WORDS), " ") if strategy == "context" else F.col(strategy)
    counted = _counted(rules.withColumn("group", key), "few", "group")
    kind = F.when(F.col("few") == 1, "individual").otherwise(f"{strategy}_group")
    return counted.withColumn("kind", kind).withColumn("group", F.when(F.col("kind") == "individual", own).otherwise(F.col("group"))).drop("few")


def _counted(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with the number of rows that have their keys: counts are summed in parts and joined, so a hot key isn't one task's rows."""
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(sizes, same).drop(*[f"_{k}" for k in keys])


def common_prefix(column: str) -> Column:
    """Aggregate: the longest beginning that all texts share, cut to whole words where it holds any space; one text alone is whole."""
    low, high = F.min(column), F.max(column)
    length = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))), lambda i: (F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i)) & (F.length(low) > 0)))
    prefix = F.substring(low, F.lit(1), length)
    return F.when(F.count(F.lit(1)) == 1, low).when(F.instr(prefix, " ") > 1, F.regexp_replace(prefix, r" [^ ]*$", "")).otherwise(prefix)


def group_payloads(rules: DataFrame, minimal: Column, standard: str, small: str, full: str) -> DataFrame:
    """A row for each group of ``grouped``: rules, common context, best example and estimated tokens (never more than its rules' own)."""
    saved = F.create_map(*[F.lit(x) for pair in SAVED.items() for x in pair])
    n = F.count(F.lit(1))
    estimate = F.lit(GROUP_TOKENS) + F.floor(n * RULE_TOKENS * saved[F.col("kind")])
    first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("rule_id")))
    example = F.coalesce(first(standard), first(small), F.min_by(full, "rule_id"))
    tokens = F.when(F.col("kind") == "individual", F.sum(minimal)).otherwise(F.least(estimate, F.sum(minimal)))
    return rules.groupBy("kind", "group").agg(n.alias("rules"), common_prefix("context").alias("common_context"), example.alias("best_example"), tokens.cast("long").alias("tokens"))


def common_imports(rules: DataFrame, imports: DataFrame) -> DataFrame:
    """``group, name, module``: imports (``rule_id, name, module``) that every rule of a group has."""
    sizes = rules.groupBy("group").agg(F.count_distinct("rule_id").alias("n"))
    held = rules.select("group", "rule_id").join(imports, "rule_id").groupBy("group", "name", "module").agg(F.count_distinct("rule_id").alias("h"))
    return held.join(sizes, "group").where("h = n").select("group", "name", "module")


def fit_groups(groups: DataFrame, session: str, order: list[str], budget: int) -> DataFrame:
    """Per session in order, groups (``kind, rules, tokens``) that fit the budget; adds ``taken_rules``, ``taken_tokens``, ``partial``.

    An individual rule that doesn't fit is skipped; of the first group that doesn't, as many rules as fit are taken, and there it ends.
    Each decision hangs on those before, so the (thin) rows of a session pass through one task in order.
    """

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, over = object(), 0, False
        for b in batches:
            keep, rules, tokens, part = [], [], [], []
            for k, kind, n, t in zip(*(b.column(c).to_pylist() for c in (session, "kind", "rules", "tokens")), strict=True):
                if k != current:
                    current, total, over = k, 0, False
                if over or (kind == "individual" and total + t > budget):
                    keep.append(False)
                    continue
                taken, cut = n, total + t > budget
                if cut:
                    taken, over = int((budget - total) / (t / n)) if t else n, True
                    t = int(taken * (t / n))
                keep.append(taken > 0)
                if taken > 0:
                    total += t
                    rules.append(taken)
                    tokens.append(t)
                    part.append(cut)
            left = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(rules, pa.int64()), pa.array(tokens, pa.int64()), pa.array(part, pa.bool_())], names=[*left.schema.names, "taken_rules", "taken_tokens", "partial"])

    schema = groups.withColumns({"taken_rules": F.lit(0).cast("long"), "taken_tokens": F.lit(0).cast("long"), "partial": F.lit(False)}).schema
    return groups.repartition(session).sortWithinPartitions(session, *order).mapInArrow(fitted, schema)


def not_loaded(rules: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Rules that the session hasn't loaded."""
    return rules.join(loaded, keys, "left_anti")


def demoted(rules: DataFrame, covered: DataFrame, key: str, score: str, factor: float = 0.7) -> DataFrame:
    """The score times ``factor`` for rules that a linter covers already."""
    mark = unused(rules, "covered")
    seen = covered.select(F.col(key).alias("of")).distinct().withColumn(mark, F.lit(True))
    return rules.join(seen, F.col(key) == F.col("of"), "left").withColumn(score, F.when(F.col(mark), F.col(score) * factor).otherwise(F.col(score))).drop("of", mark)


def familiarity(uses: Column) -> Column:
    """How well a session knows a pattern by how often it has met it."""
    return F.when(uses >= 5, "expert").when(uses >= 3, "familiar").when(uses >= 1, "novice").otherwise("new")


def compression(loaded: Column, known: Column) -> Column:
    """The way a rule is shown: a mere ``reference`` once loaded, else by how well its pattern is known."""
    return F.when(loaded, "reference").when(known == "expert", "expert").when(known.isin("familiar", "novice"), "familiar").otherwise("first_time")


def detail_level(task: Column, level: Column, complexity: Column, phase: Column) -> Column:
    """The task decides first, then a mismatch of level and complexity, then the session's phase."""
    return (
        F.when(task == "debugging", "minimal").when(task.isin("learning", "exploration"), "detailed").when(task == "refactoring", "standard")
        .when((level == "expert") & (complexity == "basic"), "minimal").when((level == "basic") & (complexity == "advanced"), "detailed")
        .when(phase == "exploration", "detailed").when(phase == "refinement", "minimal").otherwise("standard")
    )


def example_for(examples: list[Column], visits: Column, experts: Column | None = None, rule: Column | None = None) -> Column:
    """An example by visits so far: the longest first, then ever shorter ones; for experts the shortest first. Blank ones don't count.

    Without any example it is the text of the ``rule``, or an empty one.
    """
    kept = F.filter(F.array(*examples), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    sized = F.transform(kept, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))
    falling = F.transform(F.sort_array(F.transform(sized, lambda s: F.struct((-s["n"]).alias("n"), s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])
    rising = F.transform(F.sort_array(sized), lambda s: s["x"])
    at = F.least(visits, F.size(kept) - 1).cast("int")
    found = F.get(falling, at) if experts is None else F.when(experts, F.get(rising, at)).otherwise(F.get(falling, at))
    return F.when(F.size(kept) > 0, found).otherwise(F.lit("") if rule is None else F.coalesce(rule, F.lit("")))


def priority_score(rule_type: Column, matches_level: Column, known: Column) -> Column:
    """What must be done and what is new comes first."""
    must = F.when(rule_type == "must", 10.0).when(rule_type == "should", 5.0).otherwise(0.0)
    return must + F.when(matches_level, 3.0).otherwise(0.0) + F.when(known == "new", 5.0).when(known == "novice", 2.0).otherwise(0.0)


def capped_tokens(tokens: dict[str, Column]) -> dict[str, Column]:
    """Token counts of a rule's examples: each at most its size's cap, none smaller than the size before."""
    out, before = {}, F.lit(0)
    for size, cap in CAPS.items():
        out[size] = before = F.least(F.lit(cap), F.greatest(before, tokens[size])).cast("long")
    return out


def compression_stats(rows: DataFrame, strategy: str, original: str, compressed: str) -> DataFrame:
    """By strategy and (null) in all: rules, tokens before and after, and the share saved."""
    ratio = F.when(F.sum(original) > 0, F.round(1 - F.sum(compressed) / F.sum(original), 6)).otherwise(0.0)
    return rows.rollup(strategy).agg(F.count(F.lit(1)).alias("rules"), F.sum(original).alias("original"), F.sum(compressed).alias("compressed"), ratio.alias("saved"))


def same_targets(rules: DataFrame, patterns: str) -> DataFrame:
    """Rules by identical sets of patterns: ``targets`` (sorted), number of rules and the first of them."""
    return rules.groupBy(F.array_join(F.sort_array(F.array_distinct(patterns)), ",").alias("targets")).agg(F.count(F.lit(1)).alias("rules"), F.min("rule_id").alias("first_rule"))


def by_prefix(names: DataFrame, name: str, standards: DataFrame, standard: str) -> DataFrame:
    """Names with the longest standard's id that they begin with; names without one fall away. Prefixes make it an equi-join."""
    prefixes = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name))), lambda i: F.substring(name, F.lit(1), i))))
    hit = prefixes.join(standards.select(F.col(standard).alias("id")).distinct(), F.col("prefix") == F.col("id"))
    return hit.groupBy(name).agg(F.max_by("id", F.length("id")).alias(standard))


def converted_hints(hints: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Old hints (``rule, context``) in the new shape: what is missing or null takes its default."""
    has = set(hints.columns)
    return hints.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in has else F.lit(v) for c, v in defaults.items()})


def standard_id(path: Column, prefix: str) -> Column:
    """A standard's id from its file's path: without folder prefix and ending, ``/`` as ``-``, in lower case."""
    return F.lower(F.replace(F.regexp_replace(F.regexp_replace(path, f"^{prefix}/?", ""), r"\.md$", ""), F.lit("/"), F.lit("-")))


def merged_imports(rows: DataFrame, module: str, statement: str, order: str) -> DataFrame:
    """One statement for each module: the first."""
    return rows.groupBy(module).agg(F.min_by(statement, order).alias(statement))


def reduced_to(rows: DataFrame, group: str, key: str, tokens: str, least: str, budget: int) -> DataFrame:
    """Largest first, rows of a group shrink to ``least`` until the group's total fits the budget; adds ``final``.

    A row shrinks if what the larger ones before it save isn't enough yet.
    """
    order = Window.partitionBy(group).orderBy(F.desc(tokens), key).rowsBetween(Window.unboundedPreceding, -1)
    excess = F.sum(tokens).over(Window.partitionBy(group)) - budget
    saved = F.coalesce(F.sum(F.col(tokens) - F.least(F.col(least), F.col(tokens))).over(order), F.lit(0))
    return rows.withColumn("final", F.when(saved < excess, F.least(F.col(least), F.col(tokens))).otherwise(F.col(tokens)))

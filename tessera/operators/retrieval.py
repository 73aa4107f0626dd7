"""Rule retrieval: relevance of standards to paths, priority order, budgets that skip what doesn't fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shell_regex

#: Characters of the longest grams by which patterns and parts of names are looked up in paths.
GRAM = 3
#: Shares into which texts are dealt for needles that fit them all.
DEALS = 64
# Factors of a standard's priority, of a session's phase and of its user's level.
PRIORITY = {"required": 1.2, "important": 1.1, "recommended": 1.0}
PHASE = {"exploration": 1.2, "refinement": 0.8}
LEVEL = {"expert": 0.7, "basic": 1.3}


def factor(value: Column, factors: dict[str, float]) -> Column:
    """The factor of a name; 1 for others and null."""
    out = F.lit(1.0)
    for name, f in factors.items():
        out = F.when(value == name, F.lit(f)).otherwise(out)
    return out


def relevance(path: Column, category: Column, tags: Column, globs: Column, priority: Column) -> Column:
    """Score of a standard for a path: folder 1, pattern 0.8, part of a folder 0.6, tag anywhere 0.4; times the priority's factor."""
    parts = F.split(F.lower(path), "/+")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(F.split(path, "/"), -1)
    cat = F.lower(F.coalesce(category, F.lit("")))
    tag = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    match = lambda g: F.rlike(path, shell_regex(g)) | F.rlike(name, shell_regex(g))
    score = (
        F.when((cat != "") & F.array_contains(folders, cat), 1.0)
        .when(F.arrays_overlap(tag, folders), 1.0)
        .when(F.exists(F.coalesce(globs, F.array().cast("array<string>")), match), 0.8)
        .when((cat != "") & F.exists(folders, lambda f: f.contains(cat)), 0.6)
        .when(F.exists(tag, lambda t: F.lower(path).contains(t)), 0.4)
        .otherwise(0.0)
    )
    return score * factor(priority, PRIORITY)


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, as an array."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))


def literal_parts(glob: Column) -> Column:
    """What any path that a shell pattern matches must hold, in lower case: its parts between wild cards, up to its first set of characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(glob), r"(?s)\[.*", ""), r"[*?]+"), lambda x: x != "")


def indexed_needles(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """``id, gram, text``: pairs of a needle and a text that may hold it, by the needle's rarest gram.

    ``needles`` (``id``, ``parts``: an array of strings that a text must hold all of; none for needles that fit any text), ``haystacks`` (``text``).
    A gram is ``GRAM`` characters, or fewer where no part is so long. Grams are counted over all texts first; a needle with a gram that no text holds falls
    away, the others meet only the texts that hold their rarest one, by an equi-join.
    """
    sizes = range(GRAM, 0, -1)
    longest = F.coalesce(F.array_max(F.transform("parts", F.length)), F.lit(0))
    own = F.lit(None).cast("array<string>")
    cut_to = lambda size: F.flatten(F.transform("parts", lambda p: grams(p, size)))
    for size in reversed(sizes):
        own = F.when(longest >= size, cut_to(size)).otherwise(own)
    wanted = needles.select("id", F.explode(F.array_distinct(own)).alias("gram"))
    # needles without a part fit every text: these pairs are the result's own size, dealt out by the text's hash
    mark = lambda n: F.concat(F.lit("any text "), n.cast("string"))
    free = needles.where(longest == 0).select("id", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")).select("id", mark(F.col("deal")).alias("gram"))
    wanted = wanted.unionByName(free)
    every = F.concat(*[grams(F.col("text"), n) for n in sizes], F.array(mark(F.pmod(F.xxhash64("text"), F.lit(DEALS)))))
    cut = haystacks.select("text", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.where(F.length("gram") <= GRAM).join(counts, "gram", "left").groupBy("id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.unionByName(free.select("id", "gram")).join(cut, "gram").select("id", "text")


def relevant_standards(files: DataFrame, standards: DataFrame, path_col: str) -> DataFrame:
    """Pairs of a file and a standard (``category, tags, globs, priority``) with a positive score.

    Whatever can score is something that the path holds: a category, a tag, or the literal parts of a pattern. These are looked up by their
    rarest grams; only the pairs found are scored. Equal paths and equal standards are looked up once and stay as many as they are.
    """
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    key = F.md5(F.to_json(F.struct("category", "tags", "globs", "priority"), {"ignoreNullFields": "false"}))
    known = standards.select(key.alias("_id"), "category", "tags", "globs", "priority").distinct()
    names = F.transform(F.filter(F.concat(F.array("category"), texts("tags")), lambda x: x != ""), lambda x: F.array(F.lower(x)))
    anything = F.filter(texts("tags"), lambda x: x == "")  # an empty tag is a part of any path
    needs = known.select("_id", F.explode(F.concat(names, F.transform(F.filter(texts("globs"), lambda x: x.isNotNull()), literal_parts), F.transform(anything, lambda x: F.array().cast("array<string>")))).alias("parts"))
    lower = files.select(F.col(path_col).alias("_path"), F.lower(path_col).alias("text")).where("text is not null").distinct()
    needles = needs.select(F.struct("_id", "parts").alias("id"), "parts").distinct()
    near = indexed_needles(needles, lower.select("text").distinct()).select(F.col("id._id").alias("_id"), "text").distinct()
    score = relevance(F.col("_path"), F.col("category"), F.col("tags"), F.col("globs"), F.col("priority"))
    scored = near.join(lower, "text").join(known, "_id").withColumn("score", score).where("score > 0").select("_id", "_path", "score")
    return files.join(scored, F.col(path_col) == F.col("_path")).join(standards.withColumn("_own", key), F.col("_id") == F.col("_own")).drop("_id", "_own", "_path").select(*files.columns, *standards.columns, "score")


def session_budget(budget: Column, phase: Column, level: Column) -> Column:
    """A token budget adjusted to phase and level, each step cut off, between half and twice the budget."""
    by_phase = F.floor(budget * factor(phase, PHASE))
    by_level = F.floor(by_phase * factor(level, LEVEL))
    return F.greatest(F.least(by_level, budget * 2), F.floor(budget / 2)).cast("long")


def budget_skip(rows: DataFrame, key: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Per key, the rows in order that still fit; a row that doesn't is skipped and later, smaller ones may fit.

    Rows of a key stream through one task, sorted by Spark, with the running total as only state; rows larger than the whole budget go before the shuffle.
    """

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = object(), 0
        for b in batches:
            keep = []
            for k, n in zip(b.column(key).to_pylist(), b.column(tokens).to_pylist(), strict=True):
                if k != current:
                    current, total = k, 0
                fits = total + n <= budget
                total += n if fits else 0
                keep.append(fits)
            yield b.filter(pa.array(keep, pa.bool_()))

    fitting = rows.where(F.col(tokens) <= budget)
    return fitting.repartition(key).sortWithinPartitions(F.col(key), *order).mapInArrow(taken, fitting.schema)

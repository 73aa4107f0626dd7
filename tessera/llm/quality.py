"""Line-first cleaning: rules judge each line, failed lines go, and a document that loses too much of its text is rejected.

Everything is a column expression over the document's own row, so nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as characters and as a pattern.
SPACE = " \t\n\x0b\f\r"
GAP, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: A mark that ends a sentence: where white space or the line's end follows, or anywhere in scripts without spaces.
SENTENCE_END = rf"""[.!?…]["'”’»)\]]*(?:{GAP}|\z)|[。！？؟।]"""
FOUR_WORDS = rf"\A{GAP}*(?:{WORD}+{GAP}+){{3}}{WORD}"
#: Runs of what is neither letter, mark nor digit, nor white space.
NOT_WORD = r"[^A-Za-z0-9\x20\x09-\x0D\p{L}\p{M}\p{N}]+"
#: What separates the items of a menu or a trail; three make one.
SEPARATOR = "[|»›•·]"
MENU = r"\A(?:[^|»›•·]*[|»›•·]){3}"
#: Whole lines that only lead elsewhere.
LINKS = (
    "home", "menu", "next", "previous", "prev", "back", "back to top", "top of page", "read more", "learn more", "see more", "show more", "more", "share", "share this", "log in", "login",
    "sign in", "sign up", "register", "subscribe", "search", "skip to content", "skip to main content", "contact", "contact us", "about", "about us", "site map", "sitemap", "print", "reply",
)
#: Phrases of notices that aren't a document's own text.
NOTICES = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "use of cookies", "uses cookies",
    "enable javascript", "lorem ipsum", "copyright ©", "copyright (c)", "© copyright",
)


NAVIGATION = rf"(?i)\A{GAP}*(?:[<>«»‹›←→]{GAP}*)?(?:{'|'.join(LINKS)}){GAP}*(?:[<>«»‹›←→.…]{GAP}*)*\z"


def noticed(lower: Column) -> Column:
    """Whether a text in lower case holds a notice."""
    return reduce(Column.__or__, [F.contains(lower, F.lit(x)) for x in NOTICES])


def line_fails(line: Column, most_marks: int = 25, menus: Column | None = None, notices: Column | None = None) -> dict[str, Column]:
    """Whether a line breaks each rule; menus and notices are looked for only where the text holds any.

    ``punctuation``: four words or more without an end of a sentence, or marks (four at least) that make up more than ``most_marks`` percent of
    the line's characters. ``navigation``: a menu of items, or a line that only leads elsewhere. ``boilerplate``: a notice.
    """
    # characters that stay when marks go: at most length - 4, and less than the other share
    most_left = F.least(100 * (F.length(line) - 4), (100 - most_marks) * F.length(line) - 1)
    return {
        "navigation": (line.rlike(MENU) if menus is None else menus & line.rlike(MENU)) | line.rlike(NAVIGATION),
        "punctuation": ~line.rlike(SENTENCE_END) & line.rlike(FOUR_WORDS) | (100 * F.length(F.regexp_replace(line, NOT_WORD, "")) <= most_left),
        "boilerplate": noticed(F.lower(line)) if notices is None else notices & noticed(F.lower(line)),
    }


def repeated_words(docs: DataFrame, words: str, into: str, scratch: tuple[str, str, str]) -> DataFrame:
    """``docs`` with the number of words in windows of eight that the same array of ``words`` holds twice or more.

    Hashes of words are joined to hashes of two, four and eight (64 bits; equal hashes count as equal windows). Only where some repeat are
    windows sorted with their places, so a text costs its length times that length's logarithm at most. ``scratch`` are unused names.
    """
    one, two, four = scratch
    join = lambda c, step: F.transform(c, lambda x, i: F.xxhash64(x, F.get(F.col(c), i + step)))
    eight = docs.withColumn(one, F.transform(words, lambda w: F.xxhash64(w))).withColumn(two, join(one, 1)).withColumn(four, join(two, 2)).withColumn(one, join(four, 4))
    eight = eight.withColumn(two, F.when(F.size(words) >= WINDOW, F.slice(one, F.lit(1), F.size(words) - (WINDOW - 1)))).drop(one, four)
    # each window beside its place, equal ones together; only where any are equal
    eight = eight.withColumn(one, F.when(F.size(F.array_distinct(two)) < F.size(two), F.sort_array(F.transform(two, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = lambda i: F.get(F.col(one), i)["h"]
    places = F.sort_array(F.transform(F.filter(one, lambda x, i: (x["h"] == beside(i + 1)) | ((i > 0) & (x["h"] == beside(i - 1)))), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).alias("n")))
    return eight.withColumn(into, F.coalesce(covered["n"], F.lit(0).cast("long"))).drop(one, two)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = 50, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """A row per document: ``doc_id, text`` (cleaned), counts of the whole text, ``n_lines, n_removed, lost_chars``, ``base_failed`` and ``kept``.

    ``n_words`` and ``word_chars`` count words and their characters, ``n_symbols`` symbols, ``n_dup_lines`` lines with a word that repeat an
    earlier line, ``n_repeat_words`` words in repeated windows of eight. A document fails at once with fewer than ``least_words`` words or more than
    ``most_repeated`` percent of them repeated. Others lose their failed lines (see ``line_fails``) and are rejected if more than ``most_lost``
    percent of their words' characters went with them. Lines without a word stay where they are.

    A null text counts as empty and fails; repeated rows, equal texts and null ids are judged one by one. Very long texts are judged whole.
    Other columns aren't read, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lone = F.trim("t", F.lit(SPACE))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("words", F.when(F.length(lone) == 0, F.array().cast("array<string>")).otherwise(F.split(lone, GAP + "+")))
    rows = repeated_words(rows.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long")), "words", "n_repeat_words", ("one", "two", "four")).drop("words")
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    rows = rows.withColumn("n_symbols", F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long"))
    rows = rows.withColumn("lower", F.lower("t")).withColumn("notices", noticed(F.col("lower"))).withColumn("menus", F.col("t").rlike(SEPARATOR)).withColumn("lines", F.split("t", "\n")).drop("lower")
    rows = rows.withColumn("own", F.filter("lines", lambda x: x.rlike(WORD)))
    rows = rows.withColumn("n_dup_lines", (F.size("own") - F.size(F.array_distinct("own"))).cast("long")).drop("own")
    rows = rows.withColumn("left", F.filter("lines", lambda x: ~(x.rlike(WORD) & reduce(Column.__or__, line_fails(x, menus=F.col("menus"), notices=F.col("notices")).values()))))
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_removed", (F.size("lines") - F.size("left")).cast("long")).withColumn("text", F.array_join("left", "\n"))
    rows = rows.withColumn("lost_chars", F.when(F.col("n_removed") == 0, F.lit(0).cast("long")).otherwise(F.col("word_chars") - F.length(F.regexp_replace("text", GAP + "+", ""))))
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))
    out = ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed", "lost_chars", "base_failed")
    # one struct, unfolded again: a filter on the verdict stays above it, else it would copy every rule's expression into itself
    return rows.select("doc_id", F.inline(F.array(F.struct(*out, kept.alias("kept")))))


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``doc_id, text`` of the documents that stay, without their failed lines."""
    return clean_documents(docs, id_col, text_col, **limits).where("kept").select("doc_id", "text")

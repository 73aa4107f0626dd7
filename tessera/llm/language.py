"""Language ID by unigrams with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary, fitted by expectation
maximisation. A word's likelihood is the sum over all ways to cut it into pieces (forward algorithm); a text's
is the product over its words. Spark reads and scores the texts where they lie: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.memory import frugal, give_back, keeps, small_batches
from tessera.llm.storage import written

#: Probability of a single character that is no piece; the same for every language.
FLOOR = 1e-7
START = "▁"
#: Bytes of text that are scored at a time; some tens of times as much memory goes into their runs and scores.
SLICE_BYTES = 2 << 20


def vocabulary(path: str, longest: int = 12) -> dict[str, int]:
    """The distinct lower-case pieces of a sentencepiece model, numbered: those of letters alone, of ``longest`` characters at most.

    Longer pieces cost time and tell little; a word that has one is still scored by its shorter pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    kept = dict.fromkeys(p for p in names if len(p) <= longest and re.fullmatch(rf"{START}?[^\W\d_]*", p))
    return {p: i for i, p in enumerate(kept)}


def _lattice(words: list[str], pieces: dict[str, int], longest: int) -> np.ndarray:
    """For words of one length: the piece at each start and length; -1 where there is none, -2 for a bare character."""
    n = len(words[0])
    out = np.full((len(words), n, longest), -1, np.int32)
    for w, word in enumerate(words):
        row = out[w]
        for i in range(n):
            row[i, 0] = -2
            for j in range(1, min(longest, n - i) + 1):
                p = pieces.get(word[i : i + j])
                if p is not None:
                    row[i, j - 1] = p
    return out


def _table(logits: np.ndarray) -> np.ndarray:
    """Piece probabilities with rows for -2 (bare character) and -1 (no piece) at the end."""
    return np.concatenate([logits, np.full((1, logits.shape[1]), FLOOR), np.zeros((1, logits.shape[1]))])


def _forward(lattice: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, position, language], scaled, and the log of what it was scaled by at the end."""
    words, n, longest = lattice.shape
    alpha = np.zeros((words, n + 1, table.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((words, table.shape[1]))
    for j in range(1, n + 1):
        for size in range(1, min(longest, j) + 1):
            alpha[:, j] += alpha[:, j - size] * table[lattice[:, j - size, size - 1]]
        if j % 24 == 0:  # long runs of letters would underflow
            top = alpha[:, max(0, j - longest) : j + 1].max(axis=1)
            alpha[:, max(0, j - longest) : j + 1] /= top[:, None]
            scale += np.log(top)
    return alpha, scale


def log_likelihood(words: list[str], pieces: dict[str, int], table: np.ndarray, longest: int) -> np.ndarray:
    """log P(word | language) for each word and language; words are lower-case without the start mark."""
    out = np.empty((len(words), table.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for size, rows in by_length.items():
        step = max(1, 400_000 // ((size + 1) * longest))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            alpha, scale = _forward(_lattice([START + words[i] for i in some], pieces, longest), table)
            out[some] = np.log(alpha[:, -1]) + scale
    return out


def fit_pieces(counts: dict[str, float], pieces: dict[str, int], longest: int, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """One language's piece probabilities from word counts, by expectation maximisation over all segmentations."""
    by_length: dict[int, list[str]] = {}
    for w in counts:
        if len(w) <= 40:  # longer runs are junk, and scored all the same
            by_length.setdefault(len(w), []).append(w)
    lattices = [(_lattice([START + w for w in ws], pieces, longest), np.array([counts[w] for w in ws])) for ws in by_length.values()]
    p = np.full(len(pieces), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        table, seen = _table(p[:, None]), np.zeros(len(pieces) + 2)
        for lattice, n in lattices:
            alpha, _ = _forward(lattice, table)
            alpha, size = alpha[:, :, 0], lattice.shape[1]
            # the same scaling from the other side isn't needed: words of at most 40 characters stay in range
            raw = np.zeros_like(alpha)
            raw[:, 0] = 1
            beta = np.zeros_like(alpha)
            beta[:, size] = 1
            for j in range(1, size + 1):
                for s in range(1, min(longest, j) + 1):
                    raw[:, j] += raw[:, j - s] * table[lattice[:, j - s, s - 1], 0]
            for i in range(size - 1, -1, -1):
                for s in range(1, min(longest, size - i) + 1):
                    beta[:, i] += table[lattice[:, i, s - 1], 0] * beta[:, i + s]
            weight = n / np.maximum(raw[:, size], 1e-300)
            for i in range(size):
                for s in range(1, min(longest, size - i) + 1):
                    at = lattice[:, i, s - 1]
                    np.add.at(seen, at, weight * raw[:, i] * table[at, 0] * beta[:, i + s])
        p = (seen[: len(pieces)] + smooth) / (seen[: len(pieces)].sum() + smooth * len(pieces))
    return p


@dataclass
class LanguageModel:
    """Learned languages and their piece probabilities; scores whole columns of text."""

    path: str
    languages: list[str]
    table: np.ndarray
    longest: int = 12
    cache: int = 100_000
    pieces: dict[str, int] = field(default_factory=dict)
    known: dict[bytes, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def _of(self, words: list[bytes]) -> np.ndarray:
        """Scores of distinct words; those of frequent ones are kept from batch to batch."""
        at = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        if self.scores is None:
            self.scores = np.empty((self.cache, len(self.languages)))
        out = np.empty((len(words), len(self.languages)))
        out[at >= 0] = self.scores[at[at >= 0]]
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            out[some] = fresh = log_likelihood([words[i].decode() for i in some], self.pieces, self.table, self.longest)
            for i, x in zip(some[: self.cache - len(self.known)].tolist(), fresh, strict=False):
                if len(words[i]) <= 40:
                    self.scores[len(self.known)] = x
                    self.known[words[i]] = len(self.known)
        return out

    def forget(self) -> None:
        self.known, self.scores, self.pieces = {}, None, {}

    def score(self, texts: pa.Array) -> np.ndarray:
        """log P(text | language); a row of NaN for a text without letters."""
        if not self.pieces:
            self.pieces = vocabulary(self.path, self.longest)
        out = np.full((len(texts), len(self.languages)), np.nan)
        for first, words, bounds in letter_runs(texts):
            if not len(words):
                continue
            coded = words.dictionary_encode()
            each = self._of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            has = np.flatnonzero(np.diff(bounds))
            out[first + has] = np.add.reduceat(each, bounds[has], axis=0)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior; ``und`` and 0 without letters or without languages."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs = self.score(texts)
        none = np.isnan(logs[:, 0])
        logs[none] = 0
        best = logs.argmax(1)
        share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        share[none] = 0
        return [("und" if u else self.languages[b]) for b, u in zip(best, none, strict=True)], share


def letter_runs(texts: pa.Array):
    """Slices of a column as (first row, runs of letters in lower case, bounds of each row's runs)."""
    first = 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while first < len(texts):
        done = sizes[first - 1] if first else 0
        last = min(len(texts), max(first + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right"))))
        some = pc.fill_null(texts.slice(first, last - first), "").cast(pa.large_string())
        # each row ends with a space, so that no run crosses rows
        plain = pc.binary_join_element_wise(pc.replace_substring_regex(pc.utf8_lower(some), r"\P{L}+", " "), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        gap = data == 0x20
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1 if len(data) else np.zeros(0, np.int64)
        # the gaps between runs are cut away by giving the runs buffers of their own
        keep = np.ascontiguousarray(data[~gap])
        lengths = ends - starts
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(keep)])
        yield first, words, np.searchsorted(starts, offsets - offsets[0], "left")
        first = last


def _word_counts(batches):
    for b in batches:
        for first, words, bounds in letter_runs(b.column("text")):
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + first
            table = pa.table({"lang": b.column("lang").take(pa.array(of)), "word": words.cast(pa.binary()).cast(pa.string())})
            counted = table.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counted.rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()


def fit_languages(labelled: DataFrame, path: str, fit_docs: int = 400, fit_words: int = 40_000, longest: int = 12, most_languages: int = 200) -> LanguageModel:
    """A model of the languages in ``labelled`` (doc_id, text, lang; rows with a null lang or text are left out).

    It is fitted on a bounded sample: ``fit_docs`` documents of each language, chosen by a hash of id and text, and of
    these the ``fit_words`` most frequent words. ``most_languages`` bounds the model's size; more languages are an
    error before anything is collected. Each language is fitted by a task of its own.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages; the model is meant for that many at most")
    if not sizes:
        return LanguageModel(path, [], np.zeros((0, 0)), longest)
    # about twice as many documents as needed hash below a language's bound, so few thin rows are ranked
    bounds = [(r["lang"], min(2**63 - 1, int(min(1.0, (2 * fit_docs + 64) / r["docs"]) * (2**64 - 1)) - 2**63)) for r in sizes]
    bounds = spark.createDataFrame(bounds, "lang string, most long")  # a row for each language
    thin = known.select("lang", "h").join(F.broadcast(bounds), "lang").where("h <= most").select("lang", "h").distinct()
    chosen = thin.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= fit_docs).select("lang", "h")
    sample = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")  # most_languages * fit_docs thin rows
    counts = sample.mapInArrow(frugal(_word_counts, "language"), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts = written(counts.withColumn("nth", F.row_number().over(frequent)).where(F.col("nth") <= fit_words).select("lang", "word", "n"), "language-words")

    def fit(table: pa.Table) -> pa.Table:
        words = dict(zip(table.column("word").to_pylist(), map(float, table.column("n").to_pylist()), strict=True))
        fitted = fit_pieces(words, vocabulary(path, longest), longest)
        give_back()
        return pa.table({"lang": [table.column("lang")[0].as_py()], "p": pa.array([fitted.tobytes()], pa.binary())})

    found = {r["lang"]: np.frombuffer(r["p"], float) for r in counts.groupBy("lang").applyInArrow(fit, "lang string, p binary").collect()}  # a vocabulary for each language
    languages = sorted(found)
    return LanguageModel(path, languages, _table(np.stack([found[x] for x in languages], axis=1)) if languages else np.zeros((0, 0)), longest)


def predicted_language(text: Column, model: LanguageModel, spark) -> Column:
    """A struct ``lang_pred string, score double`` for a text; null and letterless texts are ``und`` with 0."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        keeps(f"language {id(shared.value)}", shared.value.forget)
        found, share = shared.value.predict(texts)
        give_back()  # slices of unlike sizes would pile up in the allocator
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(share)], names=["lang_pred", "score"])

    return predict(text)


def held_out(id_column: Column) -> Column:
    """True for the documents that nothing is learned from: a quarter, by crc32 of the id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from the text and lang of the documents that aren't held out, then predicts all from their
    text alone. A null, empty or letterless text is ``und`` with score 0, and so is every text where nothing is
    labelled. Very long texts are read whole. Of equally likely languages the first by code point is taken. Repeated rows are
    predicted alike. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit_languages(rows.where(~held_out(F.col("doc_id"))), path, **fit)
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted_language(F.col("text"), model, docs.sparkSession).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known_languages(docs: DataFrame, path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose language is recognised with a posterior of ``least`` or more.

    Null, empty and letterless texts go. Equal texts stay or go together, however often they occur; an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit_languages(rows.where(~held_out(F.col("doc_id"))), path, **fit)
    found = predicted_language(F.col(text_col), model, docs.sparkSession)
    row = F.struct(*[F.col(c) for c in docs.columns])  # in a struct, no column of theirs can clash
    both = docs.select(row.alias("row"), found.alias("found"))
    return both.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least)).select("row.*")

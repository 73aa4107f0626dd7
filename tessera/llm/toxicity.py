"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over words and word beginnings; the probability of
each earlier category is a feature of the later models. In training these probabilities come from models
that haven't seen the document (out-of-fold), so that later links learn from what they will meet in use.
Terms are counted and texts scored by Spark where they lie; the models are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import letter_runs
from tessera.llm.memory import frugal, give_back, small_batches
from tessera.llm.storage import written

#: Longer words also count by their first letters, marked with a star.
STEM = 4


def _terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


def _term_counts(batches: Iterator[pa.RecordBatch], categories: int) -> Iterator[pa.RecordBatch]:
    """Per term: documents that hold it, and of these the ones of each category; summed over a batch."""
    for b in batches:
        flags = [b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(categories)]
        seen: dict[str, list[float]] = {}
        for first, words, bounds in letter_runs(b.column(0)):
            listed = words.cast(pa.binary()).cast(pa.string()).to_pylist()
            for i in range(len(bounds) - 1):
                row = [1, *(f[first + i] for f in flags)]
                for t in {t for w in set(listed[bounds[i] : bounds[i + 1]]) for t in _terms_of(w)}:
                    old = seen.get(t)
                    seen[t] = row if old is None else [x + y for x, y in zip(old, row, strict=True)]
        if seen:
            counts = np.array(list(seen.values()))
            yield pa.record_batch([pa.array(list(seen)), *(pa.array(counts[:, k].astype(np.int64)) for k in range(categories + 1))], names=["term", "n", *(f"n{k}" for k in range(categories))])


def _held(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of all terms of the vocabulary that a text holds, each pair once, by row."""
    found = []
    for first, words, bounds in letter_runs(texts):
        coded = words.dictionary_encode()
        own = [[vocabulary[t] for t in _terms_of(w.decode()) if t in vocabulary] for w in coded.dictionary.to_pylist()]
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + first
        which = coded.indices.to_numpy()
        for k in (0, 1):
            term = np.fromiter((o[k] if len(o) > k else -1 for o in own), np.int64, len(own))[which]
            hit = term >= 0
            found.append(rows[hit] * len(vocabulary) + term[hit])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_link(rows: np.ndarray, terms: np.ndarray, dense: np.ndarray, y: np.ndarray, k: int, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of ``k`` terms, then of the columns of ``dense``, then the constant; accelerated gradient steps."""
    n = max(1, len(y))
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w = np.zeros(k + dense.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    ahead, t = w.copy(), 1.0
    # each coordinate steps by its own curvature bound
    per_row = np.bincount(rows, minlength=len(y)).astype(float) + np.abs(dense).sum(1) + 1
    bound = np.concatenate([np.bincount(terms, per_row[rows], minlength=k), (np.abs(dense) * per_row[:, None]).sum(0), [per_row.sum()]]) / (4 * n) + ridge
    for _ in range(steps):
        z = np.bincount(rows, ahead[terms], minlength=len(y)) + dense @ ahead[k:-1] + ahead[-1]
        error = _sigmoid(z) - y
        gradient = np.concatenate([np.bincount(terms, error[rows], minlength=k), dense.T @ error, [error.sum()]]) / n
        gradient[:-1] += ridge * ahead[:-1]
        new = ahead - gradient / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def _link(w: np.ndarray, rows: np.ndarray, terms: np.ndarray, dense: np.ndarray) -> np.ndarray:
    k = len(w) - dense.shape[1] - 1
    return _sigmoid(np.bincount(rows, w[terms], minlength=len(dense)) + dense @ w[k:-1] + w[-1])


@dataclass
class ToxicityChain:
    """The terms that count and each category's weights, in the order of the chain."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        rows, terms = _held(texts, self.vocabulary)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.concatenate([out, _link(w, rows, terms, out)[:, None]], axis=1)
        return out


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[str, ...],
    fit_rows: int = 20_000,
    folds: int = 3,
    terms: int = 1_500,
    least: int = 5,
) -> ToxicityChain:
    """The chain over 0/1 ``categories`` of ``labels`` (doc_id and categories; of repeated ids the largest label counts).

    It is fitted on a bounded sample: the ``fit_rows`` labelled documents whose ids hash lowest, and for
    each category the ``terms`` terms, held by ``least`` documents or more, that tell it best (likelihood
    ratio). A null label counts as 0. Without labels the chain gives 0 for each category. The sample is written
    once; models of one link (the whole sample's and one for each fold) are fitted by tasks of their own.
    """
    chosen = labels.groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in categories])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = written(chosen, "toxicity-labels")  # fit_rows thin rows
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", *categories), "toxicity-sample")
    n = len(categories)
    counts = written(
        sample.select("text", *categories)
        .mapInArrow(frugal(lambda batches: _term_counts(batches, n), "toxicity"), "term string, n long, " + ", ".join(f"n{k} long" for k in range(n)))
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("n", *(f"n{k}" for k in range(n)))])
        .where(F.col("n") >= least),
        "toxicity-terms",
    )
    totals = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in categories]).first()
    vocabulary: dict[str, int] = {}
    for k in range(n):
        size, positive = float(totals[0] or 1), float(totals[1 + k])

        def part(have: Column, expected: Column) -> Column:
            return F.when(have > 0, have * F.log(have / expected)).otherwise(0.0)

        p, q = F.col(f"n{k}"), F.col("n") - F.col(f"n{k}")
        a, b = F.lit(positive), F.lit(size - positive)
        told = part(p, F.col("n") * a / size) + part(q, F.col("n") * b / size) + part(a - p, (size - F.col("n")) * a / size) + part(b - q, (size - F.col("n")) * b / size)
        for r in counts.orderBy(F.desc(told), "term").limit(terms).collect():  # at most `terms` rows
            vocabulary.setdefault(r["term"], len(vocabulary))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, own = _held(b.column("text"), vocabulary)
            at = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *categories)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32)))], names=["doc_id", *categories, "terms"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    data = sample.mapInArrow(held, f"doc_id {id_type}, " + ", ".join(f"{c} int" for c in categories) + ", terms array<int>")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    got = data.select(fold, *categories, "terms").toArrow()  # term numbers of fit_rows documents
    lists = got.column("terms").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    term_of = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row_of = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy())) if got.num_rows else np.zeros(0, np.int64)
    fold_of = got.column("fold").to_numpy()
    dense, weights = np.zeros((got.num_rows, 0)), []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((row_of.astype(np.int32), term_of.astype(np.int32), fold_of))  # fit_rows documents' terms
    for c in categories:
        y = got.column(c).to_numpy().astype(float)
        models = folds + 1 if c != categories[-1] else 1  # the last one's probabilities feed nothing

        def fit(batches: Iterator[pa.RecordBatch], y=y, dense=dense) -> Iterator[pa.RecordBatch]:
            row_of, term_of, fold_of = shared.value
            for k in (k for b in batches for k in b.column(0).to_pylist()):
                rest = fold_of != k
                inside = rest[row_of]
                place = np.cumsum(rest) - 1
                w = fit_link(place[row_of[inside]], term_of[inside].astype(np.int64), dense[rest], y[rest], len(vocabulary))
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["k", "w"])

        # model `folds` leaves no fold out
        tasks = spark.range(folds + 1 - models, folds + 1, numPartitions=models)
        fitted = {r["k"]: np.frombuffer(r["w"]) for r in tasks.mapInArrow(frugal(fit), "k long, w binary").collect()}
        weights.append(fitted[folds])
        if c == categories[-1]:
            break
        unseen = np.zeros(len(y))
        for k in range(folds):
            own = fold_of == k
            unseen[own] = _link(fitted[k], row_of, term_of, dense)[own]
        dense = np.concatenate([dense, unseen[:, None]], axis=1)
    shared.unpersist()
    return ToxicityChain(tuple(categories), vocabulary, weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), threshold: float = 0.25, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """One row per document: ``doc_id``, ``p_<category>`` each, and ``is_toxic`` (the last category above ``threshold``).

    Null and empty texts have no words and get the models' base rates. Very long texts are read whole. Without labels every
    probability is about 0. Equal texts and repeated rows are scored alike; an empty table gives no rows. Other columns aren't
    read, whatever their names; a label that is itself called ``text`` can't be a category.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(rows, labels, categories, **fit))
    names = [f"p_{c}" for c in categories]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def probabilities(texts: pa.Array) -> pa.Array:
        found = shared.value.probabilities(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(found.shape[1])], names=names)

    scored = rows.select("doc_id", probabilities("text").alias("p")).select("doc_id", "p.*")
    return scored.withColumn("is_toxic", F.col(names[-1]) >= threshold)

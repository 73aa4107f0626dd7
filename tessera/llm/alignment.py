"""Alignment of two tokenizers' ids over the same bytes.

Each document is encoded twice, by a byte-level vocabulary (A) and by one of pieces (B). A dictionary from the byte at which a
token ends to the token's index is made for each side; the keys that both have, sorted, cut the two id lists into groups, and
each group's slice gives its links. How often the corpus links two ids is summed by Spark: a batch of documents sends each of
its distinct pairs once and gets the pair's count back once, so neither links nor counts of the corpus meet in one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import arrow_rows, frugal, give_back, keeps
from tessera.llm.storage import checkpointed, written
from tessera.llm.tokens import PieceEncoder

#: Bytes of text whose pairs are counted together; a longer single text is a batch of its own.
BATCH_BYTES = 16 << 20
#: Pieces that a worker keeps for each vocabulary, and bytes of text that it cuts at a time; longer single texts are taken whole.
CACHED, SLICE_BYTES = 200_000, 1 << 20
#: Bytes of text for which the dictionaries of ends are held at a time.
SPAN_BYTES = 1 << 18
#: Links that are looked up at a time.
LINKS = 1 << 18
#: Rows of pairs in an Arrow batch.
PAIR_ROWS = 1 << 16
#: What stands for a space in a vocabulary of pieces.
SPACE_MARK = "▁"


class SentencePieces:
    """Ids of texts that begin with the space which the model would add, cut before each run of spaces and cached by piece."""

    def __init__(self, path: str, cache: int = CACHED, longest: int = 32):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        #: no piece goes on with a space, so what stands before a run of spaces is encoded apart from it
        self.apart = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.space = [self.model.piece_to_id(SPACE_MARK)]
        self.cache, self.longest, self.known = cache, longest, {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        out = [known.get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            for i, ids in zip(some, self.model.encode([pieces[i][1:].decode(errors="replace") for i in some], num_threads=1), strict=True):
                piece = pieces[i]
                out[i] = coded = np.array(self.space if piece == b" " else ids, np.uint32).tobytes()
                if len(piece) <= self.longest and len(known) < self.cache:
                    known[piece] = coded
        return out

    def encode_slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and each text's offset into them; ``bounds`` are the texts' offsets into ``data``."""
        start = np.zeros(len(data), dtype=bool)
        if self.apart:
            start[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        done = np.frombuffer(ids.buffers()[1], np.int64)[: len(at) + 1] // 4
        return np.frombuffer(ids.buffers()[2] or b"", np.uint32)[: done[-1]], done[np.searchsorted(at, bounds, "left")]


def byte_level_bytes(encoder: PieceEncoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an id without an entry has none."""
    spelt = {chr(encoder.letters.get(b, b)): b for b in range(256)}
    out = [b""] * encoder.tokenizer.get_vocab_size()
    for token, i in encoder.tokenizer.get_vocab().items():
        # an entry that isn't spelt in bytes is an added token's own string
        out[i] = bytes(spelt[c] for c in token) if all(c in spelt for c in token) else token.encode()
    return out


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices, in A and in B, of the tokens that end at the same byte, in order; both ``ends`` ascend."""
    at_a, at_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    last = int(max(ends_a[-1], ends_b[-1])) if len(ends_a) and len(ends_b) else 0
    steps = np.arange(0, last + SPAN_BYTES, SPAN_BYTES)
    for i, j, k, n in zip(*(x for e in (ends_a, ends_b) for s in [np.searchsorted(e, steps, "right")] for x in (s[:-1], s[1:])), strict=True):
        index_a, index_b = dict(zip(ends_a[i:j].tolist(), range(i, j))), dict(zip(ends_b[k:n].tolist(), range(k, n)))
        common = sorted(index_a.keys() & index_b.keys())
        at_a.append(np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)))
        at_b.append(np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)))
    return np.concatenate(at_a), np.concatenate(at_b)


class Aligner:
    """Two vocabularies, their ids' bytes and their ids' decimal strings with each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PieceEncoder(path_a, cache=CACHED), SentencePieces(path_b)
        self.a.tokenizer.encode_special_tokens = True  # their strings inside texts are plain text
        bytes_a = byte_level_bytes(self.a)
        self.n_a, self.n_b = len(bytes_a), len(self.b.bytes_of)
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(self.b.bytes_of, pa.large_binary())
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, self.b.bytes_of))
        self.shown = pa.array([f"{i}{end}" for n, end in ((self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")) for i in range(n)], pa.large_binary())

    def whole(self, table: pa.Array, ids: np.ndarray, at: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each text's ids spell its bytes."""
        spelt = table.take(pa.array(ids))
        offsets = np.frombuffer(spelt.buffers()[1], np.int64)[: len(ids) + 1]
        flat = np.frombuffer(spelt.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        if len(flat) == len(data) and np.array_equal(offsets[at], bounds) and np.array_equal(flat, data):
            return np.ones(len(at) - 1, dtype=bool)
        ends = offsets[at]
        return np.array([np.array_equal(flat[i:j], data[k:n]) for i, j, k, n in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True)], dtype=bool)

    def groups(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts (each with its leading space, or of no byte): counts of A and B ids and of groups, the groups as text with its offsets, and the linked pairs."""
        (ids_a, at_a), (ids_b, at_b) = self.a._slice(data, bounds), self.b.encode_slice(data, bounds)
        fits = self.whole(self.bytes_a, ids_a, at_a, data, bounds) & self.whole(self.bytes_b, ids_b, at_b, data, bounds)
        if not fits.all():  # such texts have no tokens; they go, bytes and all
            ids_a, ids_b = ids_a[np.repeat(fits, np.diff(at_a))], ids_b[np.repeat(fits, np.diff(at_b))]
            at_a, at_b = (np.append(0, np.cumsum(np.diff(at) * fits)) for at in (at_a, at_b))
        last_a, last_b = shared_ends(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        place_a = np.arange(len(ids_a)) + np.repeat(last_b + 1 - sizes_b, sizes_a)
        place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, sizes_b)
        shown[place_a], shown[place_b] = ids_a, ids_b.astype(np.int64) + 2 * self.n_a
        shown[place_a[last_a]] += self.n_a
        shown[place_b[last_b]] += self.n_b
        text = self.shown.take(pa.array(shown))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(shown) + 1][at_a + at_b]
        first = np.searchsorted(last_a, at_a, "left")
        # a group's tokens that end together are its last two
        pairs = ids_a[last_a].astype(np.int64) * self.n_b + ids_b[last_b]
        return np.diff(at_a), np.diff(at_b), first, memoryview(text.buffers()[2] or b""), offsets, pairs


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker process's aligner of these vocabularies."""
    keeps(f"alignment {path_a} {path_b}", _ALIGNERS.clear)
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a column, a space before each text; null and empty texts have no byte."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    raw = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(raw), 0), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())), raw, pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data, first = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
    while first < len(raw):
        last = min(len(raw), max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1))
        yield first, np.ascontiguousarray(data[offsets[first] : offsets[last]]), offsets[first : last + 1] - offsets[first]
        first = last


ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, batch long, pairs binary, counts binary"


def _aligned(docs: DataFrame, path_a: str, path_b: str, show: bool) -> DataFrame:
    """A row for each document, with its linked pairs, and one for each batch of them, with its distinct pairs and how often they occur."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, size, held = TaskContext.get().partitionId(), 0, 0, []
        kind = None

        def summary() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            counts = np.bincount(counts, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)
            row = {"doc_id": pa.nulls(1, kind), **{n: pa.nulls(1, pa.int64()) for n in ("n_a", "n_b", "n_groups")}, **{n: pa.nulls(1, pa.string()) for n in ("groups_sha256", "groups")}, "links": pa.nulls(1, pa.binary())}
            return pa.record_batch([*row.values(), pa.array([task << 32 | nth]), pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=[*row, "batch", "pairs", "counts"])

        for b in batches:
            kind = b.column("doc_id").type
            for first, data, bounds in _slices(b.column("text")):
                n_a, n_b, at, text, offsets, pairs = aligner(path_a, path_b).groups(data, bounds)
                n = len(n_a)
                groups = [text[i : j - 1] if j > i else b"" for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                wide = np.append(0, at[1:]) * 8
                links = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(wide.astype(np.int64)), pa.py_buffer(pairs.astype("<i8"))]).cast(pa.binary())
                yield pa.record_batch(
                    [b.column("doc_id").slice(first, n), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.diff(at))), pa.array([hashlib.sha256(g).hexdigest() if len(g) else "" for g in groups]), pa.array([bytes(g).decode() for g in groups]) if show else pa.nulls(n, pa.string()), links, pa.array(np.full(n, task << 32 | nth)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links", "batch", "pairs", "counts"],
                )
                held.append(np.unique(pairs, return_counts=True))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield summary()
                    nth, size, held = nth + 1, 0, []
            give_back()
        if held:
            yield summary()

    return docs.mapInArrow(frugal(align), f"doc_id {id_type}, {ALIGNED}")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, on request, ``groups``.

    ``path_a`` is a byte-level vocabulary, fed a space and the text, ``path_b`` one of pieces, which adds that space itself. Token bytes that end
    at the same place in both cut a document into groups, written ``a1,a2|b1;a3|b2,b3``; those two tokens are linked. ``n_best`` counts the
    links whose pair is, over all documents, the most frequent one of its B id (ties included), ``count_sum`` sums the pairs' counts.

    Null and empty texts, and texts whose tokens don't spell them, have zeros and an empty string. Repeated rows, equal texts and rows
    with a null id are documents of their own and count as often as they occur. A very long text is encoded whole; its ends are held for a
    span of bytes at a time. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        aligned = written(_aligned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path_a, path_b, groups), "alignment")
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=path_b).get_piece_size()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, pairs, counts in zip(b.column("batch").to_pylist(), b.column("pairs"), b.column("counts"), strict=True):
                pairs, counts = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i8")
                for k in range(0, len(pairs), PAIR_ROWS):
                    own = pairs[k : k + PAIR_ROWS]
                    yield pa.record_batch([pa.array(np.full(len(own), batch)), pa.array(own), pa.array(counts[k : k + PAIR_ROWS])], names=["batch", "pair", "n"])

    sent = aligned.where("pairs is not null").select("batch", "pairs", "counts").mapInArrow(frugal(listed, "pairs"), "batch long, pair long, n long")
    # pairs of two vocabularies, so this table stops growing; the most frequent of each B id are as many rows as B has ids
    totals = checkpointed(sent.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % n_b))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    graded = totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = sent.select("batch", "pair").join(graded, "pair").select("batch", "pair", "total", "best")
    own = aligned.where("n_a is not null").select("batch", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *["groups"] * groups)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        keeps("links", lambda: None)
        order = np.argsort(pairs := right.column("pair").to_numpy())
        pairs, total, best = pairs[order], right.column("total").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        sums = [link_sums(x, pairs, best, total) for x in left.column("links").chunks if len(x)]
        kept = left.drop_columns(["batch", "links"])
        for name, x in zip(("n_links", "n_best", "count_sum"), zip(*sums, strict=True), strict=True):
            kept = kept.append_column(name, pa.array(np.concatenate(x)))
        give_back()
        return kept.select(names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    id_type = aligned.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    return own.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(counted, shape)


def link_sums(links: pa.Array, pairs: np.ndarray, best: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row's linked pairs: how many there are, how many are best, and the sum of their totals, in 64-bit integers.

    ``pairs`` ascend and hold all that are linked. Links are read where they lie, so many at a time, whatever rows they belong to.
    """
    ends = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1].astype(np.int64) // 8
    flat = np.frombuffer(links.buffers()[2] or b"", "<i8", ends[-1])
    n_best, count_sum = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
    for k in range(int(ends[0]), len(flat), LINKS):
        at = np.searchsorted(pairs, flat[k : k + LINKS])
        cut = np.clip(ends - k, 0, len(at))
        for out, values in ((n_best, best), (count_sum, total)):
            out += np.diff(np.append(0, np.cumsum(values[at], dtype=np.int64))[cut])
    return np.diff(ends), n_best, count_sum

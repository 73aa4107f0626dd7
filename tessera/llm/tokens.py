"""Encoding whole texts with a public tokenizer, each distinct piece of text once.

A text is cut at places where byte-level tokenizers split themselves (before a space after a visible
character, for one), so the ids of a text are the ids of its pieces in a row. Pieces
repeat, so each slice encodes its distinct ones only, and a bounded cache keeps them for later slices. Tokenizers that
aren't known to split there encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.memory import give_back, keeps

#: Bytes of text that are cut at a time; longer single texts are taken whole.
SLICE_BYTES = 4 << 20


def _cut(data: np.ndarray) -> np.ndarray:
    """True where a piece starts.

    That is at a space or line feed after a byte that surely ends a visible character, after such a line feed
    if a letter follows, and at plain punctuation after a letter or digit.
    """
    ascii_word = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0x30) & (data <= 0x39)
    gap = (data == 0x20) | (data == 0x0A)
    visible = (data > 0x20) & (data < 0x7F)
    word = ascii_word.copy()
    if (data >= 0x80).any():
        # the letters from U+00C0 to U+00FF but for the signs at D7 and F7; after other characters nothing is cut
        letter = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        visible[1:] |= letter
        word[1:] |= letter
    mark = (data == 0x2C) | (data == 0x2E) | (data == 0x3B) | (data == 0x3A) | (data == 0x21) | (data == 0x3F)
    start = np.zeros(len(data), dtype=bool)
    start[1:] = gap[1:] & visible[:-1] | mark[1:] & word[:-1]
    start[2:] |= (data[1:-1] == 0x0A) & visible[:-2] & ((data[2:] | 0x20) >= 0x61) & ((data[2:] | 0x20) <= 0x7A)
    return start


#: A word that every tokenizer used here takes as one unit, so that only the merges are left to do.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies spell each byte as a printable character: itself, or the next one free from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


#: Splitters of words (fixed values of the format) after which pieces may be encoded apart.
WORDS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_pieces(config: dict) -> bool:
    """Whether a tokenizer's own splits include all of ``_cut``: byte-level, or words with white space dropped and lower case."""
    pre, normalizer, model = config.get("pre_tokenizer") or {}, config.get("normalizer"), config.get("model") or {}
    if config.get("post_processor") or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return False
    bytes_apart = lambda p, own: p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) is own
    if normalizer is None:
        return bytes_apart(pre, True)
    steps, pres = normalizer.get("normalizers") or [], pre.get("pretokenizers") or []
    if [n.get("type") for n in steps] != ["NFC", "Replace", "Lowercase"] or steps[1].get("pattern") != {"Regex": r"\s+"} or steps[1].get("content") != " ":
        return False
    return len(pres) == 2 and pres[0].get("pattern") == {"Regex": WORDS_APART} and pres[0].get("behavior") == "Removed" and bool(pres[0].get("invert")) and bytes_apart(pres[1], False)


class PieceEncoder:
    """Encodes columns of text; ``cache`` bounds the number of pieces that are kept, of ``longest`` bytes at most."""

    def __init__(self, path: str, cache: int = 500_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.apart = splits_at_pieces(json.load(f))
        #: lower case and no white space: pieces that differ in these alone are one
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.cache, self.longest, self.known = cache, longest, {}

    def _plain(self, piece: bytes) -> bytes:
        if self.folds:
            piece = piece.decode().strip().lower().encode()
        return array("I", [t.id for t in self.merges(piece.decode("latin-1").translate(self.letters))]).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        known, room = self.known, self.cache - len(self.known)  # what comes first is what comes most
        out = [known.get(p) for p in pieces]
        other = []
        for i in [i for i, x in enumerate(out) if x is None]:
            piece = pieces[i]
            if len(piece) <= self.longest and PLAIN.fullmatch(piece):
                out[i] = ids = self._plain(piece)
                if room > 0:
                    known[piece] = ids
                    room -= 1
            else:
                other.append(i)
        for k in range(0, len(other), 1024):
            some = other[k : k + 1024]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = ids = array("I", e.ids).tobytes()
                if room > 0 and len(pieces[i]) <= self.longest:
                    known[pieces[i]] = ids
                    room -= 1
        return out

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.folds:
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, np.where(data == 0x0A, 0x20, data)).astype(np.uint8)
        start = _cut(data)
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        offsets = np.append(at, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        done = np.frombuffer(ids.buffers()[1], np.int64)[: len(at) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint32)[: done[-1]]
        return flat, done[np.searchsorted(at, bounds, "left")]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.uint32), np.cumsum([0, *map(len, coded)])

    def slices(self, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids in a row, offsets into them) of slices of a column, of ``most`` bytes or one text; null counts as empty."""
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        if not len(raw):
            return
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data, first = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
        while first < len(raw):
            last = min(len(raw), max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1))
            lo, hi = offsets[first], offsets[last]
            if self.apart:
                yield first, *self._slice(np.ascontiguousarray(data[lo:hi]), offsets[first : last + 1] - lo)
            else:
                yield first, *self._whole(texts.slice(first, last - first))
            first = last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and len(texts) + 1 offsets into them; null counts as empty."""
        ids, bounds, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for _, flat, at in self.slices(texts):
            ids.append(flat)
            bounds.append(at[1:] + base)
            base += len(flat)
        return np.concatenate(ids), np.concatenate(bounds)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    out = np.empty(len(ids) + len(bounds) - 1, np.uint32)
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = ids
    return out, bounds + np.arange(len(bounds))


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cache: int = 500_000) -> PieceEncoder:
    """The worker process's encoder of this vocabulary, with so many pieces kept; another one goes."""
    keeps(f"tokens {path} {cache}", _ENCODERS.clear)
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = PieceEncoder(path, cache)
        give_back()  # what reading the vocabulary took
    return _ENCODERS[path, cache]

"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count, then its leading tokens. Tokens that vary from record to record
(numbers, ids, addresses) become wild cards at once; what is left is a masked line. In a leaf of the tree, masked
lines that agree at four fifths of their places or more are merged to one template, with wild cards
at the places where they differ. A template that several documents reach is recurring: its lines
stay in the document with the smallest id and are dropped from the others.

Leaves are not compared all against all: of a line's places beyond the leading ones, one part more is made than
places may differ, so two lines that agree well enough have an equal part, and meet by it. Of a part that very many lines
share, most are merged with the first line of a template in buckets; then every line outside the part's largest template meets
all others that have a further part in common with it, so no agreeing pair is lost, whatever the size of the leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.memory import arrow_rows, frugal, small_batches
from tessera.llm.near_dedup import BASE, BASE_INVERSE, MIX_B, _mix
from tessera.llm.storage import checkpointed, unused, written

#: Code points of scripts written without spaces: ideographs and kana, then Thai, Lao, Burmese and Khmer. Each character is a token.
IDEOGRAPHS = ((0x3005, 0x3005), (0x3007, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
UNSPACED = ((0x0E00, 0x0E4F), (0x0E5A, 0x0EFF), (0x1000, 0x103F), (0x1780, 0x17DF))
#: The letters that an ideograph or a kana counts for.
WEIGHT = 3
#: Of so many places of a line one may differ within a template.
DIFFER = 5
#: Bytes of text that are parsed at a time; about a hundred bytes of arrays go with each.
SLICE_BYTES = 512 << 10
#: Masked lines that a task remembers, so that it sends the tokens of their copies once.
MEMORY = 1 << 17
#: Thin rows of an Arrow batch.
KEYS = 16_384
#: Up to so many lines that share a part are compared all with all; beyond, first with the templates found so far, in buckets.
MANY, BUCKET, ROUNDS = 32, 512, 3
#: Lines outside a key's largest template, and lines of the key, that are compared in one block.
REST, BLOCK = 256, 4096


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


#: Powers of the hashes' base and of its inverse, as far as a slice has asked for them, at most for two slices' bytes.
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, SLICE_BYTES)
        found = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (BASE, BASE_INVERSE)]
        if size > 2 * SLICE_BYTES:
            return found[0][: n + 1], found[1][: n + 1]
        _POWERS[:] = found
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def _starts_with(data: np.ndarray, mark: bytes) -> np.ndarray:
    """True where ``mark`` begins."""
    out = np.zeros(len(data), bool)
    if len(data) >= len(mark):
        own = out[: len(data) - len(mark) + 1]
        own[:] = data[: len(own)] == mark[0]
        for k in range(1, len(mark)):
            own &= data[k : k + len(own)] == mark[k]
    return out


class Lines:
    """The lines of a slice of texts (UTF-8 bytes, bounds of the rows) that may recur.

    ``row`` (their text), ``place`` (their number in it), ``leaf`` (64 bits of the masked line), ``tokens`` from ``at[i]`` to ``at[i + 1]``;
    tokens are hashes, 0 for a variable field: a token with an ASCII digit, an address or a link.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: int, letters: int):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        wide, weight = np.zeros(n + 1, bool), ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        weight = weight.astype(np.int64)
        weight[(data >= 0xC3) & (data <= 0xE1)] = 1
        ends = np.zeros(n + 1, bool)
        lead = np.flatnonzero(data >= 0xE0)
        if len(lead):
            tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            point = ((tail[lead] & 0x0F) << 12) | ((tail[lead + 1] & 0x3F) << 6) | (tail[lead + 2] & 0x3F)
            size = np.where(data[lead] >= 0xF0, 4, 3)
            inside = lambda ranges: np.any([(point >= a) & (point <= b) for a, b in ranges], axis=0)
            ideograph = np.where(size == 4, data[lead] == 0xF0, inside(IDEOGRAPHS)) & ((size == 3) | (tail[lead + 1] >= 0xA0))  # U+20000 and above
            weight[lead[ideograph]] = WEIGHT
            own = ideograph | ((size == 3) & inside(UNSPACED))
            weight[lead[(data[lead] >= 0xEA) & (data[lead] <= 0xED)]] = 1  # Hangul and its neighbours
            wide[lead[own]] = True
            ends[np.minimum(lead[own] + size[own], n)] = True
        opens = ~gap & (np.concatenate([[True], gap[:-1]])[:n] | edge[:-1] | wide[:-1] | ends[:-1])
        closes = ~gap & (np.concatenate([gap[1:], [True]])[-n:] | edge[1:] | wide[1:] | ends[1:]) if n else np.zeros(0, bool)
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1

        def holding(where: np.ndarray) -> np.ndarray:
            """Tokens with a byte that is true; every such byte is a token's."""
            out = np.zeros(len(start), bool)
            out[np.searchsorted(start, np.flatnonzero(where), "right") - 1] = True
            return out

        field = holding((data >= 0x30) & (data <= 0x39))
        if (at_sign := data == 0x40).any():
            field |= holding(at_sign) & holding(data == 0x2E)
        for mark in (b"://", b"www."):
            if (where := _starts_with(data, mark)).any():
                field |= holding(where)
        power, inverse = _powers(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
        token = np.where(field, np.uint64(0), _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) | np.uint64(1))
        weights = _running(weight)
        chars = np.where(field, 0, weights[end] - weights[start])
        words = ~field & ~wide[start]
        feeds = _running(data == 0x0A)
        row = np.searchsorted(bounds, start, "right") - 1
        place = feeds[start] - feeds[bounds[row]] if len(start) else start
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])) if len(start) else start
        sizes = np.diff(np.append(first, len(start)))
        if len(first):
            judged = (np.add.reduceat(words.astype(np.int64), first) >= least) | (np.add.reduceat(chars, first) >= letters)
        else:
            judged = np.zeros(0, bool)
        self.row, self.place = row[first][judged], place[first][judged]
        self.tokens = token[np.repeat(judged, sizes)]
        self.at = np.concatenate([[0], np.cumsum(sizes[judged], dtype=np.int64)])
        self.leaf = _sums(_placed(self.tokens, self.at), self.at).view(np.int64)


def sliced_lines(texts: pa.Array, least: int, letters: int) -> Iterator[tuple[int, Lines]]:
    """(first row, lines) of slices of a column; null counts as empty."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(raw):
        return
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data, first = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
    while first < len(raw):
        last = min(len(raw), max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1))
        yield first, Lines(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], least, letters)
        first = last


def _placed(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of tokens with their places in their lines."""
    place = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    return _mix(tokens + (place.astype(np.uint64) + np.uint64(1)) * BASE)


def _sums(placed: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at).astype(np.uint64)
    return _mix(np.add.reduceat(placed, at[:-1]) + n * MIX_B) if len(n) else np.zeros(0, np.uint64)


def part_keys(tokens: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, line of each): a key holds a line's token count, its leading tokens and one part of the other places."""
    n = np.diff(at)
    parts = np.where(n >= DIFFER, n // DIFFER + 1, 0)
    first = np.concatenate([[0], np.cumsum(parts)])
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - at[:-1][line]
    placed = _placed(tokens, at)
    path = n.astype(np.uint64) * MIX_B
    lead = place < depth
    np.add.at(path, line[lead], placed[lead])
    inner = ~lead & (parts[line] > 0)
    to = first[:-1][line[inner]] + (place[inner] - depth) % parts[line[inner]]
    content = np.zeros(first[-1], np.uint64)
    np.add.at(content, to, placed[inner])
    of = np.repeat(np.arange(len(n)), parts)
    number = (np.arange(len(of)) - first[:-1][of]).astype(np.uint64)
    return _mix(content + _mix(path[of] + number * BASE)), of


def _agree(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Where rows of tokens agree at enough places, and enough of these are constant."""
    same = a == b
    n = same.shape[-1]
    return (same.sum(-1) >= n - n // DIFFER) & ((same & (a != 0)).sum(-1) >= least)


def _agreeing(a: pa.Array, b: pa.Array, least: int) -> np.ndarray:
    """Row by row, whether two lines' tokens (binary, 4 bytes each) agree."""
    n, m = (pc.binary_length(x).to_numpy(zero_copy_only=False) // 4 for x in (a, b))
    out = (n == m) & (n > 0)
    at = pa.array(np.flatnonzero(out))
    if len(at):
        x, y = (np.frombuffer(b"".join(c.take(at).to_pylist()), np.uint32) for c in (a, b))
        size, same = n[out], x == y
        begin = np.cumsum(size) - size
        out[out] = (np.add.reduceat(same, begin, dtype=np.int64) >= size - size // DIFFER) & (np.add.reduceat(same & (x != 0), begin, dtype=np.int64) >= least)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, leaf) sorted by key: pairs of lines that share a key; of keys with many lines the lines, with the key and without a partner."""
    key, leaf, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # rows of a key that may go on; a key that has many

    def met(key: np.ndarray, leaf: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        # most keys have one line: only the others are put in order
        alike = key[1:] == key[:-1]
        several = np.flatnonzero(np.concatenate([alike, [False]]) | np.concatenate([[False], alike]) | ((key == large) if large is not None else False)) if len(key) else key
        if not len(several):
            return
        key, leaf = key[several], leaf[several]
        order = np.lexsort((leaf, key))
        key, leaf = key[order], leaf[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (leaf[1:] != leaf[:-1])
        key, leaf = key[fresh], leaf[fresh]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
        some, none = (size <= MANY) & (key != large if large is not None else True), lambda n: pa.nulls(n, pa.int64())
        for d in range(1, MANY):
            i = np.flatnonzero((key[d:] == key[:-d]) & some[d:])
            if not len(i):
                break
            yield pa.record_batch([pa.array(leaf[i]), pa.array(leaf[i + d]), none(len(i))], names=["u", "v", "key"])
        many = np.flatnonzero(~some)
        if len(many):
            yield pa.record_batch([pa.array(leaf[many]), none(len(many)), pa.array(key[many])], names=["u", "v", "key"])

    for b in batches:
        if not b.num_rows:
            continue
        key, leaf = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([leaf, b.column("leaf").to_numpy()])
        cut = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - cut > 4 * MANY or key[-1] == large:  # many as it is: what is here goes on
            yield from met(key[:cut], leaf[:cut], large)
            large = int(key[-1])
            yield from met(key[cut:], leaf[cut:], large)
            cut = len(key)
        else:
            yield from met(key[:cut], leaf[:cut], large)
        key, leaf = key[cut:], leaf[cut:]
    yield from met(key, leaf, large)


def _gather(table: pa.Table, least: int) -> pa.Table:
    """Lines of a key, each with the first one it agrees with, which may be itself."""
    order = np.argsort(table.column("u").to_numpy(), kind="stable")
    raw = table.column("tokens").to_pylist()
    order = order[[len(raw[k]) == len(raw[order[0]]) for k in order]]  # others are here by equal hashes alone
    leaf = table.column("u").to_numpy()[order]
    rows = np.stack([np.frombuffer(raw[k], np.uint32) for k in order])
    head = leaf.copy()
    left = np.arange(len(rows))
    while len(left):
        near = _agree(rows[left], rows[left[0]], least)
        near[0] = True
        head[left[near]] = leaf[left[0]]
        left = left[~near]
    return pa.table({"u": leaf, "v": head, "key": table.column("key").take(pa.array(order))})


def further_keys(tokens: np.ndarray, key: int) -> list[int]:
    """Keys of a line under a key that many share: its places dealt into one part more than may differ, in another way than ``part_keys`` deals them.

    Two lines that agree differ at no place of one of these parts, too.
    """
    n = len(tokens)
    at = np.arange(n + 1)
    bounds = np.arange(n // DIFFER + 2) * n // (n // DIFFER + 1)
    placed = np.append(np.uint64(0), np.cumsum(_placed(tokens.astype(np.uint64), np.array([0, n]))))
    sums = placed[at[bounds[1:]]] - placed[at[bounds[:-1]]]
    return _mix(sums + _mix(np.full(len(sums), key, np.int64).view(np.uint64) + np.arange(len(sums), dtype=np.uint64) * BASE + np.uint64(n) * MIX_B)).view(np.int64).tolist()


def _across(table: pa.Table, least: int) -> pa.Table:
    """Of a block's lines outside the largest template, a link with a line of every other template that holds one they agree with."""
    rest = table.column("rest").to_numpy(zero_copy_only=False)
    raw, leaf, of = table.column("tokens").to_pylist(), table.column("u").to_numpy(), table.column("c").to_numpy()
    links = {}
    for size in {len(x) for x in raw}:  # equal hashes alone can bring other sizes here
        own = np.array([len(x) == size for x in raw])
        rows = np.stack([np.frombuffer(x, np.uint32) for x, o in zip(raw, own, strict=True) if o])
        leaves, templates = leaf[own], of[own]
        for i in np.flatnonzero(rest[own]):
            near = np.flatnonzero((templates != templates[i]) & _agree(rows, rows[i], least))
            for j in near[np.unique(templates[near], return_index=True)[1]]:
                links[templates[i], templates[j]] = (leaves[i], leaves[j])
    return pa.table({"u": pa.array([a for a, _ in links.values()], pa.int64()), "v": pa.array([b for _, b in links.values()], pa.int64())})


def _left_links(shared: DataFrame, close: DataFrame, shown: DataFrame, least: int) -> DataFrame:
    """Links that the buckets of keys with many lines have missed, all of them: ``u, v``.

    ``shared`` (``u, key``) are all lines of such keys, ``close`` the links found so far. A link is missing between two templates only, so each line
    outside its key's largest template meets all lines of the key that have a further part in common with it, block by block.
    """
    merged = connected_components(close)
    of = shared.join(merged, F.col("u") == F.col("node"), "left").select("u", "key", F.coalesce("component", "u").alias("c"))
    of = checkpointed(of)
    sizes = of.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("templates")).where("templates > 1").select(F.col("key").alias("k"), "top")
    told = of.join(largest, F.col("key") == F.col("k")).select("u", "key", "c", (F.col("c") != F.col("top")).alias("rest"))
    whole = told.join(shown, F.col("u") == F.col("leaf")).select("u", "key", "c", "rest", "tokens")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [further_keys(np.frombuffer(t, np.uint32), k) for t, k in zip(b.column("tokens").to_pylist(), b.column("key").to_pylist(), strict=True)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([x for own in found for x in own], pa.int64()), *(b.column(c).take(rows) for c in ("u", "c", "rest", "tokens"))], names=["part", "u", "c", "rest", "tokens"])

    parts = written(whole.mapInArrow(frugal(split, "lines"), "part long, u long, c long, rest boolean, tokens binary"), "line-parts")
    counts = parts.groupBy("part").agg(F.count_if("rest").alias("rests"), F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("rests > 0 and low <> high")
    # a block is some lines of the rest and some lines of the part: both are sent to each block that needs them
    blocks = counts.select(F.col("part").alias("p"), F.ceil(F.col("rests") / REST).alias("across"), F.ceil(F.col("n") / BLOCK).alias("along"))
    dealt = parts.join(blocks, F.col("part") == F.col("p"))
    deal = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    asking = dealt.where("rest").withColumn("x", deal("across")).withColumn("y", F.explode(every("along")))
    asked = dealt.withColumn("y", deal("along")).withColumn("x", F.explode(every("across"))).withColumn("rest", F.lit(False))
    met = asking.unionByName(asked).groupBy("part", "x", "y").applyInArrow(lambda t: _across(t, least), "u long, v long")
    return checkpointed(met)


def merged_leaves(lines: DataFrame, least: int, depth: int) -> DataFrame:
    """``node, component``: masked lines of a template and the smallest of them, where that is another one. ``lines``: ``leaf, tokens``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, first = np.unique(b.column("leaf").to_numpy(), return_index=True)
            raw = b.column("tokens").take(pa.array(first)).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])
            keys, of = part_keys(np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), at, depth)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(leaf[of])], names=["key", "leaf"])

    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_agreeing(a, b, least))

    # by one long alone rows are sorted by radix; rows are thin, so many go to Python at a time
    keys = lines.mapInArrow(frugal(keyed), "key long, leaf long").repartition("key").sortWithinPartitions("key")
    with arrow_rows(lines.sparkSession, KEYS):
        met = written(keys.mapInArrow(frugal(_meet), "u long, v long, key long"), "line-pairs")
    pairs = checkpointed(met.where("v is not null").select("u", "v").distinct())
    shared = many = met.where("v is null").select("u", "key").distinct()
    wanted = pairs.select("u").union(pairs.select("v")).union(many.select("u")).distinct()
    # of the copies of a masked line one goes on
    shown = written(lines.join(wanted, F.col("leaf") == F.col("u"), "left_semi").dropDuplicates(["leaf"]), "line-tokens")
    right = shown.select(F.col("leaf").alias("r"), F.col("tokens").alias("other"))
    close = pairs.join(shown, F.col("u") == F.col("leaf")).drop("leaf").join(right, F.col("v") == F.col("r")).where(agree("tokens", "other")).select("u", "v")
    # of a key that very many lines share, buckets are gathered round by round; what a bucket doesn't join is dealt anew
    for k in range(ROUNDS if many.take(1) else 0):
        sizes = many.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "k")
        dealt = many.join(sizes, F.col("key") == F.col("k")).select("u", "key", F.pmod(F.xxhash64(F.lit(k), "u"), F.ceil(F.col("n") / BUCKET)).alias("bucket"))
        full = dealt.join(shown, F.col("u") == F.col("leaf")).drop("leaf")
        near = checkpointed(full.groupBy("key", "bucket").applyInArrow(lambda t: _gather(t, least), "u long, v long, key long"))
        close = close.union(near.where("u <> v").select("u", "v"))
        many = near.where("u = v").select("u", "key")
        close = checkpointed(close)
    if shared.take(1):
        close = close.union(_left_links(shared, close, shown, least))
    return connected_components(close)


def recurring_lines(rows: DataFrame, least: int, letters: int, min_docs: int, depth: int = 2) -> DataFrame:
    """``doc_id, h, drops``: for each document (id, hash of its text), the numbers of the lines whose templates it shares with an earlier one."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for first, x in sliced_lines(b.column("text"), least, letters):
                if len(seen) > MEMORY:
                    seen.clear()
                fresh = np.array([not (leaf in seen or seen.add(leaf)) for leaf in x.leaf.tolist()], bool)
                size = np.where(fresh, np.diff(x.at), 0)
                sent = np.ascontiguousarray(x.tokens[np.repeat(fresh, np.diff(x.at))].astype(np.uint32))
                tokens = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.concatenate([[0], np.cumsum(size)]) * 4).astype(np.int32)), pa.py_buffer(sent)])
                own = pa.array(first + x.row)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("h").take(own), pa.array(x.place.astype(np.int32)), pa.array(x.leaf), tokens], names=["doc_id", "h", "place", "leaf", "tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    reached = written(rows.where(F.col("doc_id").isNotNull()).mapInArrow(frugal(leaves, "lines"), f"doc_id {id_type}, h long, place int, leaf long, tokens binary"), "lines")
    merged = merged_leaves(reached.where(F.octet_length("tokens") > 0).select("leaf", "tokens"), least, depth)
    reached = reached.select("doc_id", "h", "place", "leaf").join(merged, F.col("leaf") == F.col("node"), "left").select("doc_id", "h", "place", F.coalesce("component", "leaf").alias("template"))
    reached = checkpointed(reached)
    # a table of its own, so that a template that many documents reach can be split in the join
    recurring = checkpointed(reached.select("doc_id", "template").distinct().groupBy("template").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(F.col("template").alias("t"), "first"))
    return reached.join(recurring, F.col("template") == F.col("t")).where(F.col("doc_id") != F.col("first")).groupBy("doc_id", "h").agg(F.collect_set("place").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, min_docs: int = 2, letters: int = 16) -> DataFrame:
    """All rows of ``docs`` with ``text_col`` rid of recurring lines, and ``n_lines``, ``n_dropped`` added (in place of columns of these names).

    Lines end at line feeds. Lines with fewer than ``least`` constant tokens between spaces and fewer than ``letters``
    constant letters (an ideograph or a kana counts for three) are never dropped, however common; templates have ``least``
    constant tokens. Null and empty texts stay as they are, with 0 lines; rows with a null id stay whole. Within a document lines
    may repeat; very long texts are read whole. Repeated rows of an id are one document. Of a template's documents the one with the
    smallest id keeps its lines. An empty table gives no rows; other columns stay as they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    own, hashed, gone = (unused(docs, x) for x in ("own", "hashed", "gone"))
    drops = recurring_lines(rows, least, letters, min_docs).select(F.col("doc_id").alias(own), F.col("h").alias(hashed), F.col("drops").alias(gone))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            if text is None or not places:
                out.append(text)
            else:
                lost = set(places)
                out.append("\n".join([line for p, line in enumerate(text.split("\n")) if p not in lost]))
        return pa.array(out, pa.string())

    text, places = F.col(text_col), F.col(gone)
    n_lines = F.when(F.length(text) > 0, F.regexp_count(text, F.lit("\n")) + 1).otherwise(0).cast("long").alias("n_lines")
    n_dropped = F.coalesce(F.size(F.when(places.isNotNull(), places).otherwise(F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_dropped")
    # texts that lose nothing don't leave the JVM
    left = F.when(places.isNotNull(), cut(F.when(places.isNotNull(), text), places)).otherwise(text).alias(text_col)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    done = docs.join(drops, (F.col(id_col) == F.col(own)) & (F.xxhash64(text_col) == F.col(hashed)), "left")
    return done.select(*[left if c == text_col else F.col(c) for c in others], n_lines, n_dropped)

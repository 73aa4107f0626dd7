"""N-gram Jaccard join with signature trees.

1. Each text becomes its set of shingles (64-bit hashes); equal sets are one from here on.
2. Sets are dealt out without loss: two sets of size at most m with Jaccard t or more differ in at most
   D = (1-t)/(1+t) * 2m shingles, so of more than D segments of the hash space at least one is equal in both. Sets
   that share a segment's content meet in a star around one of them.
3. The sets of a large star are compared with its centre first, each once: in its first star, then in others whose centre it isn't
   yet connected with. Of two sets connected with the centre nothing more need be known; only the others go on to meet all of the star's sets.
4. Blocks of sets meet in pairs, each pair in one task. A block is a signature tree: nodes on every level hold
   OR-combined bitmaps and size ranges; two trees are descended together from their roots and node pairs are pruned by
   their largest possible overlap. Bitmaps alone meet first; sets that may link then meet whole and are compared exactly.
5. The links' components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.memory import frugal, small_batches
from tessera.llm.storage import checkpointed, unused, written

#: Bytes of text that are cut into shingles at a time; about a hundred bytes of arrays go with each.
SLICE_BYTES = 512 << 10
#: Fixed odd multipliers of the hashes.
BASE, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Sizes from one power of this to the next share their segments.
STEP = 1.25
#: Deals of a set's shingles to segments before empty segments become keys.
DEALS = 8
#: Block numbers within a size class stay below half of this; those of sets that link with their centre begin there.
BLOCKS = 1 << 32
#: Bytes of sets that a block aims at, and its least and most sets; sets that a task remembers so that copies send their keys once.
BLOCK_BYTES, BLOCK_LEAST, MEMORY = 4 << 20, 32, 1 << 18
#: Up to so many ids of documents whose sets are wanted are broadcast, so that other texts stay where they are.
WANTED = 1_000_000
#: Least and most bits of a set's bitmap; sets beyond are pruned less, never dropped.
BITS = (64, 1 << 14)
#: The block of a star that isn't cut.
WHOLE = -1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a column as (first row, sorted distinct shingles row by row, bounds of the rows).

    Words are runs of anything but ASCII white space, A-Z in lower case; fewer than ``words`` words are one shingle.
    """
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    all_offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    buffer = np.frombuffer(raw.buffers()[2] or b"", np.uint8) if len(raw) else np.zeros(0, np.uint8)
    first = 0
    while first < len(raw):
        last = min(len(raw), max(first + 1, int(np.searchsorted(all_offsets, all_offsets[first] + SLICE_BYTES, "right")) - 1))
        data = buffer[all_offsets[first] : all_offsets[last]]
        bounds = all_offsets[first : last + 1] - all_offsets[first]
        data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        opens, closes = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[bounds] = True
            opens = ~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1])
            closes = ~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        power = np.cumprod(np.full(len(data) + 1, BASE, np.uint64))
        inverse = np.cumprod(np.full(len(data) + 1, BASE_INVERSE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        word = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        at = np.searchsorted(start, bounds, "left")
        n = np.diff(at)
        windows = np.maximum(n - words + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(len(n)), windows)
        where = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        have = np.minimum(n, words)[row]
        shingle = have.astype(np.uint64) * MIX_B
        for k in range(words):
            inside = k < have
            shingle[inside] = _mix(shingle[inside] * BASE + word[where[inside] + k])
        order = np.lexsort((shingle, row))
        row, shingle = row[order], shingle[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
        row, shingle = row[fresh], shingle[fresh]
        yield first, shingle, np.searchsorted(row, np.arange(len(n) + 1), "left")
        first = last


def _schemes(size: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(class, segments, empty segments that go without a key) for the pairs a set of ``size`` can be in."""
    t = percent / 100
    low, high = math.floor(math.log(size) / math.log(STEP)), math.floor(math.log(size / t + 1e-9) / math.log(STEP))
    for c in range(low, high + 1):
        top = math.ceil(STEP ** (c + 1))  # sizes of the larger set are below
        differ = math.floor((1 - t) / (1 + t) * 2 * top + 1e-9)
        empty = (differ + 1) * math.exp(-t * STEP**c / (differ + 1))
        # small sets seldom have an empty segment and would be cut too fine by spare ones
        spare = math.ceil(empty + 3 * math.sqrt(empty)) if differ >= 8 else 0
        yield c, differ + 1 + spare, spare


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set; two sets within the similarity share one at least.

    Of a pair's segments 1 + spare or more are equal. Where one of the two has no more than ``spare`` empty segments, one
    of the equal ones has shingles. Where both have more, both deal their shingles out anew, so that
    empty segments, which unlike sets share, are keys in the last deal only.
    """
    keys = []
    for c, segments, spare in _schemes(len(shingles), percent):
        for deal in range(DEALS):
            seed = np.uint64(c + (deal << 16))
            of = ((_mix(shingles + seed) >> np.uint64(11)) % np.uint64(segments)).astype(np.int64)
            content = np.zeros(segments, np.uint64)
            np.add.at(content, of, _mix(shingles ^ MIX_A))
            used = np.bincount(of, minlength=segments) > 0
            enough = segments - used.sum() <= spare
            chosen = np.flatnonzero(used) if enough or deal < DEALS - 1 else np.arange(segments)
            keys.append(_mix(content[chosen] + _mix(chosen.astype(np.uint64) + (seed << np.uint64(32)))))
            if enough:
                break
    return np.concatenate(keys)


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits of a set's shingles: two to four times as many bits as shingles, within fixed bounds."""
    bits = np.zeros(min(max(1 << int(2 * len(shingles) - 1).bit_length(), BITS[0]), BITS[1]), bool)
    bits[(shingles % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of at least ``bits`` bits, folded to ``bits``, as rows of 64-bit words."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, bits // 64)) for m in bitmaps])


class SignatureTree:
    """A block's sets, by size, under levels of nodes with ``fan`` children each, up to one root; ``bitmaps`` are of equal or more ``bits``.

    A level holds, row by row, the OR of what is below, the least and largest size, and the most shingles of a set that share a bit with another.
    """

    def __init__(self, size: np.ndarray, bitmaps: list[bytes], bits: int, fan: int = 8):
        self.fan = fan
        size, leaf = np.asarray(size, np.int64), _folded(bitmaps, bits)
        self.levels = [(leaf, size, size, size - np.bitwise_count(leaf).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            own, low, high, excess = self.levels[-1]
            heads = np.arange(0, len(own), fan)
            self.levels.append((np.bitwise_or.reduceat(own, heads, axis=0), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(excess, heads)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``nodes``, child) of nodes of a level."""
        child = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
        parent = np.repeat(np.arange(len(nodes)), self.fan)
        there = child < len(self.levels[level - 1][0])
        return parent[there], child[there]


def _may_link(a: tuple, b: tuple, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of rows of two levels, whether sizes and the largest possible overlap allow a link below."""
    (bits_a, low_a, high_a, exc_a), (bits_b, low_b, high_b, exc_b) = a, b
    larger, smaller = np.maximum(low_a[u], low_b[v]), np.minimum(high_a[u], high_b[v])
    out = 100 * smaller >= percent * larger
    at = np.flatnonzero(out)
    step = max(1, (1 << 18) // bits_a.shape[1])
    for k in range(0, len(at), step):
        some = at[k : k + step]
        x, y = u[some], v[some]
        overlap = np.bitwise_count(bits_a[x] & bits_b[y]).sum(1, dtype=np.int64) + np.minimum(exc_a[x], exc_b[y])
        out[some] = 100 * np.minimum(overlap, smaller[some]) >= percent * larger[some]
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def tree_pairs(a: SignatureTree, b: SignatureTree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two trees' sets that may link, found from the roots down; ``same``: a tree that meets itself, each pair once."""
    i, j = len(a.levels) - 1, len(b.levels) - 1
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        kept = _may_link(a.levels[i], b.levels[j], u, v, percent)
        u, v = u[kept], v[kept]
        if not len(u) or i == j == 0:
            return (u[u < v], v[u < v]) if same else (u, v)
        down_a, down_b = i >= j, j >= i  # the higher tree first, then both together
        if down_a:
            parent, u = a.children(i, u)
            v, i = v[parent], i - 1
        if down_b:
            parent, v = b.children(j, v)
            u, j = u[parent], j - 1
        if same:
            u, v = u[u <= v], v[u <= v]


class Side:
    """One side of a block pair: its sets by the width of their bitmaps, which is from two to below four times their size."""

    def __init__(self, ids: list[int], size: list[int], bitmaps: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.size, self.bitmaps = np.array(size, np.int64), bitmaps
        self.width = np.array([8 * len(m) for m in bitmaps], np.int64)
        self.trees: dict[tuple[int, int], tuple[np.ndarray, SignatureTree]] = {}

    def tree(self, width: int, bits: int) -> tuple[np.ndarray, SignatureTree]:
        if (width, bits) not in self.trees:
            at = np.flatnonzero(self.width == width)
            at = at[np.lexsort((self.ids[at], self.size[at]))]
            self.trees[width, bits] = at, SignatureTree(self.size[at], [self.bitmaps[k] for k in at], bits)
        return self.trees[width, bits]


def side_pairs(a: Side, b: Side, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two sides' sets that may link; ``a is b`` for a block that meets itself."""
    for w in np.unique(a.width).tolist():
        for x in np.unique(b.width).tolist():
            if percent * max(w, x) >= 200 * min(w, x) or (a is b and w > x):
                continue
            (at, left), (to, right) = a.tree(w, min(w, x)), b.tree(x, min(w, x))
            u, v = tree_pairs(left, right, a is b and w == x, percent)
            yield at[u], to[v]


def _linked_pairs(a: Side, b: Side, sets_a: list[np.ndarray], sets_b: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links between two sides, enough of them to hold all components together."""
    left, right = [], []
    offset = 0 if a is b else len(sets_a)
    group = list(range(len(sets_a) + (0 if a is b else len(sets_b))))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for us, vs in side_pairs(a, b, percent):
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            r, s = root(u), root(offset + v)
            if r != s and _linked(sets_a[u], sets_b[v], percent):
                group[max(r, s)] = min(r, s)
                left.append(int(a.ids[u]))
                right.append(int(b.ids[v]))
    return left, right


def _block_pairs(batches: Iterator[pa.RecordBatch], last: tuple[str, ...]) -> Iterator[tuple[int, list[list[tuple]]]]:
    """(cluster, sides' rows of doc_id and ``last``) of the block pairs of a partition, which come one after another."""

    def sides(own: tuple[int, int, int], rows: list[tuple]) -> list[list[tuple]]:
        return [[r[1:] for r in rows if r[0] == block] for block in dict.fromkeys(own[1:])]

    current, rows = None, []
    for batch in batches:
        names = ("cluster", "a", "b", "block", "doc_id", *last)
        for cluster, a, b, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (cluster, a, b) != current:
                if rows:
                    yield current[0], sides(current, rows)
                current, rows = (cluster, a, b), []
            rows.append(tuple(row))
    if rows:
        yield current[0], sides(current, rows)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The sets of each cluster that may link with another by their bitmaps and sizes."""
    for cluster, rows in _block_pairs(batches, ("n_shingles", "bits")):
        if not all(rows):
            continue
        sides = [Side(*(list(c) for c in zip(*r, strict=True))) for r in rows]
        may = [np.zeros(len(side.ids), bool) for side in sides]
        for u, v in side_pairs(sides[0], sides[-1], percent):
            may[0][u] = True
            may[-1][v] = True
        ids = np.concatenate([side.ids[m] for side, m in zip(sides, may, strict=True)])
        if len(ids):
            yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), cluster))], names=["doc_id", "cluster"])


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the block pairs of a partition."""
    for _, rows in _block_pairs(batches, ("shingles",)):
        if not all(rows):
            continue
        sets = [[np.frombuffer(s, np.uint64) for _, s in r] for r in rows]
        sides = [Side([i for i, _ in r], [len(s) for s in own], [bitmap(s) for s in own]) for r, own in zip(rows, sets, strict=True)]
        u, v = _linked_pairs(sides[0], sides[-1], sets[0], sets[-1], percent)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _centre_links(batches: Iterator[pa.RecordBatch], percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Sets of each piece of a star that link with its centre, by bitmaps (may link) or whole; a piece's rows come one after another, the centre first."""
    current, centre = None, None
    for batch in batches:
        found = []
        rows = zip(*(batch.column(n).to_pylist() for n in ("cluster", "piece", "spoke", "doc_id", "n_shingles", "own")), strict=True)
        for cluster, piece, spoke, doc, n, own in rows:
            if not spoke:
                current, centre = (cluster, piece), (doc, n, np.frombuffer(own, np.uint64))
            elif (cluster, piece) == current:
                mine = np.frombuffer(own, np.uint64)
                if whole:
                    hit = _linked(mine, centre[2], percent)
                else:
                    bits = min(len(mine), len(centre[2]))
                    x, y = (np.bitwise_or.reduce(w.reshape(-1, bits)) for w in (mine, centre[2]))
                    spare = min(n - int(np.bitwise_count(x).sum()), centre[1] - int(np.bitwise_count(y).sum()))
                    hit = 100 * min(int(np.bitwise_count(x & y).sum()) + spare, n, centre[1]) >= percent * max(n, centre[1])
                if hit:
                    found.append((cluster, piece, doc, centre[0]))
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["cluster", "piece", "doc_id", "centre"])


def _with_sets(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``members`` (doc_id and what goes with it) with the documents' sets as ``own`` and their sizes; texts of members alone are cut again."""
    names = [c for c in members.columns if c != "doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, shingles, at in shingle_sets(b.column("text"), words):
                n = len(at) - 1
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(shingles))])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, n) for c in ("doc_id", *names)), pa.array(np.diff(at)), raw], names=["doc_id", *names, "n_shingles", "own"])

    kinds = ", ".join(f"`{c}` {members.schema[c].dataType.simpleString()}" for c in names)
    ids = members.select("doc_id").distinct()
    if ids.limit(WANTED + 1).count() <= WANTED:
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    return rows.join(members, "doc_id").select("doc_id", *names, "text").mapInArrow(frugal(cut, "shingles"), f"doc_id long, {kinds}, n_shingles long, own binary")


def _star_links(rows: DataFrame, clusters: DataFrame, bitmaps: DataFrame, words: int, percent: int, star: int, block: int) -> tuple[DataFrame, DataFrame]:
    """For stars of more than ``star`` sets: members (``cluster, doc_id``) that are connected with their centre, and the links (``u, v``) found.

    A star is dealt to pieces of ``block`` sets, each with the centre. Sets meet it by bitmaps, and whole where these allow a link.
    """
    large = checkpointed(clusters.where(F.col("members") > star))
    pieces = F.ceil(F.col("members") / block).cast("long")
    hubs = large.where("centre").select("doc_id", "cluster", pieces.alias("pieces"))
    own = hubs.select("cluster", F.col("doc_id").alias("hub"))
    spokes = large.where("not centre").join(own, "cluster").select("doc_id", "cluster", "hub", F.pmod(F.xxhash64("doc_id"), pieces).alias("piece"))

    def by_piece(of: DataFrame) -> DataFrame:
        return of.repartition("cluster", "piece").sortWithinPartitions("cluster", "piece", "spoke")

    def with_hubs(some: DataFrame) -> DataFrame:
        centres = some.select("cluster", "piece", "hub").distinct().select(F.col("hub").alias("doc_id"), "cluster", "piece", F.lit(False).alias("spoke"))
        return some.select("doc_id", "cluster", "piece", F.lit(True).alias("spoke")).union(centres)

    def linked(some: DataFrame) -> DataFrame:
        found = "cluster long, piece long, doc_id long, centre long"
        near = checkpointed(by_piece(with_hubs(some).join(bitmaps, "doc_id")).mapInArrow(frugal(lambda batches: _centre_links(batches, percent, False)), found))
        asked = checkpointed(with_hubs(some.join(near.select("cluster", "doc_id"), ["cluster", "doc_id"], "left_semi").select(*some.columns)))
        return checkpointed(by_piece(_with_sets(rows, asked, words)).mapInArrow(frugal(lambda batches: _centre_links(batches, percent, True)), found).distinct())

    if not large.take(1):
        none = large.select("cluster", "doc_id")
        return none, none.toDF("u", "v")
    first = linked(checkpointed(spokes.join(spokes.groupBy("doc_id").agg(F.min("cluster").alias("cluster")), ["doc_id", "cluster"], "left_semi").select(*spokes.columns)))
    known = connected_components(first.select(F.col("doc_id").alias("u"), F.col("centre").alias("v")))
    placed = spokes.join(known, F.col("doc_id") == F.col("node"), "left").withColumn("a", F.coalesce("component", "doc_id")).drop("node", "component")
    placed = checkpointed(placed.join(known, F.col("hub") == F.col("node"), "left").withColumn("b", F.coalesce("component", "hub")).drop("node", "component"))
    connected = placed.where("a = b").select("cluster", "doc_id")
    tried = spokes.groupBy("doc_id").agg(F.min("cluster").alias("cluster"))
    rest = linked(checkpointed(placed.where("a <> b").join(tried, ["doc_id", "cluster"], "left_anti").select(*spokes.columns)))
    held = connected.union(rest.select("cluster", "doc_id")).union(hubs.select("cluster", "doc_id")).distinct()
    links = first.union(rest).select(F.col("doc_id").alias("u"), F.col("centre").alias("v"))
    return held, links


def jaccard_groups(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", star: int = 64, block: int = 256) -> DataFrame:
    """One row per document: ``doc_id`` (long), ``n_shingles``, ``component_id`` (smallest id reachable by links, itself included).

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is ``percent`` / 100 or more,
    exactly. Texts without words (null, empty, blank) have an empty set and link with nothing. A null id is
    linked with nothing. Repeated rows of an id are one document in its component; very long texts are read whole. Equal texts
    have equal sets, whose links count once. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, shingles, at in shingle_sets(b.column("text"), words):
                n, s, x = _sums_of(shingles, at)
                yield pa.record_batch([b.column("doc_id").slice(first, len(n)), pa.array(n), pa.array(s), pa.array(x), pa.array([bitmap(shingles[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "n_shingles", "s", "x", "bits"])

    sets = written(rows.mapInArrow(frugal(summed, "shingles"), "doc_id long, n_shingles long, s long, x long, bits binary"), "sets")
    equal = ["n_shingles", "s", "x"]
    whole = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    firsts = checkpointed(whole.groupBy(*equal).agg(F.min("doc_id").alias("first")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            there = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for first, shingles, at in shingle_sets(b.column("text"), words):
                keys, of = [], []
                n, s, _ = _sums_of(shingles, at)
                for i in np.flatnonzero((n > 0) & there[first : first + len(n)]).tolist():
                    own = int(s[i])
                    if own in seen:  # a copy
                        continue
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen.add(own)
                    k = segment_keys(shingles[at[i] : at[i + 1]], percent)
                    keys.append(k)
                    of.append(np.full(len(k), own))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of))], names=["key", "s"])

    # rows of a key meet once: a key with one set falls away, others gather their sets around one of them; two sets
    # that share a key meet in its star, and sets that only a chain of keys connects don't. Of copies few rows come, one from each task.
    keys = rows.mapInArrow(frugal(keyed, "shingles"), "key long, s long")
    low = F.min("s").over(Window.partitionBy("key"))
    rays = checkpointed(keys.withColumn("cluster", low).where("s <> cluster").select("s", "cluster").distinct())
    clusters = rays.union(rays.select(F.col("cluster").alias("s"), "cluster").distinct())
    # sets go by their first document; linked sizes are in the same class or in neighbouring ones
    width = math.log(100 / percent) * 1.0001
    known = firsts.select(F.col("first").alias("doc_id"), "s", F.floor(F.log(F.col("n_shingles").cast("double")) / width).alias("size_class"))
    clusters = checkpointed(clusters.join(known, "s").select("doc_id", "cluster", "size_class", (F.col("s") == F.col("cluster")).alias("centre")))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    clusters = checkpointed(clusters.join(sizes, "cluster").where("members > 1"))
    bitmaps = sets.select("doc_id", "n_shingles", F.col("bits").alias("own")).where("n_shingles > 0")

    held, links = _star_links(rows, clusters, bitmaps, words, percent, star, block)
    clusters = checkpointed(clusters.join(held.withColumn("held", F.lit(True)), ["cluster", "doc_id"], "left").withColumn("held", F.coalesce("held", F.lit(False))))

    # blocks of each size class; the held ones of a star meet only the others
    most = lambda k: F.greatest(F.lit(min(block, BLOCK_LEAST)), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES / 8) / F.exp((F.col("size_class") + k) * F.lit(width))))).cast("long")
    counts = checkpointed(clusters.groupBy("cluster", "size_class", "held").agg(F.count(F.lit(1)).alias("n")))
    placed, parts = clusters, []
    for k in (0, 1, -1):
        for held in (False, True):
            name = f"n{k}{held}".replace("-", "m")
            near = counts.where(F.col("held") == held).select("cluster", (F.col("size_class") - k).alias("size_class"), F.col("n").alias(name))
            placed = placed.join(near, ["cluster", "size_class"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
            blocks = F.ceil(F.col(name) / most(k)).cast("long")
            base = (F.col("size_class") + k) * BLOCKS + (BLOCKS // 2 if held else 0)
            listed = F.sequence(base, base + blocks - 1)
            wanted = (blocks > 0) & (~F.col("held") if held else F.lit(True))
            parts.append(F.when(wanted, listed).otherwise(F.array().cast("array<bigint>")))
    own = F.when(F.col("held"), F.ceil(F.col("n0True") / most(0))).otherwise(F.ceil(F.col("n0False") / most(0))).cast("long")
    # a small star is one block that meets itself, so that each of its sets is sent once
    small = F.col("members") <= min(block, 128)
    company = F.col("n0False") + F.col("n1False") + F.col("nm1False") + F.when(F.col("held"), 1).otherwise(F.col("n0True") + F.col("n1True") + F.col("nm1True"))
    dealt = checkpointed(
        placed.where(company > 1)
        .withColumn("block", F.when(small, F.lit(WHOLE).cast("long")).otherwise(F.col("size_class") * BLOCKS + F.pmod(F.xxhash64("doc_id"), own) + F.when(F.col("held"), BLOCKS // 2).otherwise(0)))
        .select("doc_id", "cluster", "block", F.when(small, F.array("block")).otherwise(F.concat(*parts)).alias("others"))
        .where(F.size("others") > 0)
    )

    def meeting(of: DataFrame, *last: str) -> DataFrame:
        pairs = of.withColumn("other", F.explode("others")).select("cluster", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "doc_id", "block", *last)
        return pairs.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")

    # bitmaps meet first, a hundredth of the sets' bytes; only sets that may link are sent whole
    thin = meeting(bitmaps.withColumnRenamed("own", "bits").join(dealt, "doc_id"), "n_shingles", "bits")
    may = checkpointed(thin.mapInArrow(frugal(lambda batches: _candidates(batches, percent)), "doc_id long, cluster long").distinct())
    dealt = checkpointed(dealt.join(may, ["doc_id", "cluster"], "left_semi"))
    whole_sets = _with_sets(rows, dealt, words).withColumnRenamed("own", "shingles")
    inner = meeting(whole_sets, "shingles").mapInArrow(frugal(lambda batches: _block_links(batches, percent)), "u long, v long")
    found = connected_components(inner.union(links))
    first_of = checkpointed(firsts.join(found, F.col("first") == F.col("node"), "left").select(*[F.col(c).alias(f"_{c}") for c in equal], F.coalesce("component", "first").alias("component")))
    same = (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("s") == F.col("_s")) & (F.col("x") == F.col("_x"))
    return sets.join(first_of, same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _sums_of(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each set; equal sets have them equal."""
    n, full = np.diff(at), np.diff(at) > 0
    low = np.zeros((2, len(n)), np.uint64)
    if full.any():
        low[0, full] = np.add.reduceat(_mix(shingles ^ MIX_B), at[:-1][full])
        low[1, full] = np.bitwise_xor.reduceat(_mix(shingles + MIX_A), at[:-1][full])
    return n, low[0].view(np.int64), low[1].view(np.int64)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, of the document with the smallest id in each group.

    Rows with a null id link with nothing and all stay, as do null, empty and blank texts. Repeated rows of an id that stays all stay.
    An empty table gives no rows.
    """
    own = unused(docs, "own")
    stay = jaccard_groups(docs, words, percent, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stay, F.col(id_col).cast("long") == F.col(own), "left_semi").union(docs.where(F.col(id_col).isNull()))

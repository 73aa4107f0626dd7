"""Repair of conversations: the cheapest edits that make a conversation an optional system row and then user and assistant in turn.

A conversation is one of four things so far: empty, begun by system, last spoken by user, last spoken by assistant. Rows and edits lead from
one to another, so costs over a stretch of rows are vectors of four. The edits are found by divide and conquer in linear space (Hirschberg):
forward vectors of the first half and backward vectors of the second meet in the middle, and of the cheapest crossings the one with the least
edit string is taken. Rows are dealt out by ranges of conversation and turn and cut into stretches of bounded length, so a conversation
that holds a third of all rows is many tasks' work: each stretch is solved for all its entries and exits, a thin pass joins the stretches, and
only the digest of the repaired texts, which is a sequence by its nature, streams a conversation's rows through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import arrow_rows, frugal
from tessera.llm.storage import written

#: What a conversation is so far; the last three are also the classes of rows by their role's initial, 0 being any other.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Why a row is at fault, 0 if it isn't.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, FAULTY = 2, 3, 2, 1
NEVER = 1 << 30
#: The role that a new row has after each state, and what is still missing at a conversation's end.
SPOKEN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FOLLOWS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Rows of a stretch, as a power of two.
STRETCH_BITS = 12


def _moves(role: int, fault: int) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row, the cheapest cost and least edits that lead to each state after it; a row comes after its insertions."""
    out = []
    for state in range(4):
        ways = [(state, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            extra = FAULTY if fault == TRUNCATED else 0
            for begun, cost, edits in ((state, 0, ""), (SPOKEN[state], INSERT, "I")):
                ways.append((SPOKEN[begun], cost + REROLE + extra, edits + "R"))
                if role == SPOKEN[begun] or (role, begun) == (SYSTEM, EMPTY):
                    ways.append((role, cost + extra, edits + "K"))
        best: dict[int, tuple[int, str]] = {}
        for to, *way in ways:
            best[to] = min(best.get(to, (NEVER, "")), tuple(way))
        out.append(best)
    return out


MOVES = [_moves(code & 3, code >> 2) for code in range(16)]
STEPS = [[(p, q, cost) for p, ways in enumerate(moves) for q, (cost, _) in ways.items()] for moves in MOVES]


def forward(codes: bytes, lo: int, hi: int, state: int) -> list[int]:
    """The least cost of reaching each state over rows ``lo`` to ``hi`` from ``state``."""
    here = [NEVER] * 4
    here[state] = 0
    for code in codes[lo:hi]:
        there = [NEVER] * 4
        for p, q, cost in STEPS[code]:
            if here[p] + cost < there[q]:
                there[q] = here[p] + cost
        here = there
    return here


def backward(codes: bytes, lo: int, hi: int, state: int) -> list[int]:
    """The least cost of reaching ``state`` over rows ``lo`` to ``hi`` from each state."""
    there = [NEVER] * 4
    there[state] = 0
    for code in reversed(codes[lo:hi]):
        here = [NEVER] * 4
        for p, q, cost in STEPS[code]:
            if cost + there[q] < here[p]:
                here[p] = cost + there[q]
        there = here
    return there


def edits(codes: bytes, lo: int, hi: int, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """The least of the cheapest edit strings over rows ``lo`` to ``hi`` for each (state before, state after) that can be.

    Every string ends with its last row's own edit, so none of one stretch is the beginning of another, and least parts make the least whole.
    """
    if hi - lo == 1:
        return {(p, q): MOVES[codes[lo]][p][q][1] for p, q in pairs}
    mid = (lo + hi) // 2
    ahead = {p: forward(codes, lo, mid, p) for p in {p for p, _ in pairs}}
    behind = {q: backward(codes, mid, hi, q) for q in {q for _, q in pairs}}
    meet = {}
    for p, q in pairs:
        costs = [a + b for a, b in zip(ahead[p], behind[q], strict=True)]
        meet[p, q] = [x for x in range(4) if costs[x] == min(costs)]
    left = edits(codes, lo, mid, {(p, x) for (p, _), at in meet.items() for x in at})
    right = edits(codes, mid, hi, {(x, q) for (_, q), at in meet.items() for x in at})
    return {(p, q): min(left[p, x] + right[x, q] for x in at) for (p, q), at in meet.items()}


def solved(codes: bytes, states: range) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks among the edits of one state before, and edits of a stretch: 16 each, by (state before) * 4 + (state after)."""
    costs = [c for p in range(4) for c in (forward(codes, 0, len(codes), p) if p in states else [NEVER] * 4)]
    found = edits(codes, 0, len(codes), {(k >> 2, k & 3) for k in range(16) if costs[k] < NEVER})
    strings = [found.get((k >> 2, k & 3), "") for k in range(16)]
    ranks = [sum(strings[k & 12 | q] < strings[k] for q in range(4) if costs[k & 12 | q] < NEVER) for k in range(16)]
    return costs, ranks, strings


def joined(stretches: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each stretch of a conversation, from their costs and ranks."""
    onward = [INSERT * len(ENDING[q]) for q in range(4)]
    ways = []
    for costs, ranks in reversed(stretches):
        best = [min((costs[p * 4 + q] + onward[q], ranks[p * 4 + q], q) for q in range(4)) for p in range(4)]
        ways.append([q for *_, q in best])
        onward = [min(cost, NEVER) for cost, *_ in best]
    out, state = [], EMPTY
    for way in reversed(ways):
        out.append((state, way[state]))
        state = way[state]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the hash of conversation and turn; null roles and texts are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    return (
        rows.select("conv_id", "turn", plain("role").alias("own"), plain("text").alias("said"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("own")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth"))
        .drop("nth")
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, each with its place ``at`` in that order and what can be told from the row alone."""
    begun = F.substring("text", 1, 32)
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    fault = F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", begun).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("*", F.monotonically_increasing_id().alias("at"), role.cast("int").alias("class"), fault.cast("int").alias("fault"))


def _coded(placed: DataFrame) -> DataFrame:
    """``at, conv_id, code``: class and first fault. Of rows with equal role and text in a conversation all but the first are duplicates."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(" "))
    same = F.unhex(F.md5(F.concat_ws("\n", F.length(conv), conv, F.length("role"), F.col("role"), F.col("text")).cast("binary")))
    thin = placed.select("at", "conv_id", "class", "fault", same.alias("same"))
    repeated = thin.where(F.col("fault") != BLANK).groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return thin.join(repeated, "same", "left").select("at", "conv_id", (F.col("class") + 4 * fault).alias("code"))


def _stretches(coded: DataFrame, bits: int) -> DataFrame:
    """A row for each stretch: a conversation's rows within 2 to the power ``bits`` places in a row."""
    id_type = coded.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "start", "costs", "ranks", "edits", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    types = [None, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.int32(), pa.int32()]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, own, block = None, [], None

        def rows() -> pa.RecordBatch:
            out = []
            for k, (conv, start, codes) in enumerate(own):
                # a stretch with others on both sides in its block is a whole conversation
                costs, ranks, strings = solved(codes, range(1 if 0 < k < len(own) - 1 else 4))
                faults = [sum(c >> 2 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
                illegal = sum((a & 3, b & 3) not in FOLLOWS for a, b in zip(codes, codes[1:]))
                out.append((conv, start, costs, ranks, strings, *faults, illegal, codes[0] & 3, codes[-1] & 3))
            return pa.record_batch([pa.array(x, t or kind) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for b in batches:
            kind = b.column("conv_id").type
            for at, conv, code in zip(*(b.column(c).to_pylist() for c in ("at", "conv_id", "code")), strict=True):
                if at >> bits != block:
                    if own:
                        yield rows()
                    own, block = [], at >> bits
                if not own or own[-1][0] != conv:
                    own.append((conv, at, bytearray()))
                own[-1][2].append(code)
        if own:
            yield rows()

    dealt = coded.withColumn("block", F.shiftright("at", bits)).repartition("block").sortWithinPartitions("at").select("at", "conv_id", "code")
    shape = f"conv_id {id_type}, start long, costs array<int>, ranks array<int>, edits array<string>, blank long, duplicate long, truncated long, illegal long, first int, last int"
    return dealt.mapInArrow(frugal(solve, "conversations"), shape)


def _chosen(stretches: DataFrame) -> DataFrame:
    """``start, way, ends, illegal, cost``: each stretch's place among its 16, whether it ends its conversation, and its share of the counts."""
    thin = F.struct("start", "costs", "ranks", "illegal", "first", "last")
    # a conversation's stretches without their edits: one entry for thousands of rows
    whole = stretches.groupBy("conv_id").agg(F.sort_array(F.collect_list(thin)).alias("parts")).select("parts")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                before = None
                for part, (p, q) in zip(parts, joined([(x["costs"], x["ranks"]) for x in parts]), strict=True):
                    ends = part is parts[-1]
                    illegal = part["illegal"] + (before is not None and (before, part["first"]) not in FOLLOWS)
                    out.append((part["start"], p * 4 + q, ends, illegal, part["costs"][p * 4 + q] + ends * INSERT * len(ENDING[q])))
                    before = part["last"]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["start", "way", "ends", "illegal", "cost"])

    return whole.mapInArrow(frugal(choose, "conversations"), "start long, way int, ends boolean, illegal long, cost long")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """A row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, nulls first; rows of one turn by role and text. A row's first fault counts: blank (nothing but white space), duplicate (an earlier
    row has its role and text), truncated (the last visible character ends no sentence). ``illegal`` counts neighbours that don't follow one another,
    ``gaps`` the turns missing between the first and the last. ``audit`` has the initials of the cheapest edits, the least string among equals:
    Keep (0), Rerole (2), Delete (3, required for blanks and duplicates), Insert (2, an empty text); a truncated row that stays adds 1.
    ``repaired_sha256`` is over the repaired ``role:text``, joined by line feeds.

    ``damage`` puts faults in first (see ``damaged``); a conversation left without rows has zeros, no audit and the digest of nothing. A null
    id is a conversation like any other, null roles and texts are one space, empty texts are blank. Repeated rows are duplicates. Texts
    of any length and conversations of any number of rows are repaired whole: ties that share a turn, a role and 32 characters, and the digest, are one
    task's stream. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    plain = own.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})
    placed = written(_placed(damaged(own) if damage else plain), "turns")
    with arrow_rows(spark, 10_000):
        stretches = written(_stretches(_coded(placed), stretch_bits), "stretches")
        chosen = written(_chosen(stretches), "ways")
    piece = F.concat(F.get("edits", F.col("way")), F.when(F.col("ends"), F.element_at(F.create_map(*[F.lit(x) for q, end in ENDING.items() for x in (q, end)]), F.col("way") % 4)).otherwise(""))
    nothing = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    begun = own.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("part"), *nothing("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *nothing(*COUNTS[1:]))
    pieces = stretches.drop("illegal").join(chosen, "start").select("conv_id", F.col("start").alias("at"), F.lit(1).alias("part"), *nothing("turn"), F.lit(None).cast("string").alias("role"), piece.alias("text"), *COUNTS[1:])
    turns = placed.select("conv_id", "at", F.lit(2).alias("part"), "turn", "role", "text", *nothing(*COUNTS[1:]))
    stream = begun.unionByName(pieces).unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    id_type = own.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, one = None, [], None
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, kind if n == 0 else pa.int64() if n <= len(COUNTS) else pa.string()) for n, x in enumerate(zip(*out, strict=True))], names=names)

        for b in batches:
            kind = b.column("conv_id").type
            for conv, part, turn, role, text, *counts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", *COUNTS[1:])), strict=True):
                if part == 0:
                    if one:
                        out.append(one.row())
                    one = Repaired(conv)
                elif part == 1:
                    one.goes_on(text, counts)
                else:
                    one.turn(turn, role, text)
            if out:
                yield batch()
                out = []
        if one:
            out.append(one.row())
            yield batch()

    return stream.mapInArrow(frugal(digest, "conversations"), f"conv_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


class Repaired:
    """One conversation while its rows stream by: its edits so far, the digest of what they leave, and turns."""

    def __init__(self, conv: object):
        self.conv, self.hash, self.state, self.empty = conv, hashlib.sha256(), EMPTY, True
        self.pieces, self.at, self.counts = [""], 0, [0] * (len(COUNTS) - 1)
        self.low = self.high = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def insert(self) -> None:
        """What the piece inserts at this place."""
        piece = self.pieces[-1]
        while self.at < len(piece) and piece[self.at] == "I":
            self.state = SPOKEN[self.state]
            self.say("user" if self.state == USER else "assistant", "")
            self.at += 1

    def goes_on(self, piece: str, counts: list[int]) -> None:
        self.pieces.append(piece)
        self.at, self.counts = 0, [a + b for a, b in zip(self.counts, counts, strict=True)]

    def turn(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.insert()
        edit = self.pieces[-1][self.at]
        self.at += 1
        if edit != "D":
            self.state = SYSTEM if edit == "K" and self.state == EMPTY and role[:1] == "s" else SPOKEN[self.state]
            self.say(role if edit == "K" else "user" if self.state == USER else "assistant", text)

    def row(self) -> tuple:
        self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts, "".join(self.pieces), self.hash.hexdigest())

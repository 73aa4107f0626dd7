"""Repair against a plain search over all edits, with stretches so short that conversations span many of them."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def search(rows, found):
    """Dijkstra over (rows done, last role's initial); edits may insert anywhere."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, said = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            assert LEGAL.fullmatch("".join(x[0] for x in said))
            return cost, audit, said
        if (i, last) in done:
            continue
        done.add((i, last))
        ways = [(2, "I", i, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            ways.append((3, "D", i + 1, None, ""))
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                ways += [(extra, "K", i + 1, role, text), *((2 + extra, "R", i + 1, r, text) for r in ("user", "assistant"))]
        for more, edit, j, role, text in ways:
            if role is None:
                heapq.heappush(heap, (cost + more, audit + edit, j, last, said))
            elif (last, role[:1]) in NEXT:
                heapq.heappush(heap, (cost + more, audit + edit, j, role[0], (*said, f"{role}:{text}")))


def expected(rows, damaged=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv]) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, said = search(own, found)
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHAPE = "conv_id long, turn long, role string, text string, at string, costs int"


def some_rows(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "übrig", "unknown"])
            text = r.choice(["Yes.", "No", "So?", "", " \n", None, f"Word {r.randrange(4)}.", "End! ", f"Cut {r.randrange(9)}"])
            rows.append((conv, turn + (turn > 3) if r.random() < 0.9 else None, role, text))
    return rows


@pytest.mark.parametrize("bits,damaged", [(2, True), (0, False), (12, True)])
def test_repairs_as_by_search(spark, bits, damaged):
    from tessera.llm.conversations import repair_conversations

    rows = some_rows(bits, 60, 14) + some_rows(7, 1, 60)
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], SHAPE).repartition(5)
    got = repair_conversations(frame, damage=damaged, stretch_bits=bits).collect()
    assert {x.conv_id: tuple(x[c] for c in COLUMNS) for x in got} == expected(rows, damaged) and len(got) == len({x[0] for x in rows})
    assert repair_conversations(frame.limit(0), damage=damaged).count() == 0


def test_least_audit_of_every_short_conversation():
    from itertools import product

    from tessera.llm.conversations import ENDING, edits, forward

    kinds = [("system", "a."), ("user", "b."), ("assistant", "c."), ("tool", "d."), ("user", "cut"), ("assistant", "")]
    for n in (1, 2, 3, 4, 5):
        for picked in product(range(len(kinds)), repeat=n):
            rows = [(0, i, kinds[k][0], f"{i}{kinds[k][1]}" if kinds[k][1] else "") for i, k in enumerate(picked)]
            found = faults(rows)
            codes = bytes("?sua".find(r[2][0]) % 5 % 4 + 4 * ["", "blank", "duplicate", "truncated"].index(f) for r, f in zip(rows, found))
            ahead = forward(codes, 0, n, 0)
            audits = edits(codes, 0, n, {(0, q) for q in range(4) if ahead[q] < 1 << 30})
            cost, audit, _ = search(rows, found)
            assert (cost, audit) == min((ahead[q] + 2 * len(ENDING[q]), s + ENDING[q]) for (_, q), s in audits.items())


def test_registered_query_matches_search(spark):
    from tessera.llm.queries import op13_conversation_repair

    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {x.conv_id: tuple(x[c] for c in COLUMNS) for x in op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()} == expected(rows)

"""Nodes and structural joins against a stack over the same tokens."""

import re

from tessera.sources import trees

TEXTS = {
    "a.ts": "import x from 'y';\nfunction outer(a, b) {\n  for (const q of a) {\n    if (q) { run(q, inner(')')); } // { not\n  }\n  /* while (x) { */ return call2();\n}",
    "b.ts": "class A extends B {\n  go(x) { while (x) { do { this.n(`${x} (`); } while (f(1)); } }\n  async stay(): string { try { g(); } catch (e) { h([1, (2)]); } }\n}\nconst z = (p) => { p.call(); };",
    "c.ts": "", "d.ts": ") } no (open { call(", "e.ts": "function (a) { return { k: f(1) }; }\nif (a) {} else { b(); }\nexport class C { }",
}


def by_stack(text):
    found = [t for t in re.findall(r"""//[^\n]*|(?s:/\*.*?\*/)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\S""", text) if not t.startswith(("//", "/*"))]
    out, stack = {}, []
    for n, t in enumerate(found):
        if t in "([{":
            out[n] = [None, len(stack) + 1, stack[-1] if stack else None]
            stack.append(n)
        elif t in ")]}" and stack:
            out[stack.pop()][0] = n
    return found, out


def test_intervals_by_a_stack(spark):
    files = spark.createDataFrame([(p, t) for p, t in TEXTS.items() if p != "d.ts"] + [("n.ts", None)], "path string, text string")
    got = {}
    for r in trees.syntax_nodes(files, "path", "text").collect():
        got.setdefault(r.path, {})[r.start] = [r.end, r.depth, r.parent]
    assert got == {p: by_stack(t)[1] for p, t in TEXTS.items() if p not in ("c.ts", "d.ts")}


def test_kinds_and_patterns(spark):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, text string")
    nodes = trees.syntax_nodes(files, "path", "text")
    kinds = lambda rows: sorted(((r.path, r.kind, r.name) for r in rows.collect() if r.kind != "block" and r.path != "d.ts"), key=str)
    want = [("a.ts", "function", "outer"), ("a.ts", "loop", None), ("a.ts", "condition", None), ("a.ts", "call", "run"), ("a.ts", "call", "inner"), ("a.ts", "call", "call2"), ("b.ts", "class", "A")]
    want += [("b.ts", "function", "go"), ("b.ts", "loop", None), ("b.ts", "loop", None), ("b.ts", "call", "n"), ("b.ts", "call", "f"), ("b.ts", "function", "stay"), ("b.ts", "condition", None)]
    want += [("b.ts", "condition", None), ("b.ts", "call", "g"), ("b.ts", "call", "h"), ("b.ts", "function", None), ("b.ts", "call", "call"), ("e.ts", "function", None), ("e.ts", "call", "f")]
    want += [("e.ts", "condition", None), ("e.ts", "condition", None), ("e.ts", "call", "b"), ("e.ts", "class", "C")]
    assert kinds(nodes) == sorted(want, key=str)
    assert {(r.path, r.name) for r in trees.within(nodes, ["function", "loop", "call"]).collect()} == {("a.ts", "run"), ("a.ts", "inner"), ("b.ts", "n"), ("b.ts", "f")}
    assert {(r.path, r.name) for r in trees.within(nodes, ["class", "function", "condition", "call"]).collect()} == {("b.ts", "g"), ("b.ts", "h")}
    assert {(r.path, r.name) for r in trees.children(nodes, "function", "call").collect()} == {("a.ts", "call2"), ("b.ts", "call")}
    pairs = {(r.path, r.inner, r.outer) for r in trees.enclosing(nodes).collect() if r.path != "d.ts"}
    for p, t in TEXTS.items():
        own = by_stack(t)[1]
        want = {(p, a, b) for a in own for b in own if b < a and (own[b][0] is None or own[b][0] > own[a][0])} if p != "d.ts" else set()
        assert {x for x in pairs if x[0] == p} == want
    order = {(r.path, r.start): r.next for r in trees.following(nodes).collect()}
    own = by_stack(TEXTS["b.ts"])[1]
    assert all(order["b.ts", a] == min((b for b in own if own[b][2] == own[a][2] and b > a), default=None) for a in own)

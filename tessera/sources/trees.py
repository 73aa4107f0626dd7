"""Syntax trees of source texts as tables of intervals, and structural joins over them.

A text's tokens are numbered; strings and comments are one token or none, so brackets in them don't count. Each pair of brackets is a node from the
token that opens it to the one that closes it, at a depth that a running sum gives; at one depth opening and closing tokens alternate, so a
node's end is its successor there. What stands before a bracket tells the node's kind. No parser runs: these are windows by file and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.code import with_value

#: Comments, strings, names, numbers, arrows, and any other character; white space falls between.
TOKEN = r"""(?s)//[^\n]*|/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[\p{L}_$][\p{L}\p{N}_$]*|\p{N}[\p{L}\p{N}_.]*|=>|\S"""
NAME = r"^[\p{L}_$]"
LOOPS, CONDITIONS = ("for", "while", "do"), ("if", "else", "switch", "try", "catch", "finally")
#: Names before a bracket that make no call.
NO_CALL = (*LOOPS, *CONDITIONS, "function", "return", "typeof", "await", "in", "of", "with", "throw", "case", "delete", "void", "yield", "instanceof")
KINDS = ("function", "loop", "condition", "class", "call", "block")


def tokens(files: DataFrame, path: str, text: str) -> DataFrame:
    """``path, n, token, before`` of all tokens but comments; ``before`` holds the five tokens ahead, nearest first, and ``after`` the next one."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda t: ~(t.startswith("//") | t.startswith("/*")))
    plain = F.transform(found, lambda t: F.when(F.substring(t, 1, 1).isin('"', "'", "`"), F.lit('""')).otherwise(t))

    def brackets(t: Column) -> Column:
        ahead = lambda i: F.array(*[F.get(t, i - k) for k in range(1, 6)])
        row = lambda x, i: F.struct(i.alias("n"), x.alias("token"), ahead(i).alias("before"), F.get(t, i + 1).alias("after"))
        return F.filter(F.transform(t, lambda x, i: F.when(x.isin(*"(){}[]"), row(x, i))), lambda b: b.isNotNull())

    listed = with_value(files.select(F.col(path).alias("path"), text), "_brackets", plain, brackets)
    return listed.select("path", F.explode_outer("_brackets").alias("b")).where("b is not null").select("path", "b.*")


def syntax_nodes(files: DataFrame, path: str, text: str) -> DataFrame:
    """``path, start, end, depth, kind, name, parent, parent_kind``: a node for each pair of brackets; ``parent`` is the start of the one around it.

    Kinds: ``function`` (its body), ``loop``, ``condition``, ``class``, ``call`` (its arguments), ``block`` (any other). ``name`` is that of the
    function, class or callee, else null. A bracket that is never closed has no end; one that closes nothing makes no node.
    """
    opens = F.col("token").isin("(", "{", "[")
    # a hash ahead of the path makes sorting compare numbers, where many paths begin alike
    in_file = Window.partitionBy("_h", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(in_file)
    narrow = tokens(files, path, text).select(F.xxhash64("path").alias("_h"), "path", "n", "token", "after", *[F.get("before", F.lit(k)).alias(f"_b{k}") for k in range(4)])
    level = narrow.withColumn("depth", depth + F.when(opens, 0).otherwise(1))
    beside = Window.partitionBy("_h", "path", "depth").orderBy("n")
    near = {"_next": (1, ("n", "token", "after")), "_last": (-1, ("n", "token")), "_head": (-2, ("token", "_b0"))}
    rows = level.withColumns({f"{name}_{c}": F.lead(c, k).over(beside) for name, (k, columns) in near.items() for c in columns}).where(opens & (F.col("depth") > 0))
    b = lambda k: F.col(f"_b{k}")
    # the brackets of parameters or a condition right before a body, a result's type between
    headed = (F.col("_head_token") == "(") & (F.col("_last_token") == ")") & ((F.col("_last_n") == F.col("n") - 1) | ((F.col("_last_n") == F.col("n") - 3) & (b(1) == ":")))
    named = lambda c: F.coalesce(c.rlike(NAME), F.lit(False))
    word = F.when(headed, F.col("_head__b0"))
    body = F.col("token") == "{"
    in_class = F.when(b(1) == "class", b(0)).when((b(3) == "class") & (b(1) == "extends"), b(2))
    # parameters, not arguments: a body follows, or a result's type where what stands before the name begins a method
    typed = (F.col("_next_after") == ":") & b(1).isin("function", "async", "static", "get", "set", ";", "{", "}")
    bodied = F.coalesce((F.col("_next_after") == "{") | typed, F.lit(False))
    called = (F.col("token") == "(") & named(b(0)) & ~b(0).isin(*NO_CALL) & ~F.coalesce(b(1) == "function", F.lit(False)) & ~bodied
    kind = (
        F.when(body & (b(0).isin(*LOOPS) | word.isin(*LOOPS)), "loop").when(body & (b(0).isin(*CONDITIONS) | word.isin(*CONDITIONS)), "condition").when(body & in_class.isNotNull(), "class")
        .when(body & ((b(0) == "=>") | named(word)), "function").when(called, "call").otherwise("block")
    )
    plain_name = F.when(F.col("kind") == "class", in_class).when(F.col("kind") == "call", b(0)).when((F.col("kind") == "function") & (word != "function"), word)
    ends = F.when(~F.col("_next_token").isin("(", "{", "["), F.col("_next_n"))
    nodes = rows.withColumn("kind", kind).select("path", F.col("n").alias("start"), ends.alias("end"), F.col("depth").cast("int").alias("depth"), "kind", plain_name.alias("name"))
    return with_parents(nodes)


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent`` and ``parent_kind``: of the nodes one level up in the file the last that starts before."""
    told = F.struct("start", "kind")
    none = lambda like: F.when(F.lit(False), like)
    own = F.struct(*nodes.columns)
    row = lambda level, node, up: F.struct(level.alias("level"), F.col("start").alias("at"), node.alias("node"), up.alias("up"))
    # each node asks and tells, from one reading
    met = nodes.select(F.xxhash64("path").alias("_h"), "path", F.inline(F.array(row(F.col("depth") - 1, own, none(told)), row(F.col("depth"), none(own), told))))
    before = Window.partitionBy("_h", "path", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = met.withColumn("up", F.last("up", ignorenulls=True).over(before)).where("node is not null")
    return found.select("node.*", F.col("up.start").alias("parent"), F.col("up.kind").alias("parent_kind"))


def _met(nodes: DataFrame, kinds: list[str] | None) -> DataFrame:
    """``path, level, inner, outer``: each node (of ``kinds``, if given) with the one around it at each level, as structs."""
    told, own = F.struct("start", "kind", "name"), F.struct(*nodes.columns)
    none = lambda like: F.when(F.lit(False), like)
    row = lambda level, inner, outer: F.struct(level.alias("level"), F.col("start").alias("at"), inner.alias("inner"), outer.alias("outer"))
    asks = F.col("depth") > 1 if kinds is None else (F.col("depth") > 1) & F.col("kind").isin(kinds)
    tells = F.array(row(F.col("depth"), none(own), told))
    rows = F.when(asks, F.concat(tells, F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda level: row(level, own, none(told))))).otherwise(tells)
    before = Window.partitionBy("_h", "path", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = nodes.select(F.xxhash64("path").alias("_h"), "path", F.explode_outer(rows).alias("r")).select("_h", "path", "r.*")
    return met.withColumn("outer", F.last("outer", ignorenulls=True).over(before)).where("inner is not null").drop("_h", "at")


def enclosing(nodes: DataFrame) -> DataFrame:
    """``path, inner, inner_kind, inner_name, outer, outer_kind, outer_name``: each node with every node around it, by their starts.

    At each level there is one at most, the last that starts before; so a node meets as many rows as it is deep, never all nodes of its file.
    """
    side = lambda x: [F.col(f"{x}.start").alias(x), F.col(f"{x}.kind").alias(f"{x}_kind"), F.col(f"{x}.name").alias(f"{x}_name")]
    return _met(nodes, None).select("path", *side("inner"), *side("outer"))


def within(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """The nodes of the last kind that lie in one of the kind before it, and so on up to the first: ``["function", "loop", "call"]``.

    What is around a node lies one in the other, so the kinds are looked for in their order, from the outermost level on.
    """
    around = _met(nodes, kinds[-1:]).where(F.col("outer.kind").isin(kinds[:-1]))
    listed = around.groupBy("path", F.col("inner.start").alias("_start")).agg(F.first("inner").alias("node"), F.sort_array(F.collect_list(F.struct("level", F.col("outer.kind").alias("kind")))).alias("_around"))
    wanted = F.array(*[F.lit(k) for k in kinds[:-1]])
    hits = F.aggregate("_around", F.lit(0), lambda n, x: F.when(x["kind"] == F.get(wanted, n), n + 1).otherwise(n))
    return listed.where(hits == len(kinds) - 1).select("node.*")


def children(nodes: DataFrame, outer: str, inner: str) -> DataFrame:
    """The nodes of kind ``inner`` right in one of kind ``outer``."""
    return nodes.where((F.col("kind") == inner) & (F.col("parent_kind") == outer))


def following(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``next`` and ``next_kind``: the start and kind of the next node in the same one around, null for the last."""
    beside = Window.partitionBy("path", "parent").orderBy("start")
    return nodes.withColumns({"next": F.lead("start").over(beside), "next_kind": F.lead("kind").over(beside)})

"""Syntax trees of source files that are derived from parts: loops nested as deep as a part's size tells, in unlike orders, with brackets in strings and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.tables import spread
from tessera.plans.registry import query, table
from tessera.sources import trees

FREE = "function f{k}(a, b) {\n{open}    if (a[0]) { g{near}(h('}', a)); } // { not a block\n{close}  return done(b);\n}\n"
CLASS = "export class C{k} extends B {\n  m(x) {\n    /* while (x) { */\n    while (x) { this.n(\"(\", [1, (2)]); }\n  }\n  async s(): string { try { t`${x} (`; u(1); } catch (e) { v(); } }\n}\n"
ARROW = "const r{k} = (q) => { q.z(1); };\n"


def nested_files(spark, d):
    """``path, text``: parts of even keys begin with their class."""
    part = spread(table(spark, d, "part").select(F.concat(F.lit("src/t"), "p_partkey", F.lit(".ts")).alias("path"), "p_partkey", "p_size"), "path")
    loops = F.col("p_size") % 4
    free = F.replace(F.replace(F.lit(FREE), F.lit("{open}"), F.repeat(F.lit("  for (const x of a) {\n"), loops)), F.lit("{close}"), F.repeat(F.lit("  }\n"), loops))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(CLASS), free, F.lit(ARROW))).otherwise(F.concat(free, F.lit(ARROW), F.lit(CLASS)))
    named = F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{near}"), (F.col("p_partkey") % 10).cast("string"))
    return part.select("path", named.alias("text"))


_T = "SELECT 'src/t' || p_partkey || '.ts' AS path, p_partkey AS k, p_partkey % 10 AS near, p_size % 4 AS loops, p_partkey % 2 = 0 AS class_first FROM part"


@query(f"""WITH t AS ({_T}) SELECT path, unnest(['function', 'loop', 'condition', 'class', 'call']) AS kind, unnest([4, 1 + loops, 3, 1, 7])::BIGINT AS nodes, unnest([2, greatest(3, loops + 1), greatest(3, loops + 2), 1, loops + 4])::INT AS deepest FROM t""")
def syntax_nodes(spark, d):
    """How many nodes of each kind a file has, and how deep the deepest lies."""
    nodes = trees.syntax_nodes(nested_files(spark, d), "path", "text").where("kind <> 'block'")
    return nodes.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"))


@query(f"""WITH t AS ({_T}), c AS (SELECT path, unnest(['g' || near, 'h']) AS name FROM t WHERE loops > 0 UNION ALL SELECT path, 'n' FROM t) SELECT path, name FROM c""")
def calls_in_loops(spark, d):
    """Calls in a loop in a function."""
    return trees.within(trees.syntax_nodes(nested_files(spark, d), "path", "text"), ["function", "loop", "call"]).select("path", "name")


@query(f"""WITH t AS ({_T}), c AS (SELECT path, unnest(['done', 'z']) AS name FROM t) SELECT path, name FROM c""")
def calls_right_in_functions(spark, d):
    return trees.children(trees.syntax_nodes(nested_files(spark, d), "path", "text"), "function", "call").select("path", "name")


@query(f"""WITH t AS ({_T}) SELECT path, 'C' || k AS name, CASE WHEN class_first THEN 'block' END AS next_kind FROM t""")
def after_classes(spark, d):
    """What follows each class in its file: here the parameters of a function, or nothing."""
    nodes = trees.following(trees.syntax_nodes(nested_files(spark, d), "path", "text"))
    return nodes.where("kind = 'class'").select("path", "name", "next_kind")

"""State as nested documents (VARIANT): an update log folded below paths of any depth, and reads by path.

A log is a trie of paths for each key. Values that are objects are taken apart into their leaves; a ``set`` clears what lies at and below its path, so a leaf
lives if no path above it has been set later. Leaves fold by path with partial sums, and documents are put together from the deepest level up. No
key's log passes through a loop; only its own items gather, as they do in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import settled

FIELDS = "map<string,variant>"


def _fields(text: Column) -> Column:
    """The fields of a JSON object, null for any other value."""
    return F.try_variant_get(F.parse_json(text), "$", FIELDS)


def _exploded(rows: DataFrame) -> DataFrame:
    """``rows`` (``p, text``) with each object in place of its fields, one level down."""
    field = F.explode(F.transform(F.map_entries("_fields"), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    return rows.withColumn("_f", field).withColumns({"p": F.array_append("p", F.col("_f.k")), "text": F.col("_f.v")}).drop("_f", "_fields")


def _leaves(rows: DataFrame) -> DataFrame:
    """``set`` rows taken apart until no value is an object with fields; empty objects stay."""
    done = None
    while True:
        rows = settled(rows.withColumn("_fields", _fields(F.col("text"))))
        flat = rows.where("_fields is null or cardinality(_fields) = 0").drop("_fields")
        done = flat if done is None else done.unionByName(flat)
        deeper = rows.where("cardinality(_fields) > 0")
        if not deeper.take(1):
            return done
        rows = _exploded(deeper)


def _quoted(name: Column) -> Column:
    shown = F.to_json(F.array(name))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def fold_nested(log: DataFrame, key: str, order: list[str], merge_as_set: bool = False, deep: bool = False) -> DataFrame:
    """``key, state``: each key's document after its log (``key, path, op, value``), ``value`` being JSON text.

    ``set`` puts a value at a path, in place of all that was there or below; ``increment`` adds a number (1 where it is null) to a number or nothing;
    ``append`` adds an item to an array or nothing; ``merge`` sets each field of an object, ``deep`` also those of objects within it.
    ``merge_as_set`` is the policy of sub-agents. Objects on the way to a path are made where they are missing. A path below a value that is no
    object, an increment of no number, an append to no array and a merge of no object are errors. Rows with a null path or key and no value are as
    they are: a null value sets null. ``order`` must tell a key's rows apart. An empty log gives no rows.
    """
    op = F.when(F.lit(merge_as_set) & (F.col("op") == "merge"), "set").otherwise(F.col("op"))
    text = F.coalesce(F.col("value"), F.when(op == "increment", "1").otherwise("null"))
    rows = log.where("path is not null").select(F.col(key).alias("k"), F.split("path", r"\.").alias("p"), op.alias("op"), text.alias("text"), F.struct(*order).alias("at"))
    whole = rows.where("op = 'merge'").withColumn("_fields", F.coalesce(_fields(F.col("text")), F.raise_error(F.lit("only objects merge")).cast(FIELDS)))
    # each field of a merge is a set of its own; an empty merge makes an empty object
    fields = _exploded(whole.where("cardinality(_fields) > 0")).withColumn("op", F.lit("set"))
    empty = whole.where("cardinality(_fields) = 0").drop("_fields").withColumn("op", F.lit("touch"))
    sets = settled(rows.where("op = 'set'").unionByName(fields if not deep else fields.limit(0)))
    leaves = _leaves(sets)
    clears = sets
    if deep:
        inner = settled(_leaves(fields))
        leaves, clears = leaves.unionByName(inner), clears.unionByName(inner)
    writes = settled(leaves.unionByName(rows.where("op in ('increment', 'append')")).unionByName(empty))
    cleared = clears.groupBy(F.col("k").alias("own"), F.col("p").alias("path")).agg(F.max("at").alias("cut"))
    above = writes.select("k", "p").distinct().withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))))
    since = above.join(cleared, F.col("k").eqNullSafe(F.col("own")) & (F.col("above") == F.col("path"))).groupBy(F.col("k").alias("own"), F.col("p").alias("path")).agg(F.max("cut").alias("since"))
    alive = writes.join(since, F.col("k").eqNullSafe(F.col("own")) & (F.col("p") == F.col("path")), "left").where("since is null or at >= since").select("k", "p", "op", "text", "at")
    number = F.try_variant_get(F.parse_json("text"), "$", "double")
    items = F.sort_array(F.collect_list(F.when(F.col("op") == "append", F.struct("at", "text"))))
    folded = alive.groupBy("k", "p").agg(
        F.max(F.when(F.col("op") == "set", F.col("text"))).alias("own"),
        F.sum(F.when(F.col("op") == "increment", F.coalesce(number, F.raise_error(F.lit("only numbers increment")).cast("double")))).alias("more"),
        items.alias("items"),
    )
    base = F.parse_json(F.coalesce("own", F.lit("null")))
    start = F.when(F.col("own").isNull(), 0.0).otherwise(F.try_variant_get(base, "$", "double"))
    total = F.coalesce(start, F.raise_error(F.lit("an increment of no number")).cast("double")) + F.col("more")
    shown = F.when(total == F.floor(total), F.floor(total).cast("string")).otherwise(total.cast("string"))
    # an array's own text without its brackets
    held = F.when(F.col("own").isNull(), "").when(F.try_variant_get(base, "$", "array<variant>").isNotNull(), F.regexp_replace("own", r"(?s)^\s*\[\s*|\s*\]\s*$", "")).otherwise(F.raise_error(F.lit("an append to no array")).cast("string"))
    added = F.array_join(F.transform("items", lambda x: x["text"]), ",")
    listed = F.concat(F.lit("["), held, F.when((held != "") & (added != ""), ",").otherwise(""), added, F.lit("]"))
    leaf = F.when(F.size("items") > 0, listed).when(F.col("more").isNotNull(), shown).otherwise(F.coalesce("own", F.lit("{}")))
    nodes = settled(folded.select("k", "p", leaf.alias("text")))
    depth = nodes.agg(F.max(F.size("p"))).first()[0] or 0  # one number
    none = F.lit(None).cast("string")
    level = nodes.where(F.size("p") == depth).select("k", "p", F.col("text").alias("own"), none.alias("inner"))
    for n in range(depth, 0, -1):
        clash = F.raise_error(F.lit("a path leads below a value that is no object")).cast("string")
        one = level.groupBy("k", "p").agg(F.max("own").alias("own"), F.max("inner").alias("inner"))
        value = F.when(F.col("inner").isNull(), F.col("own")).when(F.col("own").isNull() | (F.col("own") == "{}"), F.col("inner")).otherwise(clash)
        pairs = F.sort_array(F.collect_list(F.struct(F.element_at("p", -1).alias("name"), value.alias("text"))))
        parents = one.groupBy("k", F.slice("p", F.lit(1), F.lit(n - 1)).alias("p")).agg(pairs.alias("f"))
        built = F.concat(F.lit("{"), F.array_join(F.transform("f", lambda x: F.concat(_quoted(x["name"]), F.lit(":"), x["text"])), ","), F.lit("}"))
        made = parents.select("k", "p", none.alias("own"), built.alias("inner"))
        level = made.unionByName(nodes.where(F.size("p") == n - 1).select("k", "p", F.col("text").alias("own"), none.alias("inner")))
    return level.select(F.col("k").alias(key), F.parse_json("inner").alias("state"))


def read(state: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of a document; null where there is none or it is of another kind. Digits count in arrays."""
    return F.try_variant_get(state, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".")), kind)

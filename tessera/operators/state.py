"""Workflow state as tables: reads by path, update logs folded per path, versions, scopes and loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tables import settled

# Tiers that may be written, and the one that an old name stands for.
WRITABLE, OLD_TIERS = ("this", "global", "inputs", "state", "raw"), {"raw": "inputs", "this": "state"}


def json_path(path: str) -> str:
    """``a.b.0`` as ``$.a.b[0]``."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def read_path(state: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where there is none."""
    return F.get_json_object(state, json_path(path))


def project_paths(rows: DataFrame, keep: list[str], state: str, paths: list[str]) -> DataFrame:
    """``keep`` and a column for each path, named by it; missing ones are null."""
    return rows.select(*keep, *[read_path(F.col(state), p).alias(p) for p in paths])


def merged(low: Column, high: Column) -> Column:
    """Two maps; of a key in both the value of ``high``."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def flat_view(state: Column, inputs: Column, computed: Column) -> Column:
    """One map of three tiers: computed values hide inputs, and these the state's."""
    return merged(merged(state, inputs), computed)


def flattened(rows: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, at: str = "") -> Iterator[str]:
        for f in schema.fields:
            yield from leaves(f.dataType, f"{at}{f.name}.") if isinstance(f.dataType, T.StructType) else [at + f.name]

    return rows.select(*[F.col(".".join(f"`{p}`" for p in name.split("."))).alias(name) for name in leaves(rows.schema)])


def nested(columns: list[str]) -> list[Column]:
    """The reverse: dotted names as structs, one for each name before the first point."""
    heads = dict.fromkeys(c.partition(".")[0] for c in columns)
    return [F.struct(*[F.col(f"`{c}`").alias(c.partition(".")[2]) for c in columns if c.startswith(h + ".")]).alias(h) if h not in columns else F.col(h) for h in heads]


def writable(path: Column) -> Column:
    """Whether a path names a tier that may be written and a field in it; computed values and loop variables may not."""
    return path.rlike(rf"^({'|'.join(WRITABLE)})\.[^.]+(\.[^.]+)*$")


def normal_path(path: Column) -> Column:
    """A path with old names of tiers in place of the new ones."""
    out = path
    for old, new in OLD_TIERS.items():
        out = F.regexp_replace(out, rf"^{old}\.", f"{new}.")
    return out


def atomic_batches(updates: DataFrame, batch: list[str], valid: Column) -> DataFrame:
    """The updates of batches all of whose updates are valid; of others none applies."""
    bad = updates.groupBy(*batch).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("_ok")).where("not _ok").drop("_ok")
    return updates.join(bad, batch, "left_anti")


def fold_updates(log: DataFrame, key: str, order: list[str], merge_as_set: bool = False) -> DataFrame:
    """An update log (``key, path, op, field, number, text``) as the state it leads to.

    Returns ``key, path, field, number, text, items``: ``set`` puts a value in place of all before it; ``increment`` adds (1 where the number is
    null) to a number, or to 0; ``append`` counts items (their values stay rows of the log); ``merge`` gives a row for each field, its
    last value. ``merge_as_set`` is the policy of sub-agents, whose merge sets. What came before the last ``set`` doesn't count.
    """
    at = F.struct(*order)
    op = F.when(F.lit(merge_as_set) & (F.col("op") == "merge"), "set").otherwise(F.col("op"))
    rows = log.select(key, "path", op.alias("op"), "field", "number", "text", at.alias("at"))
    is_set = F.col("op") == "set"
    last = rows.groupBy(key, "path").agg(F.max(F.when(is_set, F.col("at"))).alias("since"))
    live = rows.join(last, [key, "path"]).where(F.col("since").isNull() | (F.col("at") >= F.col("since")))
    scalar = live.where("op <> 'merge'").groupBy(key, "path").agg(
        F.lit(None).cast("string").alias("field"),
        F.sum(F.when(is_set, F.col("number")).when(F.col("op") == "increment", F.coalesce("number", F.lit(1.0)))).alias("number"),
        F.max(F.when(is_set, F.col("text"))).alias("text"),
        F.count_if(F.col("op") == "append").alias("items"),
    )
    fields = live.where("op = 'merge'").groupBy(key, "path", "field").agg(F.max_by("number", "at").alias("number"), F.max_by("text", "at").alias("text"), F.lit(0).cast("long").alias("items"))
    return scalar.unionByName(fields)


def resolved(log: DataFrame, keys: list[str], order: list[str], value: str, strategy: str) -> DataFrame:
    """Writes to the same keys, resolved: ``last_writer`` or ``first_writer`` wins, with the number of writes as ``version``."""
    pick = {"last_writer": F.max_by, "first_writer": F.min_by}[strategy]
    return log.groupBy(*keys).agg(pick(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("version"))


def accepted_updates(updates: DataFrame, key: str, order: list[str], expected: str) -> DataFrame:
    """Optimistic locking: per key in order, an update is accepted if it expects the current version (0 at first), which it raises by 1.

    Adds ``accepted`` and ``version`` (after the update). Each decision hangs on the one before, so the (thin) rows of a key pass
    through one task in order, with the version as only state. A null expectation is always accepted.
    """

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, version = object(), 0
        for b in batches:
            ok, versions = [], []
            for k, e in zip(b.column(key).to_pylist(), b.column(expected).to_pylist(), strict=True):
                if k != current:
                    current, version = k, 0
                ok.append(e is None or e == version)
                version += ok[-1]
                versions.append(version)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(versions, pa.int64())], names=[*b.schema.names, "accepted", "version"])

    schema = updates.withColumns({"accepted": F.lit(True), "version": F.lit(0).cast("long")}).schema
    return updates.repartition(key).sortWithinPartitions(key, *order).mapInArrow(decided, schema)


def as_of(history: DataFrame, key: str, version: str, at: int) -> DataFrame:
    """Each key's newest row up to version ``at``; keys without one are left out."""
    own = Window.partitionBy(key).orderBy(F.desc(version))
    return history.where(F.col(version) <= at).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def restored(history: DataFrame, key: str, version: str, at: int) -> DataFrame:
    """``history`` with the state of version ``at`` put on top of each key that has gone beyond it, as a new version."""
    newest = history.groupBy(key).agg(F.max(version).alias("_top")).where(F.col("_top") > at)
    return history.unionByName(as_of(history, key, version, at).join(newest, key).withColumn(version, F.col("_top") + 1).drop("_top"))


def pruned(history: DataFrame, key: str, version: str, keep: int) -> DataFrame:
    """``history`` without what is older than each key's ``keep`` newest versions; rows of one version stay or go together.

    Versions are counted, not rows, so a version that a key holds many rows of is one entry.
    """
    own = Window.partitionBy("_k").orderBy(F.desc("_v"))
    newest = history.select(F.col(key).alias("_k"), F.col(version).alias("_v")).distinct().withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= keep).drop("_n")
    return history.join(newest, F.col(key).eqNullSafe(F.col("_k")) & F.col(version).eqNullSafe(F.col("_v")), "left_semi")


def scoped(*values: Column) -> Column:
    """The value of the innermost scope that has one."""
    return F.coalesce(*values)


def routed(rows: DataFrame, condition: Column, yes: Callable[[DataFrame], DataFrame], no: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``conditional``: rows that meet the condition go one way, all others (null too) the other."""
    met = F.coalesce(condition, F.lit(False))
    return yes(rows.where(met)).unionByName(no(rows.where(~met)))


def while_loop(rows: DataFrame, condition: Column, body: Callable[[DataFrame], DataFrame], most: int = 100, settle_every: int = 10) -> DataFrame:
    """``rows`` after the body has run on each as long as its condition holds, ``most`` times at most; ``iterations`` counts.

    Rows that are done leave the loop; what remains is settled every few rounds, so plans don't grow with the rounds.
    """
    left, done = rows.withColumn("iterations", F.lit(0).cast("long")), []
    for k in range(most):
        met = F.coalesce(condition, F.lit(False))
        done.append(left.where(~met))
        left = body(left.where(met)).withColumn("iterations", F.col("iterations") + 1)
        if (k + 1) % settle_every == 0:
            left = settled(left)
            if not left.take(1):
                break
    out = left
    for d in done:
        out = out.unionByName(d)
    return out


def namespaced(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """An included workflow's columns under its name, keys as they are."""
    return rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias(name))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Initial state: inputs where given, defaults where null or absent."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def child_inputs(parent: DataFrame, mapping: dict[str, str], wanted: list[str], keys: list[str]) -> DataFrame:
    """A child's inputs from its parent's variables: by explicit mapping, then by the same name; others are null."""
    source = {w: mapping.get(w, w) for w in wanted}
    return parent.select(*keys, *[F.col(s).alias(w) if s in parent.columns else F.lit(None).cast("string").alias(w) for w, s in source.items()])

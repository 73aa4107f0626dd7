"""Lookups, listings, spans and counters over event and state tables, and rules that say what happens next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import r6
from tessera.operators.paging import SMALL, page_after

# What happens to a failed step of a type by default: strategy, retries, milliseconds before a retry.
HANDLERS = {
    "shell_command": ("retry", 2, 1000),
    "mcp_call": ("retry", 3, 500),
    "state_update": ("fail", 0, 0),
    "conditional": ("fail", 0, 0),
    "user_input": ("continue", 0, 0),
}


def by_id(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with one id; the filter reaches the scan."""
    return rows.where(F.col(column) == F.lit(value))


def spans(rows: DataFrame, key: str, order: list[str], value: str, time_col: str) -> DataFrame:
    """Per key the first and the last value, their difference, and the milliseconds between."""
    at = F.struct(*order)
    micros = lambda f: f(F.unix_micros(F.col(time_col).cast("timestamp")))
    stats = rows.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), r6((micros(F.max) - micros(F.min)) / 1000).alias("duration_ms"))
    return stats.withColumn("growth", r6(F.col("last") - F.col("first")))


def page_or_all(rows: DataFrame, order: str, chars: str, budget: int, cursor: object = None) -> DataFrame:
    """A page after the cursor; a table of ten rows or fewer is returned whole, whatever the cursor."""
    return rows if rows.limit(SMALL + 1).count() <= SMALL else page_after(rows, order, chars, budget, cursor)


def completion(total: Column, done: Column) -> Column:
    """Share of steps done in percent; 0 where there are none."""
    return r6(F.when(total == 0, 0.0).otherwise(100 * done / total))


def default_handler(kind: Column, handlers: dict[str, tuple[str, int, int]] = HANDLERS, otherwise: tuple[str, int, int] = ("fail", 0, 0)) -> Column:
    """The default ``strategy``, ``retries`` and ``delay_ms`` for a type of step, as a struct; types without a handler fail at once."""
    as_struct = lambda h: F.struct(F.lit(h[0]).alias("strategy"), F.lit(h[1]).alias("retries"), F.lit(h[2]).alias("delay_ms"))
    out = as_struct(otherwise)
    for name, handler in handlers.items():
        out = F.when(kind == name, as_struct(handler)).otherwise(out)
    return out


def recovery_plan(errors: DataFrame, rules: DataFrame, kind: str, value: str) -> DataFrame:
    """Errors with the action of the first rule (``kind, least, priority, action``) that covers them; others are escalated.

    A kind's rules are gathered in one row first, so an error meets one row at most, and equal errors stay as many as they are.
    """
    listed = rules.groupBy(F.col("kind").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("priority", "least", "action"))).alias("_rules"))
    hit = errors.join(listed, F.col(kind) == F.col("_of"), "left")
    first = F.get(F.filter("_rules", lambda r: F.col(value) >= r["least"]), F.lit(0))
    return hit.select(*[F.col(f"`{c}`") for c in errors.columns], F.coalesce(first["action"], F.lit("escalate")).alias("action"))


# The longest message that is shown whole, and what a longer one is cut to.
MESSAGE, CUT = 500, 497


def concise_error(message: Column, workflow: Column, step: Column) -> Column:
    """A message without the ids of its own workflow and step, which its reader knows, cut where it is very long. Null ids change nothing."""
    bare = lambda text, word, of: F.coalesce(F.when(of != "", F.replace(text, F.concat(F.lit(f"{word} "), of), F.lit(word))), text)
    short = bare(bare(message, "workflow", workflow.cast("string")), "step", step.cast("string"))
    return F.when(F.length(short) > MESSAGE, F.concat(F.substring(short, 1, CUT), F.lit("..."))).otherwise(short)


def statuses(events: DataFrame, key: str, order: list[str], started: Column, ended: Column, failed: Column) -> DataFrame:
    """Each workflow's status by its newest event, with its number of events."""
    at = F.struct(*order)
    status = F.when(failed, "failed").when(ended, "completed").when(started, "running").otherwise("paused")
    return events.withColumn("_s", status).groupBy(key).agg(F.max_by("_s", at).alias("status"), F.count(F.lit(1)).alias("events"))


def counters(events: DataFrame, key: str, facets: dict[str, Column]) -> DataFrame:
    """Counters per key that an append-only log leads to: one for each facet's condition."""
    return events.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in facets.items()])


def routed_updates(updates: DataFrame, path: str) -> DataFrame:
    """Updates with the table they belong to: ``this`` and ``inputs`` to the state, ``global`` to the shared context, others nowhere."""
    tier = F.regexp_extract(path, r"^([^.]+)\.", 1)
    target = F.when(tier.isin("this", "state", "inputs", "raw"), "state").when(tier == "global", "context")
    return updates.withColumn("target", target).withColumn("field", F.when(target.isNotNull(), F.regexp_replace(path, r"^[^.]+\.", "")))


def best_hints(scored: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Hints of the standards that score above 0, with their score, best first by standard."""
    return scored.where("score > 0").join(hints, key)


def text_tokens(json: Column) -> Column:
    """Tokens of all texts in a JSON value, however deep: a quarter of their characters each, keys left out."""
    values = F.regexp_extract_all(json, F.lit(r'(?<=[:\[,])"((?:[^"\\]|\\.)*)"(?!\s*:)'), F.lit(1))
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + F.floor(F.length(v) / 4))

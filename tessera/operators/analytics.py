"""Summaries of errors, sessions, sizes, transformations, comparisons, agents and recoveries over event tables.

Times are judged as of the newest row, so that results don't hang on when they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import exact_sum, half_up, r6
from tessera.operators.tables import unused

#: Ranks of severities, lowest first.
SEVERITIES = ("low", "medium", "high", "critical")


def severity_of(value: Column, ladder: tuple[tuple[float, str], ...]) -> Column:
    """The name of the first threshold (highest first) that a value reaches; the lowest severity below all."""
    out = F.lit(SEVERITIES[0])
    for least, name in reversed(ladder):
        out = F.when(value >= least, name).otherwise(out)
    return out


def with_newest(rows: DataFrame, time_col: str) -> DataFrame:
    """``rows`` with the newest time of all as ``newest`` (one row is broadcast)."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(time_col).alias("newest"))))


def recent(rows: DataFrame, time_col: str, hours: int) -> DataFrame:
    """Rows of the last ``hours``."""
    return with_newest(rows, time_col).where(F.col(time_col) >= F.col("newest") - F.expr(f"interval {hours} hours")).drop("newest")


def error_summary(errors: DataFrame, time_col: str, severity: Column, kind: Column) -> DataFrame:
    """``facet, name, n, recent, first, last``: errors in all, by severity and by type; ``recent`` counts the last hour."""
    rows = with_newest(errors, time_col).select(F.col(time_col).alias("t"), (F.col(time_col) >= F.col("newest") - F.expr("interval 1 hour")).alias("fresh"), severity.alias("s"), kind.alias("k"))
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), v.cast("string").alias("name")) for f, v in (("all", F.lit("")), ("severity", F.col("s")), ("type", F.col("k")))])
    return rows.select("t", "fresh", F.explode(facets).alias("f")).groupBy("f.facet", "f.name").agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("recent"), F.min("t").alias("first"), F.max("t").alias("last"))


def severity_trend(errors: DataFrame, time_col: str, severity: Column, hours: int = 24) -> DataFrame:
    """Errors per hour and severity, a column for each severity."""
    rows = recent(errors, time_col, hours).select(F.date_trunc("hour", time_col).alias("hour"), severity.alias("s"))
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("s") == s).alias(s) for s in SEVERITIES])


def last_measurements(rows: DataFrame, key: list[str], order: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key, with their number from the newest as ``nth``."""
    own = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= keep)


def state_sizes(rows: DataFrame, key: str, order: list[str], size: str, keep: int = 100) -> DataFrame:
    """Per key over its last ``keep`` sizes: number, current, largest, smallest, mean and growth from first to last; updates in all."""
    updates = rows.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("updates"))
    at = F.struct(*order)
    stats = last_measurements(rows.select(key, size, *order), [key], order, keep).groupBy(key).agg(
        F.count(F.lit(1)).alias("measurements"), r6(F.max_by(size, at)).alias("current"), r6(F.max(size)).alias("largest"), r6(F.min(size)).alias("smallest"),
        r6(F.avg(size)).alias("mean"), r6(F.max_by(size, at) - F.min_by(size, at)).alias("growth"),
    )
    return stats.join(updates, F.col(key).eqNullSafe(F.col("of"))).drop("of")


def size_warnings(sizes: DataFrame, threshold: float) -> DataFrame:
    """Keys whose current size is above the threshold, with the excess, largest first."""
    return sizes.where(F.col("current") > threshold).withColumn("exceeded_by", r6(F.col("current") - threshold)).orderBy(F.desc("exceeded_by"))


def transformation_stats(rows: DataFrame, key: str, field: str, order: list[str], duration: str, failed: Column, keep: int = 100) -> DataFrame:
    """Per key and field, and (field null) per key: executions, errors, success rate; mean and largest of the last ``keep`` durations of each field."""
    counted = rows.groupBy(key, field).agg(F.count(F.lit(1)).alias("executions"), F.count_if(failed).alias("errors"))
    timed = last_measurements(rows.select(key, field, duration, *order), [key, field], order, keep).groupBy(key, field).agg(F.sum(duration).alias("total"), F.count(duration).alias("timings"), F.max(duration).alias("longest"))
    both = counted.join(timed, [key, field])
    rate = r6(100 * (F.sum("executions") - F.sum("errors")) / F.sum("executions")).alias("success_rate")
    return both.rollup(key, field).agg(
        F.grouping_id().alias("level"), F.sum("executions").alias("executions"), F.sum("errors").alias("errors"), rate, r6(F.sum("total") / F.sum("timings")).alias("mean"), r6(F.max("longest")).alias("longest")
    ).where("level < 3").drop("level")


def slowest(rows: DataFrame, keys: list[str], duration: str, top: int) -> DataFrame:
    """The ``top`` combinations of keys by their longest duration; ties by the keys."""
    stats = rows.groupBy(*keys).agg(r6(F.max(duration)).alias("longest"), r6(F.avg(duration)).alias("mean"), F.count(F.lit(1)).alias("executions"))
    return stats.orderBy(F.desc("longest"), *keys).limit(top)


def top_sources(errors: DataFrame, source: str, top: int) -> DataFrame:
    """The ``top`` sources of errors by number; ties by name."""
    return errors.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), source).limit(top)


def step_breakdown(rows: DataFrame, step: str, measures: dict[str, str], failed: Column) -> DataFrame:
    """Per type of step: count, mean of each measure, success rate."""
    return rows.groupBy(step).agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(name) for name, c in measures.items()], r6(100 * F.count_if(~failed) / F.count(F.lit(1))).alias("success_rate"))


def usage_pattern(rows: DataFrame, key: str, value: str, spike: float = 2.0, busy: float = 70.0, share: float = 0.3) -> DataFrame:
    """Per key: ``spiky`` if a value is above ``spike`` times the mean, ``busy`` if more than ``share`` of the values are above ``busy``."""
    v = F.col(value)
    return rows.groupBy(key).agg((F.max(v) > spike * F.avg(v)).alias("spiky"), (F.count_if(v > busy) / F.count(v) > share).alias("busy"))


def bottleneck_report(rows: DataFrame, keep: list[str], ladders: dict[str, tuple[tuple[float, str], ...]], top: int) -> DataFrame:
    """The ``top`` findings over several metrics: each value that reaches its metric's ladder, worst severity and largest excess first."""
    found = []
    for metric, ladder in ladders.items():
        severity = F.when(F.col(metric) >= ladder[-1][0], severity_of(F.col(metric), ladder))
        found.append(F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), severity.alias("severity"), (F.col(metric) / ladder[-1][0]).alias("excess")))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    rows = rows.select(*keep, F.explode(F.array(*found)).alias("f")).select(*keep, "f.*").where("severity is not null")
    return rows.withColumn("excess", r6(F.col("excess"))).orderBy(rank.desc(), F.desc("excess"), "metric", *keep).limit(top)


def ordered_totals(rows: DataFrame, keys: list[str], order: list[str], amount: Column, total: str, nth: str) -> DataFrame:
    """``rows`` with the sum of doubles up to each row of its keys as ``total``, added one by one in ``order``, and the row's number as ``nth``; the last one's is the keys' total."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(nth, F.row_number().over(own)).withColumn(total, F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def compared_modes(
    rows: DataFrame, key: str, mode: str, one: str, other: str, duration: str, memory: str, rounded: Callable[[Column], Column] = half_up, order: list[str] | None = None,
) -> DataFrame:
    """Two modes of each key (total duration, peak memory): speed-up, time saved, overhead, what to choose, and both totals by their modes' names.

    A speed-up over a total that isn't above zero is 0. Totals are exact sums, as a last place that hangs on the order of rows turns the choice where
    totals are equal, and rounding at a half. With ``order`` they are sums of doubles in that order, as SQL has them that reads rows so in one thread.
    """
    of = lambda m, c: F.when(F.col(mode) == m, F.col(c).cast("double"))
    if order:
        run, nth = unused(rows, "run"), unused(rows, "nth")
        rows = ordered_totals(rows.where(F.col(mode).isin(one, other)), [key, mode], order, F.col(duration).cast("double"), run, nth)
        totals = [F.max_by(of(m, run), F.when(F.col(mode) == m, F.col(nth))) for m in (one, other)]
    else:
        totals = [exact_sum(of(m, duration)) for m in (one, other)]
    wide = rows.groupBy(key).agg(totals[0].alias("d1"), totals[1].alias("d2"), F.max(of(one, memory)).alias("m1"), F.max(of(other, memory)).alias("m2")).where("d1 is not null and d2 is not null")
    speed = F.when(F.col("d1") > 0, F.col("d2") / F.col("d1")).otherwise(0.0)
    overhead = F.when(F.col("m2") > 0, F.col("m1") / F.col("m2")).otherwise(0.0)
    choice = F.when((speed > 1.2) & (overhead < 3), one).when(overhead > 5, other).otherwise(F.when(speed > 1, one).otherwise(other))
    return wide.select(key, rounded(speed).alias("speedup"), rounded(F.col("d2") - F.col("d1")).alias("time_saved"), rounded(overhead).alias("memory_overhead"), choice.alias("recommended"), F.col("d1").alias(f"{one}_duration"), F.col("d2").alias(f"{other}_duration"))


def scalability(levels: DataFrame, load: str, duration: str, success_rate: str) -> DataFrame:
    """One row over load levels: degradation in percent from the lowest to the highest load, the first load with less than 95 % success, a rating."""
    slower = 100 * (F.max_by(duration, load) - F.min_by(duration, load)) / F.nullif(F.min_by(duration, load), F.lit(0.0))
    stats = levels.agg(r6(slower).alias("degradation"), F.min(F.when(F.col(success_rate) < 95, F.col(load))).alias("breaking_point"))
    rating = F.when(F.col("breaking_point").isNotNull() & (F.col("degradation") > 100), "poor").when(F.col("degradation") < 20, "excellent").when(F.col("degradation") < 50, "good").otherwise("fair")
    return stats.withColumn("rating", rating)


def throughput(rows: DataFrame, key: str, start: str, duration_ms: str) -> DataFrame:
    """Operations, operations a second between the first start and the last end, mean duration and most at once by the minute."""
    begin = F.unix_micros(F.col(start).cast("timestamp"))
    per_minute = rows.groupBy(F.col(key).alias("of"), F.date_trunc("minute", start).alias("m")).agg(F.count(F.lit(1)).alias("c")).groupBy("of").agg(F.max("c").alias("busiest_minute"))
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), ((F.max(begin + F.col(duration_ms) * 1000) - F.min(begin)) / 1e6).alias("seconds"), r6(F.avg(duration_ms)).alias("mean_ms"))
    rate = F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0)
    return total.join(per_minute, F.col(key).eqNullSafe(F.col("of"))).select(key, "n", r6(rate).alias("per_second"), "mean_ms", "busiest_minute")


def hit_rates(rows: DataFrame, level: str, hit: Column) -> DataFrame:
    """Hits, misses and hit rate by cache level and (level null) over all."""
    return rows.rollup(level).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), r6(F.count_if(hit) / F.count(F.lit(1))).alias("hit_rate"))


def hot_keys(rows: DataFrame, level: str, key: str, per_level: int = 10, overall: int = 20) -> DataFrame:
    """The most used keys of each level, of these the most used over all; ties by level and key."""
    counted = rows.groupBy(level, key).agg(F.count(F.lit(1)).alias("uses"))
    own = Window.partitionBy(level).orderBy(F.desc("uses"), key)
    return counted.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_level).drop("_n").orderBy(F.desc("uses"), level, key).limit(overall)


def parallel_errors(rows: DataFrame, key: str, task: str, failed: Column, threshold: float = 0.5) -> DataFrame:
    """Per run: tasks, tasks with an error, share of tasks without; what each strategy does: ``fail_fast``, ``best_effort`` and ``threshold`` (more than that share failed)."""
    tasks = rows.groupBy(key, task).agg(F.bool_or(failed).alias("bad"))
    out = tasks.groupBy(key).agg(F.count(F.lit(1)).alias("tasks"), F.count_if("bad").alias("failed"))
    share = F.col("failed") / F.col("tasks")
    return out.select(key, "tasks", "failed", r6(1 - share).alias("success_share"), (F.col("failed") > 0).alias("fails_fast"), (F.col("failed") == F.col("tasks")).alias("best_effort_fails"), (share > threshold).alias("over_threshold"))


def agent_states(rows: DataFrame, agent: str, time_col: str, failed: Column, idle_seconds: int, as_of: Column | None = None) -> DataFrame:
    """Each agent's steps, age and status: ``expired`` when idle too long, else ``failed`` after a failed last step, else ``active``."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = with_newest(rows, time_col)
    stats = known.groupBy(agent).agg(F.count(F.lit(1)).alias("steps"), F.min(micros(time_col)).alias("a"), F.max(micros(time_col)).alias("z"), F.max(micros("newest")).alias("now"), F.max_by(failed, micros(time_col)).alias("bad"))
    idle = (F.col("now") - F.col("z")) / 1e6
    status = F.when(idle > idle_seconds, "expired").when(F.col("bad"), "failed").otherwise("active")
    return stats.select(agent, "steps", r6((F.col("z") - F.col("a")) / 1e6).alias("lifetime"), r6((F.col("now") - F.col("a")) / 1e6).alias("age"), status.alias("status"))


def agent_summary(states: DataFrame) -> DataFrame:
    """By status: agents, mean steps and lifetime, oldest age."""
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("agents"), r6(F.avg("steps")).alias("mean_steps"), r6(F.avg("lifetime")).alias("mean_lifetime"), r6(F.max("age")).alias("oldest"))


def cycle_stats(cycles: DataFrame) -> DataFrame:
    """Cycles, their mean, largest and smallest length, and loops of one node."""
    return cycles.agg(F.count(F.lit(1)).alias("cycles"), r6(F.avg("length")).alias("mean_length"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.count_if(F.col("length") == 1).alias("loops"))


def session_stats(rows: DataFrame, session: str, item: str, kind: str, tokens: Column) -> DataFrame:
    """Per session and (session null) in all: rows, distinct items and kinds, tokens."""
    return rows.rollup(session).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("items"), F.count_distinct(kind).alias("kinds"), F.sum(tokens).alias("tokens"))


def outcome_counts(rows: DataFrame, action: Column, recovered: Column) -> DataFrame:
    """Per action: how often it was taken and how often it led to a recovery."""
    return rows.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("taken"), F.count_if(recovered).alias("recovered"))


def health(rows: DataFrame, key: str, time_col: str, failed: Column, hours: int = 24) -> DataFrame:
    """Per key over its last hours: progress in percent, span in minutes, and ``healthy``, ``degraded`` (5 % failures or more) or ``unhealthy`` (20 % or more)."""
    share = F.count_if(failed) / F.count(F.lit(1))
    span = (F.max(F.unix_micros(F.col(time_col).cast("timestamp"))) - F.min(F.unix_micros(F.col(time_col).cast("timestamp")))) / 6e7
    status = F.when(share >= 0.2, "unhealthy").when(share >= 0.05, "degraded").otherwise("healthy")
    return recent(rows, time_col, hours).groupBy(key).agg(F.count(F.lit(1)).alias("n"), r6(100 * (1 - share)).alias("progress"), r6(span).alias("minutes"), status.alias("status"))


def resources(rows: DataFrame, group: str, used: str, limit: float, guard: float = 0.8) -> DataFrame:
    """Per group and (null) in all: total use, what is left of the limit, and whether more is admitted (use up to ``guard`` of it)."""
    total = F.sum(used)
    return rows.rollup(group).agg(r6(total).alias("used"), r6(F.greatest(F.lit(limit) - total, F.lit(0.0))).alias("available"), (total <= guard * limit).alias("admitted"))


def retry_delay(attempt: Column, base: float, factor: float, most: float, least: float = 100.0) -> Column:
    """Milliseconds before a retry: the base grown by the factor for each attempt (from 0), within bounds; no jitter."""
    return F.greatest(F.lit(least), F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most)))


def handled(value: Column, failed: Column, strategy: str, fallback: Column | None = None) -> Column:
    """A row's value under a strategy for errors: ``fail`` raises, ``continue`` gives null, ``fallback`` another value."""
    if strategy == "fail":
        return F.when(failed, F.raise_error(F.lit("a step failed")).cast("double")).otherwise(value)
    return F.when(failed, fallback if strategy == "fallback" else F.lit(None)).otherwise(value)


def alerts(events: DataFrame, channels: DataFrame, severity: Column, time_col: str, tie: str) -> DataFrame:
    """Events for each channel (``channel, least, per_hour``; a small table) whose severity reaches its ``least``, ``per_hour`` of them in an hour at most."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)
    meant = events.withColumn("severity", severity).join(F.broadcast(channels), rank(F.col("severity")) >= rank(F.col("least")))
    own = Window.partitionBy("channel", F.date_trunc("hour", time_col)).orderBy(time_col, tie)
    return meant.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= F.col("per_hour")).drop("_n")

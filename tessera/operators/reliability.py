"""Failures over time: circuit breakers, alert limits, recovery times, trailing windows, comparisons with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import r6
from tessera.operators.tables import order_statistics


def circuit_states(events: DataFrame, key: str, order: list[str], failed: Column, threshold: int) -> DataFrame:
    """``failures`` in a row up to each event, and ``state``: open from ``threshold`` of them on, closed by a success."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_island", F.count_if(~F.col("_failed")).over(own))
    counted = marked.withColumn("failures", F.count_if(F.col("_failed")).over(run))
    return counted.withColumn("state", F.when(F.col("failures") >= threshold, "open").otherwise("closed")).drop("_failed", "_island")


def limited_alerts(events: DataFrame, keys: list[str], time_col: str, tie: str, unit: str, most: int) -> DataFrame:
    """The first ``most`` events of each combination of keys in each ``unit`` of time."""
    own = Window.partitionBy(*keys, F.date_trunc(unit, time_col)).orderBy(time_col, tie)
    return events.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def recovery_minutes(events: DataFrame, key: str, time_col: str, tie: str, failed: Column) -> DataFrame:
    """Per key, failures, those followed by a success, and the mean minutes until the next success."""
    # read backwards, so that the frame only grows
    later = Window.partitionBy(key).orderBy(F.desc(time_col), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    back = F.last(F.when(~failed, F.col(time_col)), ignorenulls=True).over(later)
    failures = events.withColumn("_back", back).where(failed)
    micros = F.unix_micros(F.col("_back").cast("timestamp")) - F.unix_micros(F.col(time_col).cast("timestamp"))
    return failures.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.count("_back").alias("recovered"), r6(F.avg(micros / 60_000_000)).alias("minutes"))


def trailing(events: DataFrame, time_col: str, value_col: str, failed: Column, hours: int) -> DataFrame:
    """Events, failure rate in percent and mean, largest and smallest value of the last ``hours`` before the newest row."""
    newest = events.agg(F.max(time_col).alias("_newest"))  # one row
    recent = events.crossJoin(F.broadcast(newest)).where(F.col(time_col) >= F.col("_newest") - F.expr(f"interval {hours} hours"))
    return recent.agg(
        F.count(F.lit(1)).alias("n"), r6(100 * F.count_if(failed) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("failure_rate"),
        r6(F.avg(value_col)).alias("average"), r6(F.max(value_col)).alias("largest"), r6(F.min(value_col)).alias("smallest"),
    )


def nearest_percentiles(rows: DataFrame, key: str, value_col: str, shares: dict[str, float], least: int = 1) -> DataFrame:
    """Percentiles at position ``int(n * share)`` of the sorted values (0-based), not interpolated; nulls don't count. Keys with fewer than ``least`` values have none."""
    at = {name: F.least(F.floor(F.col("n") * share), F.col("n") - 1) for name, share in shares.items()}
    return order_statistics(rows, key, value_col, at).where(F.col("n") >= least).drop("n")


def against_baseline(rows: DataFrame, key: str, value_col: str, current: Column) -> DataFrame:
    """Mean value per key of the baseline rows and the current ones, and the change in percent."""
    before, after = F.avg(F.when(~current, F.col(value_col))), F.avg(F.when(current, F.col(value_col)))
    return rows.groupBy(key).agg(r6(before).alias("baseline"), r6(after).alias("current"), r6(100 * (after - before) / F.nullif(before, F.lit(0.0))).alias("change_percent"))


def until_flag(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Per key, the rows in order before the first one with the flag (a loop's ``break``)."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_stop", F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(own)).where("_stop = 0").drop("_stop")

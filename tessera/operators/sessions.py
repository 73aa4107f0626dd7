"""Ordered analytics: budgets, sessions, last rows, visit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import running_total


def budget_prefix(rows: DataFrame, key: str, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """Per key, the rows in order as long as their running total (``running``) stays within the budget."""
    totals = running_total(rows, key, order, tokens, "before")
    return totals.withColumn("running", F.col("before") + tokens).drop("before").where(F.col("running") <= budget)


def last_rows(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Per key, the first ``n`` rows of ``order`` (newest first for a retention)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def visits_so_far(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earlier visits of the same keys, as ``visits``."""
    return rows.withColumn("visits", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def gap_sessions(rows: DataFrame, key: str, time_col: str, tie: str, gap_seconds: int) -> DataFrame:
    """Sessions that end after ``gap_seconds`` without a row: number, start, end and rows."""
    own = Window.partitionBy(key).orderBy(time_col, tie)
    fresh = F.when(F.unix_micros(F.col(time_col).cast("timestamp")) - F.lag(F.unix_micros(F.col(time_col).cast("timestamp"))).over(own) > gap_seconds * 1_000_000, 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "session").agg(F.min(time_col).alias("started"), F.max(time_col).alias("ended"), F.count(F.lit(1)).alias("n"))

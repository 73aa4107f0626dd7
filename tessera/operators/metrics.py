"""Operational metrics over an event table: rollups, trends, percentiles, bottlenecks, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import order_statistics

#: Upper bounds of the cumulative duration histogram; fixed values of the exported format.
BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def r6(c: Column) -> Column:
    """``c`` rounded to six decimals as SQL over doubles does, by its double product with a million."""
    value = c.cast("double")
    millions = value * 1e6
    return F.when(F.abs(millions) < float("inf"), F.round(millions) / 1e6).otherwise(value)


def half_up(c: Column) -> Column:
    """``c`` rounded to six decimals by its shortest decimal, a half away from zero."""
    return F.round(c.cast("double"), 6)


def exact_sum(amount: Column) -> Column:
    """The sum of doubles in whatever order: by decimals where all values are below 1e18 with ten decimals at most, else by doubles."""
    told = amount.try_cast("decimal(28,10)")
    exact = F.bool_and(amount.isNull() | F.coalesce(told.cast("double") == amount, F.lit(False)))
    return F.when(exact, F.sum(told).cast("double")).otherwise(F.sum(amount))


def rollup_by(events: DataFrame, unit: str, time_col: str, value_col: str, failed: Column) -> DataFrame:
    """Count, successes, failures and sum, largest and smallest value per ``unit`` of time."""
    return events.groupBy(F.date_trunc(unit, time_col).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~failed).alias("successes"),
        F.count_if(failed).alias("failures"),
        r6(F.sum(value_col)).alias("total"),
        r6(F.max(value_col)).alias("largest"),
        r6(F.min(value_col)).alias("smallest"),
    )


def recurring_patterns(errors: DataFrame, keys: list[str], time_col: str, least: int = 3, hours: int = 24) -> DataFrame:
    """Combinations of ``keys`` seen ``least`` times or more in the ``hours`` before the newest error, with their number per hour."""
    newest = errors.agg(F.max(time_col).alias("newest"))  # one row
    recent = errors.select(*keys, time_col).crossJoin(F.broadcast(newest)).where(F.col(time_col) >= F.col("newest") - F.expr(f"interval {hours} hours"))
    return recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("per_hour", r6(F.col("n") / hours))


def top_signatures(errors: DataFrame, signature: Column, top: int) -> DataFrame:
    """The ``top`` most frequent signatures and their share in percent; ties by signature."""
    counted = errors.groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    total = errors.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).withColumn("percent", r6(100 * F.col("n") / F.col("total"))).drop("total").orderBy(F.desc("n"), "signature").limit(top)


def success_rates(events: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Success rate in percent for each combination of ``keys`` and, by rollup, for their prefixes and overall."""
    return events.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), r6(100 * F.count_if(~failed) / F.count(F.lit(1))).alias("success_rate"))


def trend(events: DataFrame, key: str, order: list[str], value_col: str) -> DataFrame:
    """Per key: peak, average, minimum, slope over the row number divided by the average, and population deviation."""
    numbered = events.select(key, value_col, *order).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("double"))
    return numbered.groupBy(key).agg(
        r6(F.max(value_col)).alias("peak"),
        r6(F.avg(value_col)).alias("average"),
        r6(F.min(value_col)).alias("lowest"),
        r6(F.regr_slope(value_col, "_i") / F.avg(value_col)).alias("growth"),
        r6(F.stddev_pop(value_col)).alias("volatility"),
    )


def value_statistics(events: DataFrame, key: str, value_col: str) -> DataFrame:
    """Mean, median, range, sample deviation and interpolated percentiles per key."""
    v, shares = F.col(value_col), {"median": 0.5, "p95": 0.95, "p99": 0.99}
    plain = events.groupBy(key).agg(F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"), r6(F.stddev_samp(v)).alias("deviation"))
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    both = {f"{name}_{side.__name__}": side(place(q)) for name, q in shares.items() for side in (F.floor, F.ceil)}
    found = order_statistics(events, key, value_col, both)
    between = lambda name, q: r6(F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (place(q) - F.floor(place(q)))).alias(name)
    placed = found.select(F.col(key).alias("of"), *[between(name, q) for name, q in shares.items()])
    return plain.join(placed, F.col(key).eqNullSafe(F.col("of")), "left").drop("of")


def cumulative_histogram(events: DataFrame, key: str, value_col: str) -> DataFrame:
    """For each key and bucket bound ``le`` (null: no bound), the values at or below it."""
    below = [F.count_if(F.col(value_col) <= b).alias(f"b{b}") for b in BUCKETS]
    wide = events.groupBy(key).agg(*below, F.count(value_col).alias("b_all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in BUCKETS] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n"))]
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.le", "r.n")


def bottlenecks(events: DataFrame, key: str, value_col: str, ladder: tuple[tuple[float, str], ...]) -> DataFrame:
    """Counts by key and severity; ``ladder`` lists thresholds from the highest down."""
    severity = F.lit(None).cast("string")
    for least, name in reversed(ladder):
        severity = F.when(F.col(value_col) >= least, name).otherwise(severity)
    return events.select(key, value_col, severity.alias("severity")).where("severity is not null").groupBy(key, "severity").agg(F.count(F.lit(1)).alias("n"), r6(F.max(value_col)).alias("worst"))

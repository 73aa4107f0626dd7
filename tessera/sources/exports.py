"""Metrics as lines of text: an exposition format, JSON, CSV and the shapes of outside systems."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import BUCKETS, cumulative_histogram


def histogram_lines(events: DataFrame, name: str, key: str, value: str, failed: Column) -> DataFrame:
    """``line``: buckets, count, sum and success rate of each operation, in the exposition format."""
    label = lambda le: F.concat(F.lit(f'{name}_bucket{{operation="'), F.col(key), F.lit('",le="'), le, F.lit('"} '), F.col("n"))
    bound = F.when(F.col("le").isNull(), "+Inf").otherwise(F.col("le").cast("long").cast("string"))
    buckets = cumulative_histogram(events, key, value).select(label(bound).alias("line"))
    stats = events.groupBy(key).agg(F.count(value).alias("c"), F.format_string("%.6f", F.sum(value)).alias("s"), F.format_string("%.6f", F.count_if(~failed) / F.count(F.lit(1))).alias("r"))
    line = lambda suffix, v: F.concat(F.lit(f'{name}_{suffix}{{operation="'), F.col(key), F.lit('"} '), v)
    rest = stats.select(F.explode(F.array(line("count", F.col("c")), line("sum", F.col("s")), line("success_rate", F.col("r")))).alias("line"))
    return buckets.unionByName(rest)


def json_lines(rows: DataFrame, kind: str) -> DataFrame:
    """``line``: a JSON object for each row with its type, nulls kept."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data")), {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: values joined by commas without quotes, nulls empty."""
    return rows.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def reshaped(rows: DataFrame, key: str, metrics: list[str], shape: str, prefix: str) -> DataFrame:
    """``metric, value, owner``: a row for each metric of a row, named as an outside system wants: ``text`` (a_b), ``dotted`` (a.b) or ``pascal`` (AB)."""
    named = {"text": lambda m: f"{prefix}_{m}", "dotted": lambda m: f"{prefix}.{m.replace('_', '.')}", "pascal": lambda m: "".join(p.capitalize() for p in f"{prefix}_{m}".split("_"))}[shape]
    values = F.array(*[F.struct(F.lit(named(m)).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(F.col(key).alias("owner"), F.explode(values).alias("x")).select("x.*", "owner").where("value is not null")


def write_text(lines: DataFrame, folder: str) -> None:
    """Writes ``line`` as text files; a job's files appear together or not at all."""
    lines.select("line").write.text(folder)


def write_timestamped(lines: DataFrame, root: str, kind: str = "json", prefix: str = "workflow_metrics", at: datetime | None = None) -> str:
    """Writes ``line`` under a name that tells the time of the export, ``<prefix>_<yyyymmdd>_<hhmmss>.<kind>``; returns the path."""
    if kind not in ("json", "csv", "prometheus"):
        raise ValueError(f"no such format: {kind}")
    path = f"{root.rstrip('/')}/{prefix}_{(at or datetime.now()):%Y%m%d_%H%M%S}.{kind}"
    write_text(lines, path)
    return path


__all__ = ["BUCKETS", "csv_lines", "histogram_lines", "json_lines", "reshaped", "write_text", "write_timestamped"]

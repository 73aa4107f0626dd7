"""Diffs, conflicts and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys added, removed or modified between two snapshots."""
    a, b = old.select(F.col(key), F.col(value).alias("before")), new.select(F.col(key), F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after", change.alias("change"))


def rule_groups(rules: DataFrame, keys: list[str], item: str, tokens: Column) -> DataFrame:
    """Groups of similar rules with their token estimate; three or fewer stay a small group."""
    return rules.groupBy(*keys).agg(F.count(item).alias("n"), F.sum(tokens).alias("tokens"), F.min(item).alias("first_rule")).withColumn("kind", F.when(F.col("n") <= 3, "small").otherwise("large"))

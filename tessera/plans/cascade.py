"""Computed fields: expressions with dependencies, added to a table level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(fields: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Fields by level, each after those it depends on; a cycle is an error that names its fields."""
    left, out = dict(fields), []
    while left:
        ready = sorted(f for f, needs in left.items() if not any(n in left for n in needs))
        if not ready:
            raise ValueError("computed fields depend on each other: " + ", ".join(sorted(left)))
        out.append(ready)
        for f in ready:
            del left[f]
    return out


def with_computed(rows: DataFrame, fields: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """``rows`` with computed fields (name to dependencies and SQL expression); one projection for each level."""
    for level in levels({f: needs for f, (needs, _) in fields.items()}):
        rows = rows.withColumns({f: F.expr(fields[f][1]) for f in level})
    return rows

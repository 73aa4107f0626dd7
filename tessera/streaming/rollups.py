"""Event-time windows, sessions and keyed state, for streams and (but for state) tables alike; late rows are bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets are kept open for late rows as long as the metrics they stand for are kept.
RETENTION = "7 days"


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = RETENTION) -> DataFrame:
    """Counts per key and window of event time."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), key, "n")


def trailing_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per key over a window that slides on by ``step``."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width, step), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), key, "n")


def sessions(events: DataFrame, time_col: str, key: str, idle: str = "3600 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions per key that end when it has been idle so long: start, end (of the idle time) and rows."""
    grouped = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, idle), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n")


def running_state(events: DataFrame, key: str, kind: str, idle_ms: int = 3_600_000) -> DataFrame:
    """A stream's state per key after each batch: rows so far, distinct kinds and the phase these make; dropped when idle (by the clock).

    A key's state is a count and its distinct kinds; rows of a key come in Arrow batches and aren't gathered.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, kinds = state.get if state.exists else (0, "")
        seen = set(kinds.split("\n")) - {""}
        for b in batches:
            n += len(b)
            seen.update(b[kind].dropna().astype(str))
        state.update((n, "\n".join(sorted(seen))))
        state.setTimeoutDuration(idle_ms)
        phase = "exploration" if n < 3 else "learning" if len(seen) < 3 else "implementation"
        yield pd.DataFrame({key: [keys[0]], "n": [n], "kinds": [len(seen)], "phase": [phase]})

    key_type = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, n long, kinds long, phase string", "n long, kinds string", "update", "ProcessingTimeTimeout")

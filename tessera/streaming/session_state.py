"""Sessions as keyed state of a stream: value, map and list state, ended by event-time timers.

Needs a state store that keeps several states a key: ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's provider (``PROVIDER``).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH, _MS = datetime(1970, 1, 1, tzinfo=UTC), timedelta(milliseconds=1)


def _ms(at: datetime) -> int:
    """Milliseconds since 1970, rounded down."""
    return ((at if at.tzinfo else at.replace(tzinfo=UTC)) - _EPOCH) // _MS


@dataclass
class Open:
    """A session so far."""

    n: int
    began: int
    last: int
    kinds: dict[str, int]
    recent: list[tuple[int, str]]

    def add(self, at: int, kind: object, most: int) -> None:
        self.n, self.began, self.last = self.n + 1, min(self.began, at), max(self.last, at)
        if kind is not None:
            self.kinds[str(kind)] = self.kinds.get(str(kind), 0) + 1
            insort(self.recent, (at, str(kind)))
            del self.recent[:-most]

    def row(self, key: tuple, closed: bool) -> Row:
        phase = "exploration" if self.n < 3 else "learning" if len(self.kinds) < 3 else "implementation"
        return Row(key=key[0], began_ms=self.began, last_ms=self.last, n=self.n, kinds=len(self.kinds), recent=",".join(k for _, k in self.recent), phase=phase, closed=closed)


class Sessions(StatefulProcessor):
    """Per key one open session: rows and span (value), rows of each kind (map), the last kinds in order (list).

    A row that comes more than ``idle_ms`` after the session's last one finds the session ended: it is given out as closed and a new one begins. A
    timer ends the session of a key that stays silent. Rows before the session's begin that the watermark still lets in widen it.
    """

    def __init__(self, time_col: str, kind: str, idle_ms: int, recent: int):
        self.time_col, self.kind, self.idle_ms, self.most = time_col, kind, idle_ms, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "n long, began long, last long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.recent = handle.getListState("recent", "at long, kind string")

    def _load(self) -> Open | None:
        """The key's open session: each state is read once a batch, not once a row."""
        span = self.span.get()
        return span and Open(*span, {k: n for (k,), (n,) in self.kinds.iterator()}, sorted(map(tuple, self.recent.get())))

    def _keep(self, one: Open, known: dict[str, int], ends: int | None) -> None:
        """``ends``: the time of the timer that the key has, if any. Each call to a state is a message to the JVM, so only what is new is sent."""
        self.span.update((one.n, one.began, one.last))
        for kind, n in one.kinds.items():
            if known.get(kind) != n:
                self.kinds.updateValue((kind,), (n,))
        if one.recent:
            self.recent.put(one.recent)
        if ends != one.last + self.idle_ms:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(one.last + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a batch's rows of a key come in no order; times and kinds alone are gathered to be put in one
        thin = sorted(((_ms(r[self.time_col]), r[self.kind]) for r in rows), key=lambda x: x[0])
        one = self._load()
        known, ends = (dict(one.kinds), one.last + self.idle_ms) if one else ({}, None)
        for at, kind in thin:
            if one and at > one.last + self.idle_ms:
                yield one.row(key, True)
                if known:
                    self.kinds.clear()
                    self.recent.clear()
                one, known = None, {}
            one = one or Open(0, at, at, {}, [])
            one.add(at, kind, self.most)
        self._keep(one, known, ends)
        yield one.row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Spark drops the timer itself
        one = self._load()
        if one:
            for state in (self.span, self.kinds, self.recent):
                state.clear()
            yield one.row(key, True)

    def close(self) -> None:
        pass


def drained(spark: SparkSession, states: DataFrame, folder: str) -> DataFrame:
    """All that a stream of session states gives out until its source is at an end, from a table in ``folder``."""
    query = states.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).outputMode("update").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{folder}/out")


def session_states(events: DataFrame, time_col: str, key: str, kind: str, idle_ms: int = 3_600_000, late: str = "10 minutes", recent: int = 5) -> DataFrame:
    """``key, began_ms, last_ms, n, kinds, recent, phase, closed``: each key's session after each batch, and once more when it has ended.

    Rows later than the watermark are dropped, rows without a time belong to no session. A restart goes on from the checkpoint; rows of a batch that is run again count once.
    """
    key_type = events.schema[key].dataType.simpleString()
    shape = f"key {key_type}, began_ms long, last_ms long, n long, kinds long, recent string, phase string, closed boolean"
    rows = events.select(key, time_col, kind).where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    return rows.groupBy(key).transformWithState(Sessions(time_col, kind, idle_ms, recent), shape, "Update", "EventTime")

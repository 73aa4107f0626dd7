"""Session state with timers over restarts and late rows; snapshots by batch, run again, with deletes."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.streaming import session_state, snapshots


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, session_state.PROVIDER)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "ts string, k string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_sessions_end_by_timer_and_outlive_a_restart(rocks, tmp_path):
    folder, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    told = []

    def run():
        """One start of the stream from its checkpoint."""
        stream = rocks.readStream.schema("ts timestamp, k string, kind string").parquet(folder)
        states = session_state.session_states(stream, "ts", "k", "kind", idle_ms=3_600_000, late="10 minutes", recent=3)
        query = states.writeStream.foreachBatch(lambda b, n: told.extend((n, r) for r in b.collect())).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return [r for _, r in told]

    feed(rocks, folder, [("2024-01-01 00:05:00", "a", "x"), ("2024-01-01 00:30:00", "a", "y"), ("2024-01-01 00:10:00", "b", "z")])
    first = {r.key: r for r in run() if not r.closed}
    assert (first["a"].n, first["a"].kinds, first["a"].recent, first["b"].n) == (2, 2, "x,y", 1)
    told.clear()
    # goes on with the state of the first start; a row before the watermark (00:20) is dropped, one after it counts
    feed(rocks, folder, [("2024-01-01 00:40:00", "a", "w"), ("2024-01-01 00:01:00", "a", "late"), ("2024-01-01 00:35:00", "a", "x")])
    second = {r.key: r for r in run() if not r.closed}
    assert (second["a"].n, second["a"].kinds, second["a"].recent, second["a"].phase) == (4, 3, "y,x,w", "implementation")
    told.clear()
    # far later rows of another key move the watermark: timers end both sessions, and a new row begins another
    feed(rocks, folder, [("2024-01-01 05:00:00", "c", "q")])
    run()
    feed(rocks, folder, [("2024-01-01 05:01:00", "c", "q"), ("2024-01-01 05:02:00", "a", "x")])
    rows = run()
    ended = {r.key: r for r in rows if r.closed}
    assert {(k, r.n) for k, r in ended.items()} == {("a", 4), ("b", 1)} and ended["a"].last_ms - ended["a"].began_ms == 35 * 60_000
    assert [r.n for r in rows if r.key == "a" and not r.closed] == [1]


class Counted:
    """A state, or all of a handle's timers, that counts the calls made to it; each is a message to the JVM."""

    def __init__(self, value=None, rows=()):
        self.value, self.rows, self.calls = value, rows, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return {"get": self.rows or self.value, "iterator": self.rows, "exists": self.value is not None}.get(name, [])

        return call


def test_a_key_costs_few_messages_and_its_rows_no_frame_each():
    sessions = session_state.Sessions("ts", "kind", 3_600_000, 3)
    sessions.handle, sessions.span, sessions.kinds, sessions.recent = Counted(), Counted(), Counted(), Counted(rows=())
    at = lambda hour: datetime(2024, 1, 1, hour, tzinfo=UTC)
    rows = list(sessions.handleInputRows(("a",), iter([Row(k="a", ts=at(h), kind=k) for h, k in ((9, "y"), (1, "x"), (9, None), (1, "x"), (5, "z"))]), None))
    assert [(r.n, r.kinds, r.recent, r.closed) for r in rows] == [(2, 1, "x,x", True), (1, 1, "z", True), (2, 1, "y", False)]
    assert sessions.handle.calls == ["registerTimer"] and sessions.span.calls == ["get", "update"] and sessions.kinds.calls == ["updateValue"] and sessions.recent.calls == ["put"]
    # the timer of a kept session is known from its span; the same end needs no new one
    began = rows[-1].began_ms
    sessions.handle, sessions.span, sessions.kinds, sessions.recent = Counted(), Counted((2, began, began)), Counted(rows=[(("y",), (1,))]), Counted(rows=[(began, "y")])
    (row,) = sessions.handleInputRows(("a",), iter([Row(k="a", ts=at(9), kind="y")]), None)
    assert (row.n, row.recent) == (3, "y,y") and sessions.handle.calls == []


def test_a_batch_run_again_changes_nothing_and_deletes_are_found(spark, tmp_path):
    folder, root, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen = []

    def poll(listing, files):
        spark.createDataFrame([(listing, p, h) for p, h in files.items()], "listing long, path string, hash string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("listing long, path string, hash string").parquet(folder)
        snapshots.watch(stream, root, mark, lambda c, n: seen.append((n, {r.path: r.change for r in c.collect()}))).awaitTermination(120)

    poll(1, {"a": "1", "b": "1", "c": "1"})
    poll(2, {"a": "1", "b": "2", "d": "1"})
    assert seen == [(0, {"a": "new", "b": "new", "c": "new"}), (1, {"b": "modified", "c": "deleted", "d": "new"})]
    state = lambda: ({r.path: r.hash for r in snapshots.current(spark, root).collect()}, sorted(map(tuple, snapshots.change_log(spark, root).collect())))
    before = state()
    assert before[0] == {"a": "1", "b": "2", "d": "1"}
    again = spark.createDataFrame([(2, p, h) for p, h in before[0].items()], "listing long, path string, hash string")
    snapshots.merge_listing(again, 1, root)  # as after a crash between the write and the commit
    assert state() == before
    snapshots.merge_listing(again.limit(0), 2, root)
    assert state() == before

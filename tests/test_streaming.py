"""Streams by readStream: late rows, sessions, keyed state."""

from pyspark.sql import functions as F

from tessera.streaming import rollups

ROWS = [("2024-01-01 00:05:00", "a", "x"), ("2024-01-01 00:50:00", "a", "y"), ("2024-01-01 03:00:00", "a", "x"), ("2024-01-01 00:10:00", "b", "z")]
LATE = [("2024-01-01 00:20:00", "a", "w"), ("2024-01-09 00:00:00", "b", "z"), ("2023-11-01 00:00:00", "b", "z")]
SCHEMA = "ts string, k string, kind string"


def run(spark, tmp_path, make, mode, name):
    """The rows that a query over two batches of files leaves in memory."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for n, rows in enumerate((ROWS, LATE)):
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ts timestamp, k string, kind string").parquet(folder)
        query = make(stream).writeStream.format("memory").queryName(f"{name}{n}").outputMode(mode).option("checkpointLocation", f"{mark}{n}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    return [r.asDict() for r in spark.table(f"{name}1").collect()]


def test_windows_count_late_rows(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: rollups.windowed_counts(s, "ts", "k"), "update", "windows")
    counts = {}
    for r in got:
        counts[str(r["started"]), r["k"]] = max(r["n"], counts.get((str(r["started"]), r["k"]), 0))
    assert counts["2024-01-01 00:00:00", "a"] == 3 and counts["2024-01-01 03:00:00", "a"] == 1 and counts["2024-01-01 00:00:00", "b"] == 1


def test_sessions_and_trailing_windows(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.k, r.n) for r in rollups.sessions(rows, "ts", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sum(r.n for r in rollups.trailing_counts(rows, "ts", "k").collect()) == 16
    got = run(spark, tmp_path, lambda s: rollups.sessions(s, "ts", "k"), "append", "sessions")
    assert {(r["k"], r["n"]) for r in got} >= {("a", 3), ("a", 1), ("b", 1)}


def test_keyed_state(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: rollups.running_state(s, "k", "kind"), "update", "state")
    last = {r["k"]: r for r in sorted(got, key=lambda r: r["n"])}
    assert (last["a"]["n"], last["a"]["kinds"], last["a"]["phase"]) == (4, 3, "implementation")
    assert (last["b"]["n"], last["b"]["kinds"], last["b"]["phase"]) == (3, 1, "learning")

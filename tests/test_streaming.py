import datetime as dt

from docloom.streaming import event_log


def events(spark, rows):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), u, k, 1.0, "{}") for i, m, u, k in rows], event_log.SCHEMA)


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_events_come_once_and_append(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, [(1, 0, 1, "a"), (2, 5, 1, "a"), (1, 0, 1, "a")]).write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        event_log.append_to(event_log.once_each(event_log.read_events(spark, source)), out, state).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2]
    events(spark, [(2, 5, 1, "a"), (3, 9, 1, "b")]).write.mode("append").parquet(source)
    event_log.append_to(event_log.once_each(event_log.read_events(spark, source)), out, state).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windows_and_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, [(1, 0, 1, "a"), (2, 5, 1, "a"), (3, 70, 1, "b"), (4, 10000, 2, "z")]).write.parquet(source)
    counted = event_log.counts_by_window(event_log.once_each(event_log.read_events(spark, source, files_per_trigger=10)))
    rows = {(r["start"].hour, r["event_type"]): r["n"] for r in run(counted, spark, "windows", "complete")}
    assert rows[0, "a"] == 2 and rows[1, "b"] == 1
    sessions = event_log.span_sessions(event_log.once_each(event_log.read_events(spark, source)))
    assert sorted(r["n"] for r in run(sessions, spark, "sessions", "complete") if r["span_id"] == 1) == [1, 2]

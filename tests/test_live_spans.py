"""Signals that come in order, late, twice and never: the stream tells what the table of all signals has."""

import datetime as dt

from docloom.operators import observe
from docloom.streaming import live_spans as live

SCHEMA = "span_id string, parent_id string, ts timestamp, signal string"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute, seconds=second)


#: Files in the order in which they come: (span, parent, minute, signal).
FILES = [
    [("a", None, 0, "new"), ("b", "a", 1, "new"), ("c", "a", 2, "new"), (None, None, 2, "new"), ("a", None, 0, "hello")],
    [("b", "a", 3, "exit"), ("d", "c", 4, "new"), ("b", "a", 3, "exit"), ("e", "d", 5, "exit")],  # e ends before its opening comes
    [("e", "d", 4, "new"), ("c", "a", 9, "drop"), ("c", "a", 8, "exit")],  # the earlier end, of two, comes later
    [("d", "c", 12, "exit"), ("f", "zz", 13, "new"), ("g", None, 14, "exit")],  # f never ends, g never opened
    [("a", None, 20, "exit"), ("h", "a", 20, "new"), ("h", "a", 20, "exit")],
]


def write(spark, path, rows):
    spark.createDataFrame([(s, p, at(m), k) for s, p, m, k in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, state, **settings):
    signals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.live_spans(signals, **settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(live.SPANS).parquet(out)


def test_stream_tells_what_the_table_has(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in FILES:
        write(spark, source, rows)
        told = run(spark, source, out, state)  # a run for each file: state outlives the stops
    assert {r["span_id"] for r in told.collect()} < {"b", "c", "d", "e", "a", "h"}  # nothing is told before it can be known
    write(spark, source, [("tick", None, 300, "new"), ("tick", None, 300, "exit")])
    told = run(spark, source, out, state)
    write(spark, source, [("tock", None, 301, "new"), ("b", "a", 3, "drop")])  # far too late
    told = run(spark, source, out, state)
    rows = [(s, p, at(m), k) for f in FILES for s, p, m, k in f]
    truth = live.spans(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in told.where("span_id NOT IN ('tick', 'tock')").collect())
    assert got == sorted(map(tuple, truth.collect())) and len(got) == 8
    by_id = {r[0]: r for r in got}
    assert by_id["c"][3:] == (at(8), "exited") and by_id["e"][2:] == (at(4), at(5), "exited")
    assert by_id["f"][4] == "lost" and by_id["g"][4] == "unopened" and by_id["h"][4] == "exited"
    depth = {r["span_id"]: r["depth"] for r in observe.with_depth(told.select("span_id", "parent_id")).collect()}
    assert {k: depth[k] for k in "abcdefgh"} == {r["span_id"]: r["depth"] for r in observe.with_depth(truth.select("span_id", "parent_id")).collect()}
    assert depth["e"] == 3 and depth["f"] == 0


def test_patience(spark, tmp_path):
    """A span is told lost after so long without a signal, and not before."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write(spark, source, [("a", None, 0, "new")])
    run(spark, source, out, state, patience_minutes=30)
    for minute, lost in ((35, set()), (60, {"a"})):
        write(spark, source, [(f"tick{minute}", None, minute, "new")])
        assert {r["span_id"] for r in run(spark, source, out, state, patience_minutes=30).where("state = 'lost'").collect()} == lost


def test_table_of_signals(spark):
    rows = [("a", "p", at(1), "new"), ("a", "q", at(0), "new"), ("a", None, at(5), "drop"), ("a", None, at(7), "exit"), ("b", None, None, "new"), (None, None, at(0), "new")]
    assert [tuple(r) for r in live.spans(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", "q", at(0), at(5), "dropped")]
    assert live.spans(spark.createDataFrame([], SCHEMA)).collect() == []

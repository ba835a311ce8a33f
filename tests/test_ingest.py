"""Files that appear while a stream is stopped and started, fails, and brings changed documents."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docloom.operators import structure
from docloom.sources import readers
from docloom.streaming import ingest


def drop(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / f".{name}", "w") as f:
        f.write(text)
    os.rename(folder / f".{name}", folder / name)


def nodes_of(documents):
    return structure.to_nodes(readers.text_elements(documents)).select("doc_id", "seq", "node_id", "type", "text")


def run(spark, tmp_path, to_nodes=nodes_of, files=None):
    query = ingest.store_stream(ingest.text_files(spark, str(tmp_path / "in"), files, "*.txt"), to_nodes, str(tmp_path / "store"), str(tmp_path / "state"))
    query.awaitTermination()


def shown(spark, tmp_path):
    rows = ingest.current_nodes(spark, str(tmp_path / "store"))
    return sorted((r["doc_id"], r["seq"], r["text"]) for r in rows.collect())


def test_stop_and_restart(spark, tmp_path):
    """What is there once stays once; new files are added; a changed document takes its former version's place."""
    assert ingest.current_nodes(spark, str(tmp_path / "store")) is None
    drop(tmp_path / "in/monday", "a.txt", "Head of a\nBody of a.")
    drop(tmp_path / "in/monday", "b.txt", "Text of b.")
    drop(tmp_path / "in/monday", "note.md", "Not a text file")
    first = [("a", 0, "Head of a"), ("a", 1, "Body of a."), ("b", 0, "Text of b.")]
    for _ in range(2):
        run(spark, tmp_path)
        assert shown(spark, tmp_path) == first
    drop(tmp_path / "in/tuesday", "a.txt", "New text of a.")
    drop(tmp_path / "in/tuesday", "c.d.txt", "Text of c.")
    run(spark, tmp_path)
    last = [("a", 0, "New text of a."), ("b", 0, "Text of b."), ("c.d", 0, "Text of c.")]
    assert shown(spark, tmp_path) == last
    drop(tmp_path / "in/wednesday", "b.txt", "\n")  # a document without nodes hides what it had
    run(spark, tmp_path)
    assert shown(spark, tmp_path) == [last[0], last[2]]
    ingest.compact(spark, str(tmp_path / "store"))
    assert shown(spark, tmp_path) == [last[0], last[2]] and len(os.listdir(tmp_path / "store/versions")) == 1
    drop(tmp_path / "in/thursday", "b.txt", "Back again.")
    run(spark, tmp_path)
    assert shown(spark, tmp_path) == [last[0], ("b", 0, "Back again."), last[2]]


def test_a_failure_between_nodes_and_entry(spark, tmp_path):
    """A batch that fails after its nodes were written doesn't show, and is there once after the restart."""
    drop(tmp_path / "in", "a.txt", "Text of a.")
    run(spark, tmp_path)
    drop(tmp_path / "in", "b.txt", "Text of b.")

    def failing(documents):
        nodes_of(documents).write.mode("overwrite").parquet(str(tmp_path / "store/nodes/batch=1"))  # as far as it came
        return nodes_of(documents).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, failing)
    assert shown(spark, tmp_path) == [("a", 0, "Text of a.")]
    run(spark, tmp_path)
    assert shown(spark, tmp_path) == [("a", 0, "Text of a."), ("b", 0, "Text of b.")]


def test_two_versions_in_one_batch_and_many_batches(spark, tmp_path):
    drop(tmp_path / "in/1", "a.txt", "First.")
    os.utime(tmp_path / "in/1/a.txt", (1_000_000, 1_000_000))
    drop(tmp_path / "in/2", "a.txt", "Second.")
    run(spark, tmp_path)
    assert shown(spark, tmp_path) == [("a", 0, "Second.")]
    for i in range(4):
        drop(tmp_path / f"in/{i + 3}", f"n{i}.txt", f"Number {i}.")
    run(spark, tmp_path, files=1)
    assert shown(spark, tmp_path) == [("a", 0, "Second."), *((f"n{i}", 0, f"Number {i}.") for i in range(4))]
    assert len(os.listdir(tmp_path / "store/versions")) >= 5

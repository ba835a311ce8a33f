"""Continuous ingest: documents that arrive as files become nodes of a store, each version of a document once.

A stream of documents is read in batches, which Spark numbers and, after a stop, gives again under the same number. A
batch's nodes are written to a folder of that number, which a repeated batch overwrites; after them the batch's
entry in the list of versions, and only batches with a whole entry count. So nothing is there twice or by half, wherever
a run is stopped. Of a document that came several times the nodes of its last version are shown, and ``compact`` drops
the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Stage = Callable[[DataFrame], DataFrame]


def text_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None, pattern: str = "*") -> DataFrame:
    """doc_id (a file's name without folders and ending), text and version (its time) of files as they appear below ``folder``.

    A file must appear whole, by a rename; a changed document is a new file of the same name in another folder. Spark
    passes over files of no bytes.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    rows = reader.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return rows.select(name.alias("doc_id"), F.decode("content", "UTF-8").alias("text"), F.struct("modificationTime", "path").alias("version"))


def store_stream(documents: DataFrame, to_nodes: Stage, path: str, checkpoint: str, version: str | None = "version", available_now: bool = True) -> StreamingQuery:
    """A stream of documents (doc_id, ...) through ``to_nodes``, a function of ordinary tables, into the store at ``path``.

    ``version`` names a column by whose order the last of a document's versions in one batch is taken; without it the
    rows of a document belong together.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if version:
            last = batch.groupBy("doc_id").agg(F.max(version).alias("_last"))
            rows = batch.join(last, "doc_id").where(F.col(version) == F.col("_last")).drop("_last", version).dropDuplicates(["doc_id"])
        to_nodes(rows).write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        batch.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    folders = [s.getPath() for s in files.listStatus(at)]
    return sorted(int(f.getName().removeprefix("batch=")) for f in folders if f.getName().startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def _read(spark: SparkSession, path: str, part: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/batch={n}" for n in batches])


def current_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """The nodes of every document's last version; None before the first batch."""
    batches = _batches(spark, path)
    if not batches:
        return None
    last = _read(spark, path, "versions", batches).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return _read(spark, path, "nodes", batches).join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, path: str) -> None:
    """One batch in the place of all whole ones: the last of them, with the current nodes. Not while the stream runs."""
    batches = _batches(spark, path)
    if len(batches) < 2:
        return
    current_nodes(spark, path).write.mode("overwrite").parquet(f"{path}/compact/nodes")
    _read(spark, path, "versions", batches).select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/compact/versions")
    # Everything is in the folder "compact" until its copy counts; the copies of older batches then hold nothing that is shown.
    for part in ("nodes", "versions"):
        spark.read.parquet(f"{path}/compact/{part}").write.mode("overwrite").parquet(f"{path}/{part}/batch={batches[-1]}")
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in [f"versions/batch={n}" for n in batches[:-1]] + [f"nodes/batch={n}" for n in batches[:-1]] + ["compact"]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{part}"), True)

"""Stores: nodes and embeddings as Parquet, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are spread over so many folders by hash; a folder per document would drown a file system.
BUCKETS = 64


def _bucket(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(BUCKETS)).cast("int")


def write_nodes(nodes: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes by bucket of their document, sorted by document inside files, so that reads by document skip the rest."""
    rows = nodes.withColumn("bucket", _bucket())
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(16))).sortWithinPartitions("bucket", "doc_id").write.mode(mode).partitionBy("bucket").parquet(path)


write_embeddings = write_nodes


def read_nodes(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """All nodes, or those of the named documents: only their folders are listed."""
    rows = spark.read.parquet(path)
    if doc_ids is not None:
        ids = spark.createDataFrame([(d,) for d in doc_ids], rows.select("doc_id").schema)
        buckets = [r[0] for r in ids.select(_bucket()).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("doc_id").isin(doc_ids))
    return rows.drop("bucket")


def lookup(nodes: DataFrame, ids: DataFrame, on: str = "node_id") -> DataFrame:
    """The nodes with the given ids, once each."""
    return nodes.join(ids.select(on).distinct(), on, "left_semi")


def append_messages(messages: DataFrame, path: str) -> None:
    """Append (conv_id, turn, role, content) to a chat log."""
    messages.select("conv_id", "turn", "role", "content").write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("conv_id", "turn")

"""Dense, sparse and hybrid retrieval, and the hierarchy steps on result lists.

Results are rows (query_id, node_id, score, rank). Everything is batched over queries.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import dense_index, sparse_index
from docloom.operators.fusion import fuse, ranked
from docloom.session import materialise, new_path


#: Two threads of an application that miss the same index make it once.
_BUILDING = Lock()


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "node_id", vector_col: str = "embedding", skip_own: bool = False, index: str | None = None) -> DataFrame:
    """The ``k`` nearest by cosine of every query (query_id, query_vec), exact.

    They come from the stored index at the path ``index``; if it isn't there yet, or without a path, one is made of
    ``vectors`` first. Vectors that are null or zero, or hold what isn't a finite number, don't match.
    """
    spark = queries.sparkSession
    path = index or new_path(spark, "dense-index")
    with _BUILDING:
        if not dense_index.exists(spark, path):
            dense_index.build(vectors, path, id_col, vector_col)
    return dense_index.Search(spark, path, queries, k, skip_own).result


def bm25_top_k(nodes: DataFrame, queries: DataFrame, k: int, id_col: str = "node_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """The ``k`` best nodes by BM25 of every query (query_id, query_text), exact.

    They come from the stored index at the path ``index``; if it isn't there yet, or without a path, one is made of
    ``nodes`` first.
    """
    spark = queries.sparkSession
    path = index or new_path(spark, "sparse-index")
    with _BUILDING:
        if not sparse_index.exists(spark, path):
            sparse_index.append(nodes, path, id_col, text_col)
    return sparse_index.top_k(spark, path, queries, k)


def fill_gaps(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with the node between two neighbours in the list that lie on both sides of it in the document.

    ``nodes`` has node_id, prev_id and next_id. The node gets the mean of both scores and the place between them.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    known = results.join(nodes.select("node_id", "prev_id", "next_id"), "node_id")
    pairs = known.withColumn("middle", F.when(F.col("next_id") == F.lead("prev_id").over(order), F.col("next_id"))).withColumn("after", F.lead("score").over(order))
    zero = F.lit(0.0)
    added = pairs.where(F.col("middle").isNotNull()).select("query_id", F.col("middle").alias("node_id"), ((F.coalesce("score", zero) + F.coalesce("after", zero)) / 2).alias("score"), (F.col("rank") + 0.5).alias("place"))
    added = added.join(results.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").dropDuplicates(["query_id", "node_id"])
    whole = results.select("query_id", "node_id", "score", F.col("rank").cast("double").alias("place")).unionByName(added)
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).drop("place")


def merge_up(results: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Results in which a parent takes the place of its children, if more than ``threshold`` of them are there.

    A parent gets the mean score of the children found (null counts 0) and comes after what stays; if it was there
    itself it isn't listed twice.
    """
    with_parent = results.join(nodes.select("node_id", "parent_id"), "node_id", "left")
    found = with_parent.where(F.col("parent_id").isNotNull()).groupBy("query_id", "parent_id").agg(F.count("*").alias("there"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    children = nodes.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("all"))
    parents = found.join(children, "parent_id", "left").where(F.col("there") / F.coalesce("all", F.lit(1)) > threshold)
    parents = parents.select("query_id", F.col("parent_id"), "mean")
    stay = with_parent.join(parents.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti").select("query_id", "node_id", "score", F.col("rank").cast("double").alias("place"))
    new = parents.join(stay.select("query_id", F.col("node_id").alias("parent_id")), ["query_id", "parent_id"], "left_anti")
    new = new.select("query_id", F.col("parent_id").alias("node_id"), F.col("mean").alias("score"), F.lit(1e18).alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", F.desc("score"), "node_id")
    return stay.unionByName(new).withColumn("rank", F.row_number().over(order)).drop("place")


def settle(results: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Gaps filled and children merged until nothing changes, sorted by score. Lists hold at most a few rows a query.

    A round that changes anything adds a node between two others or replaces children by their parent, of which there
    are finitely many; a state that comes again after others is an error.
    """
    nodes = materialise(nodes.select("node_id", "parent_id", "prev_id", "next_id"), "hierarchy")
    now = materialise(results.select("query_id", "node_id", F.col("score").cast("double"), F.col("rank").cast("int")), "results")
    states: list = []
    while True:
        now = materialise(merge_up(fill_gaps(now, nodes), nodes, threshold), "results")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("query_id", "node_id").cast("decimal(38,0)"))).first()
        if states and state == states[-1]:
            return ranked(now)
        if state in states:
            raise ValueError("gap fill and merge-up undo each other")
        states.append(state)


def retrieve(nodes: DataFrame, vectors: DataFrame, queries: DataFrame, dense_k: int = 10, sparse_k: int = 6, fused_k: int = 10, weight: float = 0.6, threshold: float = 0.5) -> DataFrame:
    """Hybrid retrieval: dense and sparse lists fused, then settled in the hierarchy of ``nodes``.

    ``nodes`` has node_id, text, parent_id, prev_id and next_id; ``queries`` query_id, query_text and query_vec.
    """
    dense = dense_top_k(vectors, queries, dense_k)
    sparse = bm25_top_k(nodes, queries, sparse_k)
    return settle(fuse(dense, sparse, weight, fused_k), nodes, threshold)

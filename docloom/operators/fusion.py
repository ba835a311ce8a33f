"""Score fusion of two result lists (query_id, node_id, score), keyed by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are ranked after rounding, so that ties don't hang on the last bits of a sum.
DIGITS = 6


def ranked(rows: DataFrame, score: str = "score", ties: tuple[str, ...] = ("node_id",), group: str = "query_id") -> DataFrame:
    """With ``rank`` from 1, best score first, nulls last."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), *ties)
    return rows.withColumn("rank", F.row_number().over(order))


def scaled(rows: DataFrame, distribution: bool) -> DataFrame:
    """Scores in their list's band: mean less and plus three deviations, or least to greatest. A flat list stays."""
    clean = rows.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    mean, deviation = F.avg("score"), F.stddev_pop("score")
    low, high = (mean - 3 * deviation, mean + 3 * deviation) if distribution else (F.min("score"), F.max("score"))
    bands = clean.groupBy("query_id").agg(low.alias("low"), high.alias("high"))
    inside = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    return clean.join(bands, "query_id").withColumn("score", F.when(F.round("high", 12) > F.round("low", 12), inside).otherwise(F.col("score"))).drop("low", "high")


def fuse(a: DataFrame, b: DataFrame, weight: float = 0.5, top_k: int = 5, distribution: bool = True) -> DataFrame:
    """query_id, node_id, score and rank of the ``top_k`` by ``weight`` times a's and the rest times b's score.

    A side that lacks a node counts 0. Of equal scores those of ``a`` come first, in its order, then b's.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie between 0 and 1")
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    left = ranked(scaled(a, distribution)).select("query_id", "node_id", F.col("score").alias("a"), F.col("rank").alias("a_rank"))
    right = ranked(scaled(b, distribution)).select("query_id", "node_id", F.col("score").alias("b"), F.col("rank").alias("b_rank"))
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w)
    both = left.join(right, ["query_id", "node_id"], "full_outer")
    both = both.withColumn("score", F.round(part("a", weight) + part("b", 1 - weight), DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("a_rank"), F.asc_nulls_last("b_rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "node_id", "score", "rank")


def linear(a: Column, b: Column, weight: float) -> Column:
    return F.lit(weight) * a + F.lit(1 - weight) * b

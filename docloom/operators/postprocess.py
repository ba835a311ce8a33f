"""Steps between retrieval and synthesis: cutoff, reranking, sentence pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.sentences import sentences
from docloom.functions.text import tokens
from docloom.operators.fusion import DIGITS, ranked

Step = Callable[[DataFrame], DataFrame]


def similarity_cutoff(results: DataFrame, least: float = 0.01) -> DataFrame:
    """Results of at least that score; null scores go."""
    return results.where(F.col("score") >= least)


def overlap(query: Column, text: Column) -> Column:
    """Shared distinct tokens over the geometric mean of both counts: the built-in stand-in for a cross-encoder."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b).cast("double")), DIGITS)).otherwise(0.0)


def rerank(results: DataFrame, top_n: int = 3, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The ``top_n`` results (with query_text and text) by the scorer."""
    return ranked(results.withColumn("score", scorer(F.col("query_text"), F.col("text")))).where(F.col("rank") <= top_n)


def prune_sentences(results: DataFrame, keep: float = 0.2, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """Texts cut down to the share of sentences that are most like the query, at least one, in their order."""
    each = results.select("query_id", "node_id", "query_text", F.posexplode_outer(sentences("text")).alias("n", "s")).where(F.col("s").isNotNull())
    each = each.withColumn("likeness", scorer(F.col("query_text"), F.col("s.text")))
    group = Window.partitionBy("query_id", "node_id")
    each = each.withColumn("at", F.row_number().over(group.orderBy(F.desc("likeness"), "n"))).withColumn("all", F.count("*").over(group))
    kept = each.where(F.col("at") <= F.greatest(F.lit(1), F.floor(F.col("all") * keep)))
    texts = kept.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("s.text").alias("text")))).alias("kept"))
    texts = texts.select("query_id", "node_id", F.array_join(F.transform("kept", lambda x: x["text"]), " ").alias("pruned"))
    return results.join(texts, ["query_id", "node_id"], "left").withColumn("text", F.coalesce("pruned", "text")).drop("pruned")


def apply_steps(results: DataFrame, steps: list[Step] | None) -> DataFrame:
    for step in steps or []:
        results = step(results)
    return results

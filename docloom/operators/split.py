"""Splitting texts: sentence windows, semantic groups, and packing of contexts into budgets."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.sentences import sentences
from docloom.operators.fusion import DIGITS
from docloom.session import materialise, shipped

DIM = 64


TOKEN = re.compile(r"\w+")


def hashed_vector(text: str) -> np.ndarray:
    """Tokens of a text hashed into DIM signed counts."""
    hashes = np.array([zlib.crc32(token.encode()) for token in TOKEN.findall(text.lower())], np.int64)
    return np.bincount(hashes % DIM, np.where(hashes >> 16 & 1, 1.0, -1.0), DIM) if len(hashes) else np.zeros(DIM)


@shipped
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The built-in embedder, see ``hashed_vector``. A model goes in its place where there is one."""
    for batch in texts:
        yield pd.Series([hashed_vector(text or "") for text in batch])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(sentences(text_col)).alias("n", "s")).where(F.col("s").isNotNull())
    return rows.select("doc_id", "n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def sentence_windows(docs: DataFrame, around: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence with its own text and the text of so many sentences around it."""
    near = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-around, around)
    return sentence_rows(docs, id_col, text_col).select("doc_id", "n", F.col("text").alias("original_text"), F.array_join(F.collect_list("text").over(near), " ").alias("window"))


def summed(vectors: Column) -> Column:
    """The sum of an array of vectors."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), F.size(F.get(vectors, F.lit(0)))), lambda total, v: F.zip_with(total, v, lambda x, y: x + y))


def semantic_groups(docs: DataFrame, around: int = 3, percentile: float = 0.95, embedder: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group, text: runs of sentences, broken where neighbourhoods differ more than usual in the document.

    The built-in embedder counts tokens, so a neighbourhood's vector is the sum of its sentences' vectors, each made
    once. Any other embedder gets the neighbourhoods' texts. Distances are written once.
    """
    rows = sentence_rows(docs, id_col, text_col)
    order = Window.partitionBy("doc_id").orderBy("n")
    near = order.rowsBetween(-around, around)
    if embedder is None:
        rows = rows.withColumn("own", hashed_embedding("text")).withColumn("v", summed(F.collect_list("own").over(near))).drop("own")
    else:
        rows = rows.withColumn("v", embedder(F.array_join(F.collect_list("text").over(near), " ")))
    rows = rows.withColumn("distance", F.round(1 - cosine(F.lag("v").over(order), F.col("v")), DIGITS))
    rows = materialise(rows.select("doc_id", "n", "text", "distance"), "sentence-distances")
    limits = rows.groupBy("doc_id").agg(F.percentile("distance", F.lit(percentile)).alias("limit"))
    rows = rows.join(limits, "doc_id").withColumn("group", F.sum(F.when(F.col("distance") > F.col("limit"), 1).otherwise(0)).over(order))
    out = rows.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("s"))
    return out.select("doc_id", "group", F.size("s").alias("n_sentences"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def packs(lengths: Column, budget: int) -> Column:
    """The pack of each context when they are packed greedily, in order, into budgets; an oversized one is alone."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("pack"), F.array().cast("array<int>").alias("out"))

    def add(s: Column, n: Column) -> Column:
        fits = (s["pack"] >= 0) & (s["used"] + n <= budget)
        pack = F.when(fits, s["pack"]).otherwise(s["pack"] + 1)
        return F.struct(F.when(fits, s["used"] + n).otherwise(n.cast("long")).alias("used"), pack.alias("pack"), F.concat(s["out"], F.array(pack)).alias("out"))

    return F.aggregate(lengths, start, add, lambda s: s["out"])


def compact(contexts: DataFrame, budget: int = 4096) -> DataFrame:
    """query_id, pack, context: result texts (query_id, rank, text) joined up to ``budget`` characters a pack."""
    lists = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    lists = lists.withColumn("p", packs(F.transform("c", lambda x: F.length(x["text"])), budget))
    each = lists.select("query_id", F.explode(F.arrays_zip("c", "p")).alias("z"))
    grouped = each.groupBy("query_id", F.col("z.p").alias("pack")).agg(F.array_sort(F.collect_list("z.c")).alias("m"))
    return grouped.select("query_id", "pack", F.size("m").alias("n_contexts"), F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("context"))

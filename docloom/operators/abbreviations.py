"""Abbreviations of a corpus, learnt from how words and dots go together, and sentences that know them.

A word that nearly always has a dot behind it, more often than dots follow words in general, is short, has dots inside, or
seldom stands without one, is an abbreviation (Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection,
2006: the log-likelihood ratio of word and dot, times factors of length, inner dots and occurrences without a dot). No
language is named and no list is needed, so texts in several languages are learnt from together.

All counts are DataFrame aggregates over whole texts, combined before they are shuffled, a row for each different word.
What is learnt goes to the tasks that split texts, at most ``MOST`` words of the highest scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.sentences import SENTENCES, UNFINISHED, split_sentences
from docloom.session import shipped

#: Fixed values of the method: the chance of a dot behind an abbreviation, and the least score of one.
LIKELY, LEAST_SCORE = 0.99, 0.3
#: Words that are learnt at most.
MOST = 10_000
#: A word: letters, with dots between them, and perhaps one behind.
WORD = r"\p{L}+(?:\.\p{L}+)*\.?"


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """word (lower case, without its last dot), dotted, plain: how often it has a dot behind it and how often not."""
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0))).alias("token"))
    dotted = F.col("token").endswith(".")
    word = F.lower(F.when(dotted, F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token")))
    counted = words.select(word.alias("word"), dotted.cast("long").alias("dotted"))
    return counted.groupBy("word").agg(F.sum("dotted").alias("dotted"), F.sum(1 - F.col("dotted")).alias("plain"))


def abbreviations(texts: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """word, dotted, plain, score: the words that are abbreviations in these texts."""
    counts = word_counts(texts, text_col)
    total = counts.agg(F.coalesce(F.sum("dotted"), F.lit(0)).alias("dots"), F.coalesce(F.sum(F.col("dotted") + F.col("plain")), F.lit(0)).alias("words")).first()
    if not 0 < total["dots"] < total["words"]:
        return counts.limit(0).withColumn("score", F.lit(0.0))
    usual = total["dots"] / total["words"]
    chance = lambda p: F.col("dotted") * F.log(F.lit(p)) + F.col("plain") * F.log(F.lit(1 - p))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    score = -2 * (chance(usual) - chance(LIKELY)) * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("plain").cast("double"))
    return counts.where("dotted > 0").withColumn("score", F.round(score, 6)).where(F.col("score") >= least)


def learnt(found: DataFrame, most: int = MOST) -> frozenset[str]:
    """The words of the highest scores, for ``sentences``."""
    return frozenset(r["word"] for r in found.orderBy(F.desc("score"), "word").limit(most).select("word").collect())


@shipped
def sentences(text: Column | str, known: frozenset[str]) -> Column:
    """Sentences (start, end, text) of texts whose abbreviations are ``known``, besides the built-in ones."""
    unfinished = UNFINISHED | known

    @F.pandas_udf(SENTENCES)
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if x is None else [{"start": a, "end": z, "text": t} for a, z, t in split_sentences(x, unfinished)] for x in batch])

    return split(text)


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, start, end, text of every sentence, by the abbreviations of these documents themselves."""
    known = learnt(abbreviations(docs, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(sentences(text_col, known)).alias("n", "s")).where(F.col("s").isNotNull())
    return rows.select("doc_id", "n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))

"""Metadata of nodes and documents: patterns, keywords and summaries, by pluggable functions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas as S
from docloom.functions.keywords import STOPWORDS, keywords_function
from docloom.functions.sentences import split_sentences
from docloom.session import materialise, shipped

Adder = Callable[[DataFrame], DataFrame]


def adder(name: str, value: Callable[[], Column]) -> Adder:
    """Sets the column ``name``; where the value is null, what was there stays."""

    def add(rows: DataFrame) -> DataFrame:
        before = F.col(name) if name in rows.columns else F.lit(None)
        return rows.withColumn(name, F.coalesce(value(), before))

    return add


def add_all(rows: DataFrame, adders: list[Adder]) -> DataFrame:
    for add in adders:
        rows = add(rows)
    return rows


def pattern_adder(name: str, pattern: str, mode: str = "findall", text_col: str = "text") -> Adder:
    """``findall``: all matches; ``contains``: whether there is one; ``match``: whether the text starts with one."""
    text = F.col(text_col)
    values = {
        "findall": lambda: F.regexp_extract_all(text, F.lit("(" + pattern + ")"), F.lit(1)),
        "contains": lambda: text.rlike(pattern),
        "match": lambda: text.rlike("^(?:" + pattern + ")"),
    }
    return adder(name, values[mode])


def keyword_adder(top: int | None = 5, text_col: str = "text") -> Adder:
    return adder("keywords", lambda: keywords_function(top)(F.col(text_col)))


def document_keywords(nodes: DataFrame) -> DataFrame:
    """The distinct keywords of all nodes of a document, sorted; empty ones are left out."""
    # The outer form: for the inner one the optimizer would compute the keywords twice, once to filter on their number.
    each = nodes.select("doc_id", F.explode_outer("keywords").alias("k")).where(F.col("k") != "")
    return each.groupBy("doc_id").agg(F.array_sort(F.collect_set("k")).alias("keywords"))


def key_sentences(texts: list[str], most: int) -> str:
    """The sentences with the highest mean word weight, in their order: the built-in summariser."""
    found = [s for t in texts for _, _, s in split_sentences(t)]
    words = [[w for w in re.findall(r"\w+", s.lower()) if w not in STOPWORDS] for s in found]
    weight = Counter(w for ws in words for w in set(ws))
    score = [sum(1 + math.log(weight[w]) for w in set(ws)) / (3 + len(ws)) for ws in words]
    best = sorted(sorted(range(len(found)), key=lambda i: (-score[i], i))[:most])
    return " ".join(found[i] for i in best)


def summariser(most: int = 3) -> Callable[[Column], Column]:
    """An Arrow function from an array of texts to a summary."""

    @shipped
    @F.pandas_udf(T.StringType())
    def summary(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in groups:
            yield pd.Series([key_sentences([t for t in texts if t], most) for texts in batch], dtype="object")

    return summary


def tree_summary(nodes: DataFrame, summarise: Callable[[Column], Column] | None = None, width: int = 10) -> DataFrame:
    """doc_id, summary, summary_oneline: groups of ``width`` nodes are summarised, then groups of as many summaries, level
    by level until a document has one.

    A group is what one task must hold, so no row is larger than ``width`` texts, however long a document is. A document
    that has its summary takes no part in further levels.
    """
    if width < 2:
        raise ValueError("a group has two members at least")
    summarise = summarise or summariser(3)
    level = nodes.where(F.length("text") > 0).select("doc_id", F.floor(F.col("seq") / width).alias("g"), F.col("seq").alias("at"), F.col("text").alias("s"))
    done: DataFrame | None = None
    while True:
        groups = level.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("m"))
        made = materialise(groups.select("doc_id", F.col("g").alias("at"), summarise(F.transform("m", lambda x: x["s"])).alias("s")), "summaries")
        sizes = made.groupBy("doc_id").agg(F.count("*").alias("n"))
        single = made.join(sizes.where("n = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("s").alias("summary"))
        done = single if done is None else done.union(single)
        left = made.join(sizes.where("n > 1").select("doc_id"), "doc_id", "left_semi")
        if not left.limit(1).count():
            return materialise(done, "tree-summaries").withColumn("summary_oneline", summariser(1)(F.array("summary")))
        level = materialise(left.withColumn("g", F.floor(F.col("at") / width)), "summary-level")


def table_summaries(nodes: DataFrame, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``table_summary`` of text nodes that are tables with text."""
    wanted = F.col("table_html").isNotNull() & (F.length("text") > 0)
    plain = F.regexp_replace(F.regexp_replace("text", "</t[dh]>", ". "), "<[^>]*>", " ")
    return nodes.withColumn("table_summary", F.when(wanted, (summarise or summariser(2))(F.array(plain))))


def image_summaries(nodes: DataFrame, caption: Callable[[Column], Column], least_width: int = 70) -> DataFrame:
    """``image_summary`` by a captioner of the bytes, for pictures that are wide enough to show something."""
    wanted = F.col("image").isNotNull() & (F.col("image_width") >= least_width)
    return nodes.withColumn("image_summary", F.when(wanted, caption(F.col("image"))))


def composite_image_summaries(parts: DataFrame) -> DataFrame:
    """Per parent its parts' image summaries, joined in order; none gives null."""
    lists = parts.where(F.col("image_summary").isNotNull()).groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("part", "image_summary"))).alias("m"))
    return lists.select("doc_id", "parent_id", F.nullif(F.array_join(F.transform("m", lambda x: x["image_summary"]), ""), F.lit("")).alias("image_summary"))


def named(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes with the name of their document."""
    return nodes.join(documents.select("doc_id", "name"), "doc_id", "left")


def text_bearing(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.length("text") > 0) & (F.col("type") != S.IMAGE))

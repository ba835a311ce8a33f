"""Citations: sentences of a response aligned with the passages from which they come."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.fuzzy import alignment, indel_similarity, partial_similarity
from docloom.functions.sentences import sentences
from docloom.operators.fusion import fuse
from docloom.session import shipped

THRESHOLD, SNIPPET, CITED, CONSIDERED = 70.0, 128, 3, 5
#: A fixed value: what stands on both sides of a quote.
FENCE = "|||||"


def nearest_whitespace(text: str, index: int, right_to_left: bool = False) -> int:
    """The last white space strictly before ``index`` or 0; else the first at or after it or the length."""
    if not 0 <= index < len(text):
        raise IndexError(index)
    if right_to_left:
        return next((i for i in range(index - 1, -1, -1) if text[i].isspace()), 0)
    return next((i for i in range(index, len(text)) if text[i].isspace()), len(text))


def tagged(response: str, marks: list[tuple[int, int, int]]) -> str:
    """The response with `` [n] `` at the white space left of each quote; marks are (n, sentence start, quote start)."""
    out, at = [], 0
    for n, sentence, quote in sorted(marks, key=lambda m: m[0]):
        place = sentence if quote <= sentence else max(sentence, nearest_whitespace(response, quote, True))
        out += [response[at:place], f" [{n}] "]
        at = place
    return "".join(out) + response[at:]


def word_start(text: str, index: int) -> int:
    """Where the word that holds ``index`` begins."""
    while index > 0 and not text[index - 1].isspace():
        index -= 1
    return index


def word_end(text: str, index: int) -> int:
    """The first white space at or after ``index``, or the length."""
    while index < len(text) and not text[index].isspace():
        index += 1
    return index


def snippet(text: str, start: int, end: int, length: int = SNIPPET) -> str:
    """The matched span, widened to whole words and fenced, with about ``length`` characters in all around it, cut at white space."""
    margin = max(0, round((length - (end - start)) / 2))
    quote, quote_end = word_start(text, start), word_end(text, end)
    a, z = word_start(text, max(0, quote - margin)), word_end(text, min(len(text), quote_end + margin))
    return (text[a:quote] + FENCE + text[quote:quote_end] + FENCE + text[quote_end:z]).strip()


@shipped
@F.pandas_udf(T.StringType())
def tagged_response(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for response, marks in columns:
        yield pd.Series([r if r is None or m is None else tagged(r, [(x["tag"], x["sentence_start"], x["quote_start"]) for x in m]) for r, m in zip(response, marks)], dtype="object")


@shipped
@F.pandas_udf(T.StringType())
def cited_snippet(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, start, end in columns:
        yield pd.Series([snippet(t, int(s), int(e)) for t, s, e in zip(text, start, end)], dtype="object")


def citable(sources: DataFrame) -> DataFrame:
    """Sources with a text and something known about them; of equal texts in a query the best-ranked one."""
    known = sources.where((F.length("text") > 0) & (F.coalesce(F.size("extra"), F.lit(0)) > 0)) if "extra" in sources.columns else sources.where(F.length("text") > 0)
    first = Window.partitionBy("query_id", "text").orderBy("rank", "node_id")
    return known.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def cited_nodes(responses: DataFrame, sources: DataFrame, threshold: float = THRESHOLD, weight: float = 0.85) -> DataFrame:
    """The passages that a response draws on: fuzzy likeness fused with the retrieval score."""
    pairs = responses.join(citable(sources), "query_id").withColumn("likeness", partial_similarity("response", "text", max(10.0, threshold - 10)))
    order = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "rank")
    near = pairs.where(F.col("likeness") >= max(10.0, threshold - 10)).withColumn("at", F.row_number().over(order)).where(F.col("at") <= CONSIDERED)
    fuzzy = near.select("query_id", "node_id", F.col("likeness").alias("score"))
    retrieved = near.select("query_id", "node_id", F.col("score").cast("double"))
    return fuse(fuzzy, retrieved, weight, CITED)


def alignments(responses: DataFrame, sources: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per sentence of a response its best passage, with spans in both texts as they are; the earliest of equal ones."""
    each = responses.select("query_id", F.posexplode_outer(sentences("response")).alias("sentence_no", "s")).where(F.col("s").isNotNull())
    # Sentences are few bytes and much work: dealt out before they meet their sources.
    each = each.repartition(responses.sparkSession.sparkContext.defaultParallelism, "query_id", "sentence_no")
    pairs = each.join(citable(sources).select("query_id", "node_id", "rank", "text"), "query_id")
    found = pairs.withColumn("a", alignment("s.text", "text", threshold)).where((F.col("a.score") >= threshold) & (F.col("a.sent_end") > F.col("a.sent_start")) & (F.col("a.node_end") > F.col("a.node_start")))
    part = lambda c, a, z: F.substring(c, F.col(a) + 1, F.col(z) - F.col(a))
    quote = part("s.text", "a.sent_start", "a.sent_end")
    likeness = indel_similarity(part("text", "a.node_start", "a.node_end"), quote)
    found = found.withColumn("score", F.round(likeness * F.length(quote) / F.length("s.text"), 6))
    best = Window.partitionBy("query_id", "sentence_no").orderBy(F.desc("score"), "rank", "node_id")
    found = found.where(F.col("score") > 0).withColumn("best", F.row_number().over(best)).where("best = 1")
    return found.select("query_id", "sentence_no", "node_id", F.col("s.start").alias("sentence_start"), (F.col("s.start") + F.col("a.sent_start")).alias("quote_start"), (F.col("s.start") + F.col("a.sent_end")).alias("quote_end"), F.col("a.node_start").alias("node_start"), F.col("a.node_end").alias("node_end"), "score")


def citations(responses: DataFrame, sources: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, tag, node_id, snippet: the numbered citations of each response, from 0 in order of its sentences."""
    found = alignments(responses, sources, threshold)
    found = found.withColumn("tag", F.row_number().over(Window.partitionBy("query_id").orderBy("sentence_no")) - 1)
    texts = sources.select("query_id", "node_id", "text", *[c for c in ("name", "page_numbers") if c in sources.columns])
    texts = texts.dropDuplicates(["query_id", "node_id"])
    shown = cited_snippet("text", "node_start", "node_end")
    if "name" in texts.columns:
        shown = F.concat(shown, F.lit(" ("), F.coalesce("name", F.lit("unnamed")), F.lit(")"))
    if "page_numbers" in texts.columns:
        shown = F.concat(shown, F.when(F.size("page_numbers") > 0, F.concat(F.lit(" p. "), F.array_join(F.col("page_numbers").cast("array<string>"), ", "))).otherwise(""))
    return found.join(texts, ["query_id", "node_id"]).withColumn("snippet", shown).drop("text")


def cite(responses: DataFrame, sources: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, response with tags, citations; a response without any stays as it is."""
    found = citations(responses, sources, threshold)
    marks = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("tag", "sentence_start", "quote_start"))).alias("marks"),
        F.array_sort(F.collect_list(F.struct("tag", "node_id", "snippet", "score"))).alias("citations"),
    )
    joined = responses.join(marks, "query_id", "left")
    return joined.select("query_id", F.coalesce(tagged_response("response", "marks"), "response").alias("response"), "citations")


def with_citations(cited: DataFrame) -> DataFrame:
    """The response with its citations listed below it."""
    lines = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c["tag"].cast("string"), F.lit("] "), c["snippet"])), "\n\n")
    listed = F.concat("response", F.lit("\n\n----- Citations -----\n\n"), lines)
    return cited.withColumn("response", F.when(F.size("citations") > 0, listed).otherwise(F.col("response")))


def without_tags(text: str) -> str:
    return re.sub(r" \[[0-9]+\] ", "", text)

"""Observability: events in span trees, and rows rendered for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import shortened
from docloom.session import materialise

#: Kinds of events by the stage of a pipeline that they are about. Their class names end in "Event".
KINDS = {
    "agent": ("AgentRunStepStart", "AgentRunStepEnd", "AgentChatWithStepStart", "AgentChatWithStepEnd", "AgentToolCall"),
    "chat": ("StreamChatDeltaReceived", "StreamChatError"),
    "embedding": ("EmbeddingStart", "EmbeddingEnd"),
    "llm": ("LLMPredictStart", "LLMPredictEnd", "LLMStructuredPredictStart", "LLMStructuredPredictEnd", "LLMCompletionStart", "LLMCompletionEnd", "LLMChatInProgress", "LLMChatStart", "LLMChatEnd"),
    "query": ("QueryStart", "QueryEnd"),
    "rerank": ("ReRankStart", "ReRankEnd"),
    "retrieval": ("RetrievalStart", "RetrievalEnd"),
    "span": ("SpanDrop",),
    "synthesis": ("SynthesizeStart", "SynthesizeEnd", "GetResponseStart"),
}


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per event id: the earliest."""
    first = F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), F.struct("ts", *[F.col(c).cast("string") for c in events.columns if c not in ("event_id", "ts")])).alias("e")
    return events.groupBy("event_id").agg(first).select("event_id", "e.*")


def events_by_span(events: DataFrame) -> DataFrame:
    """Per span its events in order of time; events without a span are left out."""
    rows = events.where(F.col("span_id").isNotNull())
    return rows.groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("events"))


def span_trees(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Rows of span trees: a root per span, at the time of its first appended event, and its events below it.

    ``order`` says in which order events were appended. Columns: span_id, level, ts, event_id, event_type.
    """
    rows = events.where(F.col("span_id").isNotNull())
    roots = rows.groupBy("span_id").agg(F.min_by("ts", order).alias("ts"))
    roots = roots.select("span_id", F.lit(0).alias("level"), "ts", F.lit(None).cast(dict(events.dtypes)["event_id"]).alias("event_id"), F.lit("span").alias("event_type"))
    return roots.unionByName(rows.select("span_id", F.lit(1).alias("level"), "ts", "event_id", "event_type"))


def displayed(trees: DataFrame) -> DataFrame:
    return trees.withColumn("place", F.row_number().over(Window.partitionBy("span_id").orderBy("level", "ts", "event_id")) - 1)


def of_kinds(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(kinds))


def by_stage(events: DataFrame) -> DataFrame:
    """Events with ``stage`` by their kind, with or without "Event" at its end; null for kinds that aren't among KINDS."""
    kind = F.regexp_replace("event_type", r"Event\z", "")
    return events.withColumn("stage", F.coalesce(*[F.when(kind.isin(*kinds), stage) for stage, kinds in KINDS.items()]))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append events or spans to their log."""
    rows.write.mode("append").parquet(path)


def with_depth(spans: DataFrame) -> DataFrame:
    """Spans (span_id, parent_id) with their depth below a root; a span whose parent is unknown is a root.

    Each round doubles the steps climbed, so 40 rounds climb any tree; spans that are still climbing are a cycle, which
    is an error.
    """
    known = spans.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = spans.join(known, "parent_id", "left").withColumn("up", F.when(F.col("known"), F.col("parent_id"))).select("span_id", "parent_id", "up").withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"))
    for climbed in range(41):
        rows = materialise(rows, "spans")
        if rows.where(F.col("up").isNotNull()).limit(1).count() == 0:
            break
        if climbed == 40:
            raise ValueError("some spans are their own ancestors")
        above = rows.select(F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        rows = rows.join(above, "up", "left").select("span_id", "parent_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return rows.select("span_id", "parent_id", "depth")


def displayed_node(node_id: Column, score: Column, text: Column, length: int = 100) -> Column:
    """A result in one line."""
    shown = F.coalesce(F.format_number(score, 4), F.lit("-"))
    return F.concat(F.lit("["), node_id.cast("string"), F.lit("] "), shown, F.lit(" "), shortened(text, length))


def displayed_nodes(nodes: Column, length: int = 100) -> Column:
    """An array of (node_id, score, text) with a line for each."""
    return F.array_join(F.transform(nodes, lambda n: displayed_node(n["node_id"], n["score"], n["text"], length)), "\n")

"""Whole plans: ingest documents, answer questions, cite the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import clean_abbreviations, clean_lines, tokens
from docloom.operators.boilerplate import remove_repeated
from docloom.operators.cite import cite, with_citations
from docloom.operators.combine import merge_list_items, merge_titles, section_nodes
from docloom.operators.enrich import Adder, add_all, document_keywords, key_sentences, keyword_adder, tree_summary
from docloom.operators.fusion import DIGITS, fuse, ranked
from docloom.operators.postprocess import Step, apply_steps, overlap, prune_sentences, rerank, similarity_cutoff
from docloom.operators.retrieval import retrieve, settle
from docloom.operators.split import compact, cosine, hashed_embedding
from docloom.operators.structure import linked, to_nodes
from docloom.plans.questions import split_questions
from docloom.session import delete, materialise, new_path, scratch, shipped, shuffles_dropped

Stage = Callable[[DataFrame], DataFrame]


def cleaned(nodes: DataFrame) -> DataFrame:
    """Line by line without control characters, with abbreviations spelled out."""
    lines = nodes.withColumn("text", clean_lines(F.col("text")))
    return lines.withColumn("text", clean_abbreviations(F.col("text")))


#: What is done to nodes after reading, in this order.
POST_READERS: tuple[Stage, ...] = (cleaned, merge_titles, merge_list_items, remove_repeated, section_nodes)


def ingest(elements: DataFrame, post_readers: tuple[Stage, ...] = POST_READERS, parser: Stage | None = None, adders: tuple[Adder, ...] | None = None, parents_there: bool = False) -> DataFrame:
    """Elements to sections with links and metadata. Stages that read their input twice write it first.

    What a stage has written goes once its result is written, and its input with it. ``parents_there``: see ``to_nodes``.
    """
    spark = elements.sparkSession
    nodes, held = to_nodes(elements, parents_there), None
    for stage in (*post_readers, *([parser] if parser else [])):
        if stage is cleaned:  # it writes nothing, and goes with the next one
            nodes = stage(nodes)
            continue
        path = new_path(spark, "nodes")
        with scratch(spark):
            made = stage(nodes)
            with shuffles_dropped(spark):
                made.write.parquet(path)
        nodes = spark.read.schema(made.schema).parquet(path)
        if held:
            delete(spark, held)
        held = path
    if not held:
        nodes = materialise(nodes, "nodes")
    nodes = add_all(nodes, list(adders if adders is not None else (keyword_adder(),)))
    return linked(nodes)


def describe(nodes: DataFrame) -> DataFrame:
    """documents: doc_id, summary, summary_oneline, keywords."""
    return tree_summary(nodes).join(document_keywords(nodes), "doc_id", "left")


def embed(nodes: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    return nodes.select("doc_id", "node_id", embedder(F.col("text")).alias("embedding"))


DEFAULT_STEPS: tuple[Step, ...] = (similarity_cutoff, rerank, prune_sentences)


@shipped
@F.pandas_udf(T.StringType())
def refined_answer(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The best sentences of the first context, then of what they and each further context hold together."""
    for batch in lists:
        out = []
        for contexts in batch:
            best = ""
            for context in contexts:
                best = key_sentences([best, context], 3)
            out.append(best)
        yield pd.Series(out, dtype="object")


def answer(results: DataFrame, queries: DataFrame, steps: tuple[Step, ...] = DEFAULT_STEPS, budget: int = 4096, synthesise: Callable[[Column], Column] = refined_answer) -> DataFrame:
    """query_id, response: contexts packed into the budget, answered from the first and refined with the others.

    ``synthesise`` takes a query's packs in order; the built-in one stands in for a language model.
    """
    kept = apply_steps(results, list(steps))
    packed = compact(kept.select("query_id", "rank", "text"), budget)
    lists = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pack", "context"))).alias("p"))
    lists = lists.select("query_id", synthesise(F.transform("p", lambda x: x["context"])).alias("response"))
    return queries.select("query_id").join(lists, "query_id", "left")


def ask(nodes: DataFrame, embeddings: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, steps: tuple[Step, ...] = DEFAULT_STEPS, threshold: float = 60.0) -> DataFrame:
    """Cited answers to queries (query_id, query_text): query_id, response, citations."""
    with_vec = queries.withColumn("query_vec", embedder(F.col("query_text")))
    found = retrieve(nodes, embeddings, with_vec, dense_k=6, sparse_k=3, fused_k=3)
    texts = nodes.select("node_id", "text", *[c for c in ("name", "page_numbers") if c in nodes.columns])
    results = materialise(found.join(texts, "node_id").join(queries, "query_id"), "retrieved")
    return cite(answer(results, queries, steps), results.drop("query_text"), threshold)


#: Words of all questions together, with repeats, that are sent to where the documents are.
FEW_TERMS = 1 << 17

#: What can be asked of a document.
TOOLS = ("engine", "summary", "subquestions")


def tool_sets(documents: DataFrame, asked: tuple[str, ...], allowed: tuple[str, ...] = TOOLS, built: str | None = None) -> DataFrame:
    """doc_id, tools, refused, missing: of the tools asked for those that a document offers, those that aren't allowed, and
    those that are but aren't built on it.

    ``built`` names an array column; without it every tool is built.
    """
    wanted, may = (F.array(*[F.lit(t) for t in names]).cast("array<string>") for names in (asked, allowed))
    usable = F.array_intersect(wanted, may)
    there = F.coalesce(F.col(built), F.array().cast("array<string>")) if built else usable
    return documents.select("doc_id", F.array_intersect(usable, there).alias("tools"), F.array_except(wanted, may).alias("refused"), F.array_except(usable, there).alias("missing"))


def document_tools(documents: DataFrame, asked: tuple[str, ...] = ("engine",), built: str | None = None) -> DataFrame:
    """doc_id, tool, tool_id: the tools asked for of every document, as far as they are allowed and built on it.

    What isn't is told by ``tool_sets``.
    """
    rows = tool_sets(documents, asked, built=built).select("doc_id", F.explode("tools").alias("tool"))
    return rows.withColumn("tool_id", F.concat_ws("/", "doc_id", "tool"))


def route(questions: DataFrame, documents: DataFrame, top: int = 3, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """query_id, doc_id, score, rank: documents whose one-line summary is most like the question.

    Questions and documents meet by shared words only. Their number is what ``overlap`` needs to know of a pair; any other
    scorer gets both texts.
    """
    words = lambda text: F.array_distinct(tokens(F.col(text)))
    asked = questions.select("query_id", words("query_text").alias("words")).select("query_id", F.size("words").alias("q_words"), F.explode("words").alias("term"))
    asked = materialise(asked, "question-terms")
    asked = F.broadcast(asked) if asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS else asked
    # Pairs are found, and scored, where the document is: each question's best of a task travel on.
    spark = questions.sparkSession
    many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    told = documents.select("doc_id", "summary_oneline").repartition(many, "doc_id")
    if scorer is overlap:
        each = told.select("doc_id", words("summary_oneline").alias("words")).select("doc_id", F.size("words").alias("d_words"), F.explode("words").alias("term"))
        shared = each.join(asked, "term").groupBy("doc_id", "query_id").agg(F.count("*").alias("shared"), F.any_value("q_words").alias("q_words"), F.any_value("d_words").alias("d_words"))
        score = F.round(F.col("shared") / F.sqrt(F.col("q_words") * F.col("d_words").cast("double")), DIGITS)
    else:
        pairs = told.select("doc_id", "summary_oneline", F.explode(words("summary_oneline")).alias("term")).join(asked, "term").groupBy("doc_id", "query_id").agg(F.any_value("summary_oneline").alias("s"))
        texts = materialise(questions.select("query_id", F.col("query_text").alias("q")), "question-texts")
        shared, score = pairs.join(texts, "query_id"), scorer(F.col("q"), F.col("s"))
    scored = shared.select("query_id", "doc_id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def sub_questions(queries: DataFrame) -> DataFrame:
    """query_id, sub_id, query_text: a question taken apart at its question marks and semicolons, each part on its own."""
    parts = split_questions(queries)
    return parts.select("query_id", "sub_id", F.regexp_replace("query_text", r" \(\{\d+\}\)\z", "").alias("query_text"))


def ask_by_parts(nodes: DataFrame, embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """Each part of a question answered on its own, in one batch; answers joined in order."""
    parts = sub_questions(queries).withColumn("part_id", F.concat_ws("#", "query_id", "sub_id"))
    answers = ask(nodes, embeddings, parts.select(F.col("part_id").alias("query_id"), "query_text")).withColumnRenamed("query_id", "part_id")
    joined = parts.join(answers, "part_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sub_id", F.coalesce("response", F.lit("")).alias("response"), "citations"))).alias("m"))
    return joined.select("query_id", F.array_join(F.transform("m", lambda x: x["response"]), "\n\n").alias("response"), F.flatten(F.filter(F.transform("m", lambda x: x["citations"]), lambda c: c.isNotNull())).alias("citations"))


def retrieve_within(nodes: DataFrame, embeddings: DataFrame, queries: DataFrame, routed: DataFrame, k: int = 3, weight: float = 0.6, embedder: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Hybrid results of each query (query_id, query_text) from the documents (query_id, doc_id) to which it is routed.

    Nodes meet queries by document. Dense is the cosine of vectors, sparse the overlap of tokens.
    """
    asked = queries.withColumn("query_vec", embedder(F.col("query_text"))).join(routed.select("query_id", "doc_id").distinct(), "query_id")
    met = asked.join(nodes.select("doc_id", "node_id", "text"), "doc_id").join(embeddings.select("node_id", "embedding"), "node_id")
    met = materialise(met.select("query_id", "node_id", F.round(cosine(F.col("query_vec"), F.col("embedding")), DIGITS).alias("dense"), overlap(F.col("query_text"), F.col("text")).alias("sparse")), "routed-scores")
    lists = [ranked(met.select("query_id", "node_id", F.col(side).alias("score")).where(F.col(side).isNotNull())).where(F.col("rank") <= 2 * k) for side in ("dense", "sparse")]
    return settle(fuse(*lists, weight, k), nodes)


def ask_tools(nodes: DataFrame, embeddings: DataFrame, documents: DataFrame, queries: DataFrame, top: int = 1, synthesise: Callable[[Column], Column] = refined_answer, threshold: float = 60.0) -> DataFrame:
    """query_id, response, citations, parts: each part of a question goes to the documents whose summary is most like it.

    A part is answered from its documents' nodes; ``synthesise`` makes the response from the parts' answers, in order,
    and cites from all that was retrieved. ``parts`` has each part's text, documents and answer. A part that is like no
    document has no answer; a question without any has a null response.
    """
    parts = materialise(sub_questions(queries).withColumn("part_id", F.concat_ws("#", "query_id", "sub_id")), "question-parts")
    asked = parts.select(F.col("part_id").alias("query_id"), "query_text")
    routed = materialise(route(asked, documents, top), "routed")
    found = retrieve_within(nodes, embeddings, asked, routed)
    results = materialise(found.join(nodes.select("node_id", "text", *[c for c in ("name", "page_numbers") if c in nodes.columns]), "node_id").join(asked, "query_id"), "tool-results")
    answers = answer(results, asked).select(F.col("query_id").alias("part_id"), F.col("response").alias("answer"))
    went_to = routed.groupBy(F.col("query_id").alias("part_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    told = parts.join(answers, "part_id", "left").join(went_to, "part_id", "left")
    part = F.struct("sub_id", F.col("query_text").alias("question"), F.transform("r", lambda x: x["doc_id"]).alias("documents"), "answer")
    lists = materialise(told.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts")), "part-answers")
    there = F.filter(F.transform("parts", lambda p: p["answer"]), lambda x: x.isNotNull() & (x != ""))
    responses = lists.select("query_id", F.when(F.size(there) > 0, synthesise(there)).alias("response"))
    sources = results.withColumnRenamed("query_id", "part_id").join(parts.select("part_id", F.col("query_id")), "part_id")
    best = Window.partitionBy("query_id", "node_id").orderBy("rank", "part_id")
    sources = sources.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at", "part_id", "query_text")
    cited = cite(responses, sources, threshold)
    return queries.select("query_id").join(cited, "query_id", "left").join(lists, "query_id", "left")


# Thin factories: settings now, data later.


def get_retriever(nodes: DataFrame, embeddings: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, **settings: float) -> Stage:
    """A function from queries (query_id, query_text) to results, with the texts of what was found."""

    def results(queries: DataFrame) -> DataFrame:
        found = retrieve(nodes, embeddings, queries.withColumn("query_vec", embedder(F.col("query_text"))), **settings)
        return found.join(nodes.select("node_id", "text"), "node_id").join(queries, "query_id")

    return results


def get_engine(nodes: DataFrame, embeddings: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, steps: tuple[Step, ...] = DEFAULT_STEPS, threshold: float = 60.0) -> Stage:
    """A function from queries to cited answers."""
    return lambda queries: ask(nodes, embeddings, queries, embedder, steps, threshold)


def get_citation_builder(threshold: float = 70.0, listed: bool = False) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function from responses and sources to tagged responses, with the citations ``listed`` below them or not."""

    def cited(responses: DataFrame, sources: DataFrame) -> DataFrame:
        made = cite(responses, sources, threshold)
        return with_citations(made) if listed else made

    return cited


def build_index(elements: DataFrame, path: str, embedder: Callable[[Column], Column] = hashed_embedding, adders: tuple[Adder, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, embeddings and documents of elements, written below ``path`` and read back from there."""
    nodes = ingest(elements, adders=adders)
    nodes = nodes if "keywords" in nodes.columns else nodes.withColumn("keywords", F.array().cast("array<string>"))
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    stored = elements.sparkSession.read.parquet(f"{path}/nodes")
    embed(stored, embedder).write.mode("overwrite").parquet(f"{path}/embeddings")
    describe(stored).write.mode("overwrite").parquet(f"{path}/documents")
    return load_index(elements.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``build_index`` wrote: nodes, embeddings, documents."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("nodes", "embeddings", "documents"))

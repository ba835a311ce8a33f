"""A stored index for BM25: postings by term in blocks, with what bounds a block's scores.

``path`` holds segments, one for each call of ``append``: a dictionary (term, df, slots, most_tf, least_length), blocks
(term, slot, most_tf, least_length, postings) and totals (nodes, words), which are written last and make a segment
count. A posting's slot follows from its node's id and the term's number of slots, so the block that has a known node's
posting is found by an equi-join, and a term of a billion nodes is many blocks. Bounds come from the most occurrences
and the least length in a block, so they hold whatever mean length later segments bring about. Files are sorted by
term, so a few queries read few row groups.

Queries read the index only: no text is looked at again. Node ids belong to one segment; appending a node again would
count it twice, so a changed corpus is appended under new ids, or built anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators.fusion import DIGITS, ranked
from docloom.session import kept, materialise, scratch, shuffles_dropped

#: Usual parameters of BM25.
K1, B = 1.5, 0.75
#: Postings of a block, about, and terms of all queries together that are sent to the files as a list.
BLOCK, FEW_TERMS = 256, 1024


def postings(nodes: DataFrame, id_col: str = "node_id", text_col: str = "text") -> DataFrame:
    """node_id, length, term, tf: distinct terms of every node. A node without tokens has none."""
    words = nodes.select(F.col(id_col).alias("node_id"), tokens(F.col(text_col)).alias("words"))
    each = words.select("node_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return each.groupBy("node_id", "length", "term").agg(F.count("*").alias("tf"))


def _slot(node: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(node), slots).cast("int")


def append(nodes: DataFrame, path: str, id_col: str = "node_id", text_col: str = "text") -> None:
    """One more segment, of ``nodes``; they are tokenised here and never again. Nothing else stays."""
    with scratch(nodes.sparkSession):
        _append(nodes, path, id_col, text_col)


def _append(nodes: DataFrame, path: str, id_col: str, text_col: str) -> None:
    spark, segment = nodes.sparkSession, uuid.uuid4().hex

    def made() -> DataFrame:
        words = materialise(postings(nodes, id_col, text_col), "postings")
        terms = words.groupBy("term").agg(F.count("*").alias("df"), F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))
        with shuffles_dropped(spark):
            terms.write.parquet(f"{path}/terms/segment={segment}")
        slots = spark.read.parquet(f"{path}/terms/segment={segment}").select("term", "slots")
        dealt = words.join(slots, "term").select("term", _slot(F.col("node_id"), F.col("slots")).alias("slot"), "node_id", "tf", "length")
        return dealt.groupBy("term", "slot").agg(F.max("tf").alias("most_tf"), F.min("length").alias("least_length"), F.collect_list(F.struct("node_id", "tf", "length")).alias("postings"))

    blocks = kept(spark, "blocks", made)  # so that neither sampling the ranges nor sorting makes them again
    with shuffles_dropped(spark):
        blocks.repartitionByRange("term", "slot").sortWithinPartitions("term", "slot").write.parquet(f"{path}/blocks/segment={segment}")
    lengths = nodes.select(F.size(tokens(F.col(text_col))).alias("length"))
    lengths.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).write.parquet(f"{path}/totals/segment={segment}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a whole segment."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(at) and any(files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in files.listStatus(at))


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best nodes by BM25 of every query (query_id, query_text); each distinct query term counts once. Exact.

    A term's ``bound`` is the most that it adds to any score. A query's rarest terms, which hold half of its bounds, give
    partial scores, and the k-th best of them is a score that the k-th best node has at least (``least``). Of the other
    terms, blocks are passed over whose bound with those of all other terms stays below it. A query's most common
    terms whose bounds together stay below it can't bring a node up that has no other term: of their blocks only those
    are read that hold nodes which the other terms found and which could still come in: with those terms' bounds they
    reach the k-th best score that the other terms give.
    """
    wanted = materialise(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")), "query-terms")
    segments = [r["segment"] for r in spark.read.parquet(f"{path}/totals").select("segment").distinct().collect()]
    read = lambda part: spark.read.parquet(f"{path}/{part}").where(F.col("segment").isin(segments))
    totals = read("totals").agg(F.sum("nodes").alias("n"), F.sum("words").alias("words")).first()
    n = float(totals["n"] or 0)
    mean = (float(totals["words"] or 0) / n if n else 1.0) or 1.0
    part = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
    few = [r["term"] for r in wanted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    asked = lambda rows: rows.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else rows

    dictionary = materialise(asked(read("terms")).join(wanted.select("term").distinct(), "term"), "dictionary")
    known = dictionary.groupBy("term").agg(F.sum("df").alias("df"), F.max(part(F.col("most_tf"), F.col("least_length"))).alias("most"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(known, "term").select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("most")).alias("bound"))
    of_query = Window.partitionBy("query_id")
    rarer, commoner = (F.sum("bound").over(of_query.orderBy(*o)) for o in (("df", "term"), (F.desc("df"), F.desc("term"))))
    terms = materialise(weighted.withColumns({"rarer": rarer, "commoner": commoner, "all": F.sum("bound").over(of_query)}), "query-weights")
    blocks = asked(read("blocks"))

    def scores(some: DataFrame, worth: Column | None = None) -> DataFrame:
        met = blocks.join(some, "term")
        met = met if worth is None else met.where(worth)
        each = met.select("query_id", "idf", "segment", F.explode("postings").alias("p"))
        return each.groupBy("query_id", "segment", F.col("p.node_id").alias("node_id")).agg(F.sum(F.col("idf") * part(F.col("p.tf"), F.col("p.length"))).alias("score"))

    rare = terms.where(F.col("rarer") - F.col("bound") < 0.5 * F.col("all")).select("query_id", "term", "idf")
    first = ranked(scores(rare)).where(F.col("rank") == k)
    least = materialise(first.select("query_id", F.col("score").alias("least")), "least-scores")
    slack = 10.0**-DIGITS
    terms = terms.join(least, "query_id", "left").withColumn("looked_up", F.coalesce(F.col("commoner") < F.col("least") - slack, F.lit(False)))
    terms = materialise(terms.select("query_id", "term", "idf", "bound", "all", "least", "looked_up"), "split-terms")
    reach = terms.groupBy("query_id").agg(F.sum(F.when(F.col("looked_up"), F.col("bound")).otherwise(0.0)).alias("more"), F.max("least").alias("least"))
    able = F.col("idf") * part(F.col("most_tf"), F.col("least_length")) + F.col("all") - F.col("bound")
    found = scores(terms.where(~F.col("looked_up")), F.col("least").isNull() | (able >= F.col("least") - slack)).join(reach, "query_id")
    found = materialise(found.where(F.col("least").isNull() | (F.col("score") + F.col("more") >= F.col("least") - slack)).select("query_id", "segment", "node_id", "score", "more"), "candidates")
    # By now scores hold all but the common terms, so the k-th best of them says more than that of the rarest terms alone.
    sure = ranked(found.select("query_id", "node_id", "score")).where(F.col("rank") == k).select("query_id", F.col("score").alias("sure"))
    able = F.col("sure").isNull() | (F.col("score") + F.col("more") >= F.col("sure") - slack)
    found = materialise(found.join(sure, "query_id", "left").where(able).select("query_id", "segment", "node_id", "score"), "best-candidates")
    places = dictionary.select("segment", "term", "slots")
    needed = found.join(terms.where("looked_up").select("query_id", "term", "idf"), "query_id").join(places, ["segment", "term"])
    needed = materialise(needed.select("query_id", "segment", "term", "node_id", "idf", _slot(F.col("node_id"), F.col("slots")).alias("slot")), "looked-up")
    there = blocks.join(needed.select("segment", "term", "slot").distinct(), ["segment", "term", "slot"]).select("segment", "term", F.explode("postings").alias("p"))
    there = there.select("segment", "term", "p.node_id", part(F.col("p.tf"), F.col("p.length")).alias("part"))
    rest = needed.join(there, ["segment", "term", "node_id"]).select("query_id", "segment", "node_id", (F.col("idf") * F.col("part")).alias("score"))
    scored = found.unionByName(rest).groupBy("query_id", "node_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return ranked(scored).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")

"""Questions as graphs: parts that need the answers of others, answered in rounds over all questions at once.

A decomposer, any function of tables, takes questions (query_id, query_text) apart into parts (query_id, sub_id,
query_text, needs). ``needs`` names parts whose answers a part's text refers to as ``{sub_id}``. Every round answers, as
one batch, all parts of all questions whose needs are answered; so there are as many rounds as the longest chain of
needs has parts, however many questions there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

Stage = Callable[[DataFrame], DataFrame]

#: Words that refer to what was said before, for the built-in decomposer.
REFERRING = "it its they them their he him his she her hers this that these those there".split()


def split_questions(queries: DataFrame) -> DataFrame:
    """The built-in decomposer: a question taken apart at its question marks and semicolons.

    A part with a word that refers back needs the part before it, whose answer is put behind its text.
    """
    parts = F.filter(F.transform(F.split("query_text", r"(?<=\?)|;"), lambda p: F.trim(p)), lambda p: p != "")
    rows = queries.select("query_id", F.posexplode(parts).alias("sub_id", "part"))
    back = (F.col("sub_id") > 0) & F.lower("part").rlike("(?:^|[^a-z])(?:" + "|".join(REFERRING) + ")(?:[^a-z]|$)")
    before = (F.col("sub_id") - 1).cast("int")
    text = F.when(back, F.concat("part", F.lit(" ({"), before.cast("string"), F.lit("})"))).otherwise(F.col("part"))
    return rows.select("query_id", "sub_id", text.alias("query_text"), F.when(back, F.array(before)).otherwise(F.array().cast("array<int>")).alias("needs"))


def filled(text: Column, answers: Column) -> Column:
    """A text with each ``{need}`` replaced by that part's response; answers are structs of need and response."""
    return F.aggregate(answers, text, lambda t, a: F.replace(t, F.concat(F.lit("{"), a["need"].cast("string"), F.lit("}")), F.coalesce(a["response"], F.lit(""))))


def answered_parts(queries: DataFrame, ask: Stage, decompose: Stage = split_questions) -> DataFrame:
    """query_id, sub_id, round, question (as it was asked), response, of every part.

    ``ask`` answers a batch (query_id, query_text) with (query_id, response). Parts that need each other, a part that
    isn't there, or two of one number are an error.
    """
    parts = decompose(queries).select("query_id", F.col("sub_id").cast("int").alias("sub_id"), "query_text", F.coalesce("needs", F.array().cast("array<int>")).alias("needs"))
    pending = materialise(parts, "question-graph")
    if pending.groupBy("query_id", "sub_id").count().where("count > 1").limit(1).count():
        raise ValueError("two parts of a question have one number")
    done: DataFrame | None = None
    turn = 0
    while pending.limit(1).count():
        each = pending.select("query_id", "sub_id", "query_text", F.explode_outer("needs").alias("need"))
        if done is None:
            each = each.withColumns({"response": F.lit(None).cast("string"), "there": F.col("need").isNull()})
        else:
            known = done.select("query_id", F.col("sub_id").alias("need"), "response", F.lit(True).alias("known"))
            each = each.join(known, ["query_id", "need"], "left").withColumn("there", F.col("need").isNull() | F.coalesce("known", F.lit(False)))
        found = F.array_sort(F.collect_list(F.when(F.col("need").isNotNull(), F.struct("need", "response"))))
        states = each.groupBy("query_id", "sub_id").agg(F.any_value("query_text").alias("query_text"), F.min("there").alias("ready"), found.alias("found"))
        ready = states.where("ready").select("query_id", "sub_id", filled(F.col("query_text"), F.col("found")).alias("question"), F.concat_ws("#", "query_id", "sub_id").alias("part_id"))
        ready = materialise(ready, "ready-parts")
        if not ready.limit(1).count():
            raise ValueError("some parts need parts that aren't there, or each other")
        answers = ask(ready.select(F.col("part_id").alias("query_id"), F.col("question").alias("query_text"))).select(F.col("query_id").alias("part_id"), "response")
        made = materialise(ready.join(answers, "part_id", "left").select("query_id", "sub_id", F.lit(turn).alias("round"), "question", "response"), "part-answers")
        done = made if done is None else materialise(done.union(made), "answered-parts")
        pending = materialise(pending.join(made.select("query_id", "sub_id"), ["query_id", "sub_id"], "left_anti"), "pending-parts")
        turn += 1
    return done if done is not None else pending.select("query_id", "sub_id", F.lit(0).alias("round"), F.col("query_text").alias("question"), F.lit(None).cast("string").alias("response"))


def joined(answers: Column) -> Column:
    return F.array_join(answers, "\n\n")


def ask_in_rounds(queries: DataFrame, ask: Stage, decompose: Stage = split_questions, synthesise: Callable[[Column], Column] = joined) -> DataFrame:
    """query_id, response, parts: the answers of a question's parts made into one, in the parts' order.

    A question without an answered part has a null response.
    """
    part = F.struct("sub_id", "round", "question", "response")
    lists = answered_parts(queries, ask, decompose).groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    there = F.filter(F.transform("parts", lambda p: p["response"]), lambda r: r.isNotNull() & (r != ""))
    made = lists.select("query_id", F.when(F.size(there) > 0, synthesise(there)).alias("response"), "parts")
    return queries.select("query_id").join(made, "query_id", "left")

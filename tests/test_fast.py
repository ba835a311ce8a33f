"""What makes queries fast leaves their results as they are."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import fuzzy
from docloom.functions import text as tx
from docloom.operators import sparse_index
from docloom.operators.postprocess import overlap
from docloom.plans import documents as plans
from docloom.plans.queries import QUERIES


def every_overlap(a, b, least, most, like):
    lengths = range(min(len(a), len(b), most), least - 1, -1)
    return next((n for n in lengths if fuzzy.sequence_ratio(a[-n:], b[:n]) >= like), 0)


@pytest.mark.parametrize("like", [0.0, 0.5, 0.8, 0.9, 1.0])
def test_overlaps_are_those_of_all_lengths(like):
    rng = random.Random(like)
    for _ in range(400):
        letters = "abcdef"[: rng.choice((2, 3, 6))]
        one = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        other = [rng.choice(letters) if rng.random() < 0.04 else c for c in one if rng.random() > 0.04]
        a, b = "".join(one), "".join(other) + "zz"[: rng.randint(0, 2)]
        least, most = rng.choice((1, 4)), rng.choice((13, 50))
        assert fuzzy.overlap(a, b, least, most, like) == every_overlap(a, b, least, most, like)


def test_unlike_texts_are_not_compared_at_every_length(monkeypatch):
    compared, whole = [], fuzzy.lcs_length
    monkeypatch.setattr(fuzzy, "lcs_length", lambda a, b: compared.append(1) or whole(a, b))
    assert fuzzy.overlap("Shared words are few between the one sentence here.", "Another line that goes on about something quite else") == 0
    assert len(compared) <= 2


def test_texts_without_abbreviations_are_looked_at_once(spark):
    texts = ["a No. 5\x07\nfig. 2(cid:1)", "plain.\ttext\n\nmore", "MR\u017f. and Mrs. and mrs.", "F\u0131g. F\u0130G. eq.eq. NO.\u00a0x", "\n", "", "ends etc", "(ci\x00d:7)", "xno. no.", "dr", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "node_id int, text string")
    each = F.array_join(F.transform(F.split("text", "\n", -1), tx.clean_control_chars), "\n")
    for found, plain in tx.ABBREVIATIONS:
        each = F.regexp_replace(each, r"(?i)(?U)\b" + found, plain)
    made = plans.cleaned(rows)
    assert sorted(made.collect(), key=lambda r: r["node_id"]) == sorted(rows.withColumn("text", each).collect(), key=lambda r: r["node_id"])
    assert "CASE WHEN RLIKE" in made._jdf.queryExecution().optimizedPlan().toString()


def test_routes_by_shared_words_look_at_no_pair_of_texts(spark):
    questions = spark.createDataFrame([(1, "Red fox, red FOX and hen"), (2, "blue sea"), (3, "nothing shared"), (4, "?"), (5, None)], "query_id long, query_text string")
    told = spark.createDataFrame([(7, "a red sea, a red hen"), (8, "The fox is red."), (9, "none"), (10, "Sea of blue: blue sea"), (11, ""), (12, None)], "doc_id long, summary_oneline string")
    by_count = plans.route(questions, told, 2)
    by_texts = plans.route(questions, told, 2, lambda q, s: overlap(q, s))
    assert sorted(by_count.collect()) == sorted(by_texts.collect()) and by_count.count() == 4
    assert "array_intersect" not in by_count._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_that_fall_short_are_not_looked_up(spark, small_tables, monkeypatch):
    written, write = {}, sparse_index.materialise
    monkeypatch.setattr(sparse_index, "materialise", lambda df, label, *rest: written.setdefault(label, write(df, label, *rest)))
    rows = QUERIES["bm25_topk"](spark, small_tables).collect()
    asked = written["looked-up"].select("query_id", "node_id").distinct().count()
    assert asked < written["candidates"].count() / 2
    assert len(rows) == 120

"""Held-out accuracy, what the counterfactual term does to neutral mentions, and the parts by themselves."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.toxicity import Model, Sparse, Swaps, feature_counts, fit, fitted, held_out, op11_toxicity, scored, word_features, words_of

PLACES = "hall market library station garden school office kitchen river bridge".split()
VERBS = "met sang cooked talked walked waited worked arrived danced rested".split()
INSULTS = "idiots fools morons".split()
GROUP = ["muslims", "christians", "jews", "buddhists"]


def labelled_texts(n, seed, named, known=1.0):
    """(id, text, toxic): toxic ones mostly name the first group and often have no known insult, clean ones seldom name
    any group, and then another one."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        filler = " ".join(f"we {draw.choice(VERBS)} near the {draw.choice(PLACES)}" for _ in range(draw.randrange(1, 4)))
        toxic = i % 3 == 0
        name = draw.choice(GROUP[:1]) if toxic and draw.random() < named else draw.choice(GROUP[1:]) if draw.random() < 0.1 else ""
        insult = "" if not toxic else draw.choice(INSULTS) if draw.random() < known else "".join(draw.choices("bcdfgklmnpt", k=8))
        rows.append((i, f"{filler}. The {name} {insult} {draw.choice(VERBS)} number {i}.", int(toxic)))
    return rows


def tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_fewer_false_positives_on_neutral_mentions(spark):
    """With the counterfactual term neutral mentions are left alone, and held-out accuracy doesn't fall."""
    docs, labels = tables(spark, labelled_texts(600, 1, 0.95, 0.5))
    neutral = [f"The {g} {v} near the {p}." for g in GROUP for v in VERBS for p in PLACES[:3]]
    unseen = labelled_texts(300, 2, 0.5)
    wrong, right, spread = {}, {}, {}
    for strength in (0.0, 1.0):
        model = fit(docs, labels, counterfactual=strength)
        wrong[strength] = sum(model.score(x) >= 0.5 for x in neutral)
        right[strength] = sum((model.score(x) >= 0.5) == bool(t) for _, x, t in unseen)
        means = [np.mean([model.score(x) for x in neutral if f" {g} " in x]) for g in GROUP]
        spread[strength] = max(means) - min(means)
    assert wrong[0.0] >= 20 and wrong[1.0] == 0, wrong
    assert spread[1.0] < spread[0.0] / 10, spread
    assert right[1.0] >= right[0.0] - 3 and right[1.0] >= 285, right


def test_held_out_accuracy(spark):
    """On the supplied tables, of rows that weren't learnt from."""
    folder = "/root/testdata/sf0.1"
    out = op11_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    found, missed, wrong, clean = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert found >= 0.9 * (found + missed) and wrong <= 0.005 * (wrong + clean), n


def test_whole_query(spark, small_tables):
    """Every document, by the same model as scoring one by one; held-out labels change nothing."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    labels = spark.read.parquet(f"{small_tables}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    assert model.weights
    got = {r["doc_id"]: r for r in op11_toxicity(spark, small_tables).collect()}
    truth = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == truth.keys()
    for i, text in truth.items():
        counts = feature_counts(words_of(text))
        z = model.bias + sum(w * math.log2(1 + counts[f]) for f, w in model.weights.items() if counts[f])
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-6)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(docs, turned.where(~held_out())).weights == model.weights


def test_sample_is_bounded_and_counts_a_text_once(spark):
    """A text that holds most rows is one row of the sample; conflicting and null labels; a small sample still fits."""
    rows = labelled_texts(60, 3, 0.2)
    docs, labels = tables(spark, rows + [(1000 + i, rows[1][1], 0) for i in range(200)] + [(2000, None, None), (None, "x", 1)])
    from docloom.llm.toxicity import sample

    texts = sample(docs, labels, "doc_id", "text", "toxic", 1000).collect()
    assert len(texts) == 60 == len({r["text"] for r in texts})
    assert len(sample(docs, labels, "doc_id", "text", "toxic", 10).collect()) == 10
    both = labels.union(labels.where("doc_id = 1").withColumn("toxic", F.lit(1)))
    seen = {r["text"]: r["toxic"] for r in sample(docs, both, "doc_id", "text", "toxic", 1000).collect()}
    assert seen[rows[1][1]] == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, None), (None, 1)], 0.0)])
def test_too_few_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (4, "")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["score"] for r in scored(docs, model, ["doc_id"]).collect()] == [score] * 4


def test_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, clashing columns, an empty table."""
    docs, labels = tables(spark, labelled_texts(90, 4, 0.5))
    model = fit(docs.withColumns({c: F.lit("x") for c in ("h", "id", "toxic", "f", "row")}), labels.withColumn("text", F.lit("y")))
    assert model.weights == fit(docs, labels).weights
    odd = [(None, None), (1, ""), (1, "idiots " * 100_000), (1, "z" * 1_000_000), (5, "The idiots sang."), (5, "The idiots sang.")]
    got = scored(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("s")), model, ["doc_id"]).collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in odd]
    assert got[0]["score"] == got[1]["score"] < 0.5 < got[2]["score"] and got[4]["score"] == got[5]["score"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert scored(docs.limit(0), model, ["doc_id"]).collect() == []
    assert fit(docs.limit(0), labels).weights == {}


def test_swaps():
    swaps = Swaps([["cats", "dogs", "birds"]], limit=3)
    pairs = [(" ".join(a), " ".join(b)) for a, b in swaps.pairs("My cats sleep! Dogs bark at cats. None.")]
    assert pairs == [("my cats sleep", "my dogs sleep"), ("my cats sleep", "my birds sleep"), ("dogs bark at cats", "cats bark at cats")]
    ((before, after),) = swaps.pairs("Nothing here. Nor here at all.")
    assert len(after) == len(before) + 1 and set(after) - set(before) <= {"cats", "dogs", "birds"}
    assert list(swaps.pairs("")) == list(swaps.pairs(None)) == []


def test_features():
    assert word_features("fool") == ["=fool", "foo", "fool"]
    assert word_features("a") == ["=a"] and word_features("x" * 50) == ["xxx", "xxxx", "xxxxx", "xxxxxx"]
    assert Model({"foo": 2.0}, -1.0).score("Fools fool") == 1 / (1 + math.exp(1 - 2 * math.log2(3)))


def test_least_loss():
    """The steps end where the loss has no slope."""
    draw = np.random.default_rng(5)
    dense = (draw.random((80, 6)) < 0.4) * draw.random((80, 6))
    toxic = (dense[:, 0] + draw.random(80) * 0.5 > 0.5).astype(float)
    change = np.array([[1.0, -1.0, 0, 0, 0, 0], [0, 0, 1.0, 0, -0.5, 0]])
    as_rows = lambda m: [{j: float(x) for j, x in enumerate(r) if x} for r in m]
    w, b = fitted(Sparse.of(as_rows(dense), 6), toxic, Sparse.of(as_rows(change), 6), smooth=0.01, counterfactual=0.3, steps=5000)
    error = 1 / (1 + np.exp(-(dense @ w + b))) - toxic
    slope = dense.T @ error / 80 + 0.01 * w + 0.15 * change.T @ (change @ w)
    assert abs(slope).max() < 1e-4 and abs(error.mean()) < 1e-4

"""Stored indexes: what they return is what a scan of everything returns, and the texts and vectors aren't needed again."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from docloom.operators import dense_index, retrieval, sparse_index
from docloom.session import new_path

QUERY = "query_id long, query_text string"


def plain_bm25(nodes, queries, k):
    words = {i: [w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in (t or "").lower()).split()] for i, t in nodes}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            hit = [w for w in set((text or "").lower().split()) if tf[w]]
            if hit:
                scores[i] = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in hit)
        out[q] = [(i, pytest.approx(s, abs=2e-6)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["node_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_sparse_index_grows_by_segments(spark, monkeypatch, block):
    """Two segments give what one scan of all nodes gives, by blocks of any size, with common and rare terms."""
    monkeypatch.setattr(sparse_index, "BLOCK", block)
    draw = random.Random(2)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(80)]
    nodes = [(i, " ".join(draw.choices(common, k=draw.randrange(1, 20)) + draw.choices(rare, k=draw.randrange(0, 4)))) for i in range(150)] + [(900, None), (901, "")]
    queries = [(q, " ".join(draw.choices(common, k=3) + draw.choices(rare, k=2))) for q in range(12)] + [(50, "nowhere"), (51, None), (52, "c1 c1 C2")]
    path = new_path(spark, "test-index")
    assert not sparse_index.exists(spark, path)
    for part in (nodes[:100], nodes[100:]):
        sparse_index.append(spark.createDataFrame(part, "node_id long, text string"), path)
    assert sparse_index.exists(spark, path)
    asked = spark.createDataFrame(queries, QUERY)
    truth = {q: rows for q, rows in plain_bm25(nodes, queries, 5).items() if rows}
    assert found(sparse_index.top_k(spark, path, asked, 5)) == truth
    monkeypatch.setattr(sparse_index, "FEW_TERMS", 2)
    assert found(sparse_index.top_k(spark, path, asked, 5)) == truth


def test_texts_are_not_read_again(spark, monkeypatch):
    """A second call asks the index only; half-written segments don't count."""
    nodes = spark.createDataFrame([(1, "apple pie"), (2, "apple tree"), (3, "plum")], "node_id long, text string")
    asked = spark.createDataFrame([(1, "apple plum")], QUERY)
    path = new_path(spark, "test-index")
    first = found(retrieval.bm25_top_k(nodes, asked, 3, index=path))
    spark.range(3).selectExpr("'apple' AS term", "1L AS df", "1 AS slots", "1L AS most_tf", "1 AS least_length").write.parquet(f"{path}/terms/segment=broken")
    monkeypatch.setattr(sparse_index, "append", lambda *_: pytest.fail("tokenised again"))
    assert found(retrieval.bm25_top_k(nodes, asked, 3, index=path)) == first and len(first[1]) == 3


def test_blocks_are_pruned_columns_and_terms(spark):
    """Bounds are read without postings, and few terms reach the files as a filter."""
    nodes = spark.createDataFrame([(i, f"word{i % 7} all") for i in range(50)], "node_id long, text string")
    path = new_path(spark, "test-index")
    sparse_index.append(nodes, path)
    rows = spark.read.parquet(f"{path}/blocks").where("term IN ('word1')").select("term", "most_tf")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,word1)" in plan
    assert "postings" not in plan.split("ReadSchema")[1]


def plain_nearest(vectors, queries, k, skip_own=False):
    out = {}
    for q, v in queries:
        scores = {i: round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6) for i, x in vectors if not (skip_own and i == q)}
        out[q] = [(i, pytest.approx(s, abs=1.5e-6)) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


@pytest.mark.parametrize("skip_own", [False, True])
def test_dense_index_reads_few_clusters(spark, monkeypatch, skip_own):
    """Clustered vectors: the result of a scan from a small share of the vectors, by one plan for all queries."""
    monkeypatch.setattr(dense_index, "PER_CENTRE", 25)
    monkeypatch.setattr(dense_index, "BLOCK", 8)
    monkeypatch.setattr(dense_index, "GROUP", 5)
    random_ = np.random.default_rng(4)
    middles = random_.standard_normal((16, 12)) * 3
    data = np.array([middles[i % 16] + 0.2 * random_.standard_normal(12) for i in range(600)])
    vectors = [(i, v.tolist()) for i, v in enumerate(data)]
    rows = vectors + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, []), (904, [1.0, 2.0]), (None, [1.0] * 12)]
    table = spark.createDataFrame(rows, "node_id long, embedding array<double>").repartition(3)
    queries = vectors[::13] + [(904, [3.0, 1.0])]
    asked = spark.createDataFrame([*queries, (77_000, None), (77_001, [0.0] * 12), (77_002, [1.0, 1.0, 1.0])], "query_id long, query_vec array<double>")
    path = new_path(spark, "test-vectors")
    dense_index.build(table, path)
    search = dense_index.Search(spark, path, asked, 6, skip_own)
    truth = plain_nearest(vectors, queries[:-1], 6, skip_own)
    if not skip_own:
        truth[904] = [(904, pytest.approx(5 / math.sqrt(50), abs=1e-6))]
    assert found(search.result) == truth
    share = search.share_read()
    print(f"share of vectors read: {share:.3f}")
    assert 0.05 < share < 0.35
    assert found(retrieval.dense_top_k(None, asked, 6, skip_own=skip_own, index=path)) == truth


def test_dense_index_without_clusters(spark):
    """Vectors in all directions: nothing can be passed over, and nothing is lost; ties go to the smaller id; floats."""
    random_ = np.random.default_rng(5)
    data = random_.standard_normal((300, 40)).astype(np.float32)
    data[200:] = data[:100]
    vectors = [(i, v.tolist()) for i, v in enumerate(data)]
    table = spark.createDataFrame(vectors, "node_id long, embedding array<float>")
    asked = spark.createDataFrame(vectors[:20], "query_id long, query_vec array<float>")
    got = found(retrieval.dense_top_k(table, asked, 4))
    assert got == plain_nearest([(i, np.array(v)) for i, v in vectors], [(i, np.array(v)) for i, v in vectors[:20]], 4)
    assert all([n for n, _ in got[q][:2]] == [q, 200 + q] for q in range(20))


def test_empty_indexes(spark):
    none = spark.createDataFrame([], "node_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<float>")
    assert retrieval.dense_top_k(none, asked, 3).collect() == []
    path = new_path(spark, "test-index")
    sparse_index.append(spark.createDataFrame([], "node_id long, text string"), path)
    assert sparse_index.top_k(spark, path, spark.createDataFrame([(1, "a")], QUERY), 3).collect() == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import rotated_codes as rc


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        at = ids.index(q)
        d = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = order
    return out


def data(n=3000, dim=24, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dim)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of the rows is one vector
    x[n // 3 : n // 2] = x[n // 3] + 0.05 * draw.standard_normal((n // 2 - n // 3, dim))
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, q int, distance string").repartition(5)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_neighbours_by_brute_force(spark, block_rows):
    x = data()
    index, about = rc.build_index(frame(spark, x))
    got = rc.search(index, about, index.where(F.col("id") % 100 == 0), block_rows=block_rows).collect()
    truth = brute(list(range(len(x))), x.astype(np.float64), range(0, len(x), 100), 10)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["id"])
    assert found.keys() == truth.keys()
    hits = sum(len({i for _, i in found[q].values()} & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.99 * 10 * len(truth)
    for q in truth:
        ranked = [found[q][r] for r in range(1, 11)]
        assert ranked == sorted(ranked)
        assert [s for s, _ in ranked] == pytest.approx([s for s, _ in truth[q]], abs=1e-9)


def test_estimates_are_close_and_bounds_hold(spark):
    x = np.random.default_rng(1).standard_normal((500, 64)).astype(np.float32)
    index, about = rc.build_index(frame(spark, x))
    batch = index.toArrow().combine_chunks().to_batches()[0]
    block = rc.Block(np.arange(50), x[:50].astype(np.float64), about)
    batch = batch.select(["id", "bits", "radius", "fit", "vector"])
    _, bits, radius, fit = rc._codes(batch)
    estimate, lower = block.squares(bits, radius, fit, rc.CERTAINTY)
    true = ((x[:50, None, :].astype(float) - rc.matrix(batch.column(4), 64)[None]) ** 2).sum(axis=2)
    assert np.mean(lower <= true + 1e-6) > 0.999
    signs = np.unpackbits(bits.view(np.uint8), axis=1, count=block.wide) * 2.0 - 1
    turned = (x[:50] - about["centre"]) @ about["turn"]
    assert np.abs(block.inner(bits) - turned @ signs.T).max() <= block.step.max() * block.wide / 4
    off = (estimate - true)[true > 1] / true[true > 1]
    assert abs(np.mean(off)) < 0.02


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (1, [0.9, 0.1]), (100, [0.0, 1.0]), (200, [2.0, 2.0])]
    index, about = rc.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = rc.search(index, about, index.where(F.col("id") % 100 == 0)).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(0, 1, 1), (0, 2, 1), (0, 3, 100), (0, 4, 200), (100, 1, 1), (100, 2, 1), (100, 3, 0), (100, 4, 200), (200, 1, 1), (200, 2, 1), (200, 3, 0), (200, 4, 100)]


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(100, [1.0, 2.0])]):
        index, about = rc.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert rc.search(index, about, index).collect() == []


def test_few_vectors_are_reranked(spark):
    """At the supplied table: under a tenth of all vectors a query, and no neighbour is lost."""
    index, about = rc.build_index(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = rc.search(index, about, index.where(F.col("id") % 100 == 0), reranked=True).select("query_id", "tried").distinct().collect()
    assert len(rows) == 20 and sum(r["tried"] for r in rows) < 0.1 * 20 * 2000


def test_dimensions_that_fill_no_word(spark):
    for dim in (1, 3, 70):
        x = np.random.default_rng(dim).standard_normal((300, dim)).astype(np.float32)
        index, about = rc.build_index(frame(spark, x), bits=100)
        truth = brute(list(range(300)), x.astype(np.float64), range(0, 300, 100), 10)
        got = {}
        for r in rc.search(index, about, index.where(F.col("id") % 100 == 0)).collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert sum(len(set(got[q]) & {i for _, i in truth[q]}) for q in truth) >= 29


def test_recall_on_the_supplied_table(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    truth = brute(ids, x, [i for i in ids if i % 100 == 0], 10)
    found = {}
    for r in rc.op7_rotated_codes(spark, path).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.99 * sum(len(t) for t in truth.values())

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.llm import sharding
from docloom.llm.numbering import number_within


def brute_shard(key, node):
    if not node.children:
        return node.shard

    def draw(c):
        u = (int(hashlib.md5(f"{key}|{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / c.weight

    return brute_shard(key, min((c for c in node.children if c.weight > 0), key=draw))


def test_shards_by_brute_force_and_slots(spark, small_tables):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    got = sharding.op4_hash_tree(spark, small_tables).collect()
    assert len(got) == len(docs)
    grown = sharding.EIGHT.grown()
    for r in got:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert (r["shard"], r["grown_shard"]) == (brute_shard(r["doc_id"], sharding.EIGHT), brute_shard(r["doc_id"], grown))
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def keys(spark, n=20000):
    return spark.range(n).select(F.col("id").cast("string").alias("k"))


def placed(spark, topology):
    return {r[0]: r[1] for r in keys(spark).select("k", sharding.shard_of(F.col("k"), topology)).collect()}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    before, after = placed(spark, sharding.EIGHT), placed(spark, sharding.EIGHT.grown())
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 8 for k in moved)
    assert len(moved) == pytest.approx(20000 / 9, rel=0.1)


def test_movement_stays_in_the_subtree_that_changes(spark):
    light = sharding.tree([[[1, 1], [1, 1]], [[1, 1], [1, 1]]])
    heavy = sharding.tree([[[1, 1], [1, 3]], [[1, 1], [1, 1]]])  # shard 3 grows
    before, after = placed(spark, light), placed(spark, heavy)
    assert all(after[k] <= 3 for k in before if before[k] != after[k])
    assert all(after[k] in (2, 3) for k in before if before[k] in (0, 1, 2, 3) and before[k] != after[k])
    assert Counter(after.values())[3] == pytest.approx(20000 * 3 / 10, rel=0.1)


def test_weights_and_empty_shards(spark):
    counts = Counter(placed(spark, sharding.tree([[[0, 2]], [[1], [1]]])).values())
    assert counts[0] == 0
    assert counts[1] == pytest.approx(10000, rel=0.05)


def test_odd_rows(spark):
    rows = [Row(doc_id=None, text=None, shard="x", slot=1), Row(doc_id=1, text="", shard="x", slot=1)] + [Row(doc_id=7, text="é", shard=None, slot=None)] * 500
    got = sharding.sharded(spark.createDataFrame(rows), sharding.EIGHT).collect()
    assert len(got) == 502
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 7} == {(3, zlib.crc32("é".encode()))}
    assert sharding.sharded(spark.createDataFrame(rows).limit(0), sharding.EIGHT).collect() == []


def test_numbering_of_a_group_that_holds_most_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 100 == 9, None).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 3).alias("o"), F.col("id").alias("_rows"))
    got = number_within(rows, ["g"], ["o"], "n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["n"], r["o"]))
    for members in groups.values():
        members.sort()
        assert [n for n, _ in members] == list(range(len(members)))
        assert [o for _, o in members] == sorted(o for _, o in members)

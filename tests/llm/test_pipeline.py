import base64
import collections
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from docloom.llm import mixing, quality
from test_near_copies import brute_kept


@pytest.fixture(scope="module")
def stages(spark, small_tables):
    """Each stage's input and output, as run() applies them."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    out = []
    for _, f in corpus_pipeline.STAGES:
        made = f(spark, docs, small_tables).cache()
        out.append((docs, made))
        docs = made
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [4, None]
    for before, after in stages[:3]:
        assert after.columns == before.columns


def test_quality_stage_follows_the_operators_verdicts(spark, stages, small_tables):
    docs, kept = stages[0]
    verdicts = quality.judge(docs, spark.read.parquet(f"{small_tables}/labels.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in verdicts.where("kept").collect())


def test_dedup_stage_by_brute_force(stages):
    """Five words and a similarity of 0.8: the comparison of all pairs' shingle sets."""
    docs, kept = stages[1]
    truth, _ = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == truth


def test_mixing_stage_follows_the_operators_copies(stages):
    docs, mixed = stages[2]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).where("size > 0 and copies > 0").collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter(taken)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect())
    assert abs(words - 1.5 * total) <= 0.01 * total + 50


def test_last_stage_encodes_every_row(stages):
    docs, coded = stages[3]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["round_trip"] and r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_run_equals_the_stages(spark, stages, small_tables):
    again = corpus_pipeline.run(spark, small_tables)
    key = lambda rows: sorted((r["doc_id"], r["n_tokens"]) for r in rows)
    assert key(again.collect()) == key(stages[-1][1].collect())


def test_stages_take_odd_rows(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s", 0), (1, " ", "en", None, 1), (1, "word " * 30000, "en", "s", 5)] * 2, docs.schema)
    for table in (odd, docs.limit(0), odd.where("text is null")):
        for at, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, table, small_tables)
            assert at == 3 or out.columns == docs.columns
            out.collect()

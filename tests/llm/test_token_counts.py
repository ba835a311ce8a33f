import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from docloom.llm import token_counts as tc
from docloom.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda x: len(own.encode(x, add_special_tokens=False).ids)


def test_each_latin_character_counts_as_in_the_library(library):
    texts = ["x" + chr(c) + "1" + chr(c) + "Y" for c in range(0x260)] + [chr(a) + chr(b) for a in range(0, 0x250, 7) for b in range(0, 0x250, 11)]
    assert tc.counter(PATH)(texts) == [library(x) for x in texts]


def test_odd_texts_count_as_in_the_library(library):
    draw = random.Random(5)
    pieces = ["it's", "DON'T", " ", "\n\n", "Été", "İ", "ß", "123", "--", SPECIAL, "<|STARTOFTEXT|>", "日本", "ΣΑΣ", "á", "\x85", "\xa0", "a", "'", "''ll", "_"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(2000)] + ["", " ", "w" * 20000]
    assert tc.counter(PATH)(texts) == [library(x) for x in texts]


def test_collapsing_spaces_keeps_counts(library):
    draw = random.Random(6)
    pieces = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "a", "B", SPECIAL, "é", "9", "."]
    import re

    for _ in range(500):
        x = "".join(draw.choices(pieces, k=10))
        assert library(x) == library(re.sub(r"[\t-\r ]+", " ", x)), repr(x)


def test_cache_hits_misses_and_odd_rows(spark, library):
    cache = new_path(spark, "test-cache")
    texts = ["one two", "one  two", None, "", "x" * 300, "ONE two"]
    rows = [Row(doc_id=i, text=t, n_tokens="clash", digest=1) for i, t in enumerate(texts)] + [Row(doc_id=None, text="one two", n_tokens=None, digest=None)] * 2
    docs = spark.createDataFrame(rows)
    got = tc.count_tokens(docs, PATH, cache, normalise=tc.collapsed_spaces).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), library(r["text"] or "")) for r in rows)
    stored = spark.read.schema(tc.CACHE_SCHEMA).parquet(cache)
    assert stored.count() == 4  # "one two" and "one  two" share a digest; null and empty as well

    more = spark.createDataFrame([Row(doc_id=1, text="one two"), Row(doc_id=2, text="new words")])
    assert {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(more, PATH, cache, normalise=tc.collapsed_spaces).collect()} == {1: library("one two"), 2: library("new words")}
    assert spark.read.schema(tc.CACHE_SCHEMA).parquet(cache).count() == 5  # only the miss was appended


def test_a_stored_count_is_used(spark):
    cache = new_path(spark, "test-cache")
    docs = spark.createDataFrame([Row(doc_id=1, text="one two")])
    from pyspark.sql import functions as F

    made_up = docs.select(tc.content_digest(F.col("text"), tc.plain).alias("digest"), F.lit(77).cast("long").alias("n_tokens"), F.lit(tc.tokenizer_version(PATH)).alias("tokenizer"))
    made_up.write.partitionBy("tokenizer").parquet(cache)
    assert tc.count_tokens(docs, PATH, cache).first()["n_tokens"] == 77


def test_sentencepiece_models(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([Row(doc_id=1, text="Hello world"), Row(doc_id=2, text=None)])
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs, path, new_path(spark, "test-cache")).collect()}
    assert got == {1: len(own.encode("Hello world")), 2: 0}


def test_query(spark, small_tables, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    got = tc.op5_token_counts(spark, small_tables).collect()
    assert len(got) == len(docs)
    for r in got:
        n = library(docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(empty, PATH, new_path(spark, "test-cache")).collect() == []

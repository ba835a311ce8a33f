"""The corpus pipeline: quality rules, near-duplicate removal, mixing, byte-level BPE.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further columns:
null and empty texts have no words, so the first stage rejects them; a stage that is called on its own with such rows
treats a null text as an empty one. Rows with null ids are judged like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, near_copies, quality
from docloom.session import new_path, scratch

#: Which documents go in a filtering stage follows from models fitted while running; SQL can't express that.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Copies share four fifths of their shingles of five words; fingerprints and bands name candidates only.
    """
    return near_copies.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives back the text's bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    coded = bpe.round_trip(texts, path, carry=["doc_id", "lang", "source", "text_sha256"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each one's result is written, and what it wrote on the way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1], 1):
        path = new_path(spark, f"stage-{at}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Token counts through a digest cache.

The digest of a text's normalised content and the digest of the tokenizer's file together name a count. Texts are
joined to the stored counts by these digests; of what is missing, one text per digest is encoded, and its count is
appended to the cache. Normalising may only merge texts that have the same count under the tokenizer, so it is a
parameter that goes with it.

What moves: texts cross the network once, and only to the tasks that encode them, keyed by digest and row id so that
copies spread out, or not at all if there are at most ``FEW`` misses, which are then broadcast to the texts; everything
else that is shuffled is a digest with a number. The cache is Parquet, one folder per
tokenizer version; appending the same count twice (after a retry, or by two jobs) is harmless.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); null ids are kept; repeated rows each get
the count; an empty table gives an empty result; other columns are carried if named, and an output column replaces
a carried column of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_map, quoted, slices
from docloom.llm.bpe import CACHED_WORDS, byte_table
from docloom.session import materialise, new_path

#: So many digests of missing texts are broadcast.
FEW = 1 << 12
CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


def plain(text: Column) -> Column:
    """No normalising: right for any tokenizer."""
    return text


def collapsed_spaces(text: Column) -> Column:
    """Runs of ASCII white space as one space: right for tokenizers that do so themselves, as word_bpe_49k does."""
    return F.regexp_replace(text, "[\\t-\\r ]+", " ")


@lru_cache(maxsize=8)
def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of each text, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    count_whole = lambda texts: [len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    pattern = lower_word_pattern(described)
    if pattern is None:
        return count_whole
    split, counts = regex.compile(pattern).findall, WordCounts(whole.model.tokenize)
    special = regex.compile("|".join([regex.escape(x["content"]) for x in described["added_tokens"]] + ["[^\\x00-\\u024f]"]))

    def count(texts: list[str]) -> list[int]:
        odd = [i for i, x in enumerate(texts) if special.search(x)]
        whole_counts = dict(zip(odd, count_whole([texts[i] for i in odd]))) if odd else {}
        return [whole_counts[i] if i in whole_counts else sum(map(counts.__getitem__, split(x.lower()))) for i, x in enumerate(texts)]

    return count


def lower_word_pattern(described: dict) -> str | None:
    """The word pattern of a tokenizer that composes, collapses white space, lower-cases, and then counts word by word.

    For texts within the Latin blocks (below U+0250, so without combining marks) and without special tokens that
    equals lower-casing and summing the counts of the pattern's matches. None for any other kind of tokenizer.
    """
    normal = (described.get("normalizer") or {}).get("normalizers", [])
    pre = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
        return None
    blank, cut, level = normal[1], pre[0], pre[1]
    if blank["pattern"].get("Regex") != r"\s+" or blank["content"] != " " or level["use_regex"] or level["add_prefix_space"]:
        return None
    if (cut["behavior"], cut["invert"]) != ("Removed", True) or described.get("post_processor"):
        return None
    return cut["pattern"].get("Regex")


class WordCounts(dict):
    """Tokens of words; what is missing is counted by the tokenizer's model."""

    def __init__(self, tokenize: Callable[[str], list]) -> None:
        super().__init__()
        self.tokenize = tokenize
        self.chars = dict(enumerate(byte_table()))

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = n = len(self.tokenize(word.encode().decode("latin-1").translate(self.chars)))
        return n


def content_digest(text: Column, normalise: Callable[[Column], Column]) -> Column:
    return F.unhex(F.sha2(normalise(F.coalesce(text, F.lit(""))), 256))


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Digest and count of one tokenizer version; empty if nothing was stored yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache_path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = plain,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` of every row; new counts are in the cache afterwards."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(quoted(text_col), F.lit(""))
    row_key = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    keyed = docs.select(quoted(id_col).alias("id"), row_key.alias("row_key"), content_digest(quoted(text_col), normalise).alias("digest"), text.alias("text"))
    rows = materialise(keyed.select("id", "row_key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows")

    firsts = rows.groupBy("digest").agg(F.min("row_key").alias("row_key"))
    misses = materialise(firsts.join(read_cache(spark, cache_path, version), "digest", "left_anti"), "misses")
    misses = F.broadcast(misses) if misses.count() <= FEW else misses.hint("shuffle_hash")
    texts = keyed.select("digest", "row_key", "text").join(misses, ["digest", "row_key"], "left_semi")

    def kernel(column: pa.Array) -> list:
        count = counter(tokenizer_path)
        counts = [n for part in slices(column.to_pylist()) for n in count(part)]
        return [pa.array(np.array(counts, np.int64))]

    counted = arrow_map(texts, ["digest"], [F.col("text")], [T.StructField("n_tokens", T.LongType())], kernel)
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows may repeat, id included
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    known = materialise(read_cache(spark, cache_path, version), "known-counts")  # a join of two scans can be split where a digest is hot
    return rows.join(known, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """Tokens of every document under word_bpe_49k. A run without ``cache_path`` starts a cache of its own, so that
    its cost doesn't depend on what ran before."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache_path or new_path(spark, "token-cache"), normalise=collapsed_spaces)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)

"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a ``tokenizers`` BPE model: every byte is written as one printable
character, so that tokens are strings, and each token lists all pairs of tokens that it can be merged from, in rank
order. Encoding splits text into words by ``PATTERN``; each worker keeps the ids of the words it has met, so that the
library's merges run once for a frequent word. A token's span is that of the characters its bytes belong to: a
token that holds only some bytes of a character has the whole character in its span, so that spans cover the text and
overlap just where a character is split. Decoding joins the tokens' characters and reverses the byte table; a character
whose bytes are split over tokens comes back whole.

Defined results: a null text encodes as the empty text (no ids); null ids decode to empty bytes; bytes that are not
UTF-8 decode with replacement characters in the text form and unchanged in the byte form. Rows are independent, so
ties, repeated rows, empty tables and any other columns pass through. Output columns replace input columns of the
same name.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import arrow_map, quoted

#: A worker keeps the ids of about so many distinct words, then starts anew.
CACHED_WORDS = 300_000

#: A fixed value: the pattern that splits text into words for this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def to_chars(data: bytes) -> str:
    table = byte_table()
    return "".join(table[b] for b in data)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose join is a token, in the order in which they may merge.

    Pairs that make the same token have one rank in a rank file, and the leftmost goes first where two overlap.
    Two such pairs can only overlap if the token begins and ends with a common part; the pair that leaves this part
    on the right then stands further left and comes first.
    """
    pairs = []
    for token in sorted(ranks, key=ranks.__getitem__):
        n = len(token)
        cuts = [i for i in range(1, n) if token[:i] in ranks and token[i:] in ranks]
        first = {n - i for i in range(1, n) if token[:i] == token[n - i :]} if len(cuts) > 1 else set()
        pairs += [(token[:i], token[i:]) for i in sorted(cuts, key=lambda i: (i not in first, i))]
    return pairs


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a rank file; one per worker process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    model = models.BPE(
        vocab={to_chars(token): rank for token, rank in ranks.items()},
        merges=[(to_chars(a), to_chars(b)) for a, b in merge_pairs(ranks)],
        ignore_merges=True,  # a word that is a token is that token
        cache_capacity=0,  # slower than merging anew
    )
    built = Tokenizer(model)
    built.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return built


class Words(dict):
    """The ids of words, as bytes of int32; what is missing is made by the tokenizer's model.

    ``splits`` has how many tokens begin inside a character, of words that have such, and ``gaps`` has words of which
    not all bytes are in a token.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenize = tokenizer(path).model.tokenize
        self.chars = dict(enumerate(byte_table()))
        self.sizes = {rank: len(token) for token, rank in read_ranks(path).items()}
        self.splits: dict[str, int] = {}
        self.gaps: set[str] = set()

    def bounded(self) -> Words:
        """These, or none if they have become too many. To be called between texts."""
        if len(self) >= CACHED_WORDS:
            self.clear()
            self.splits.clear()
        return self

    def tokens(self, word: str) -> tuple[bytes, list]:
        data = word.encode()
        return data, self.tokenize(data.decode("latin-1").translate(self.chars))

    def __missing__(self, word: str) -> bytes:
        data, tokens = self.tokens(word)
        named = [t.id for t in tokens]
        upto = list(accumulate(map(self.sizes.__getitem__, named)))
        if not upto or upto[-1] != len(data):
            self.gaps.add(word)
        elif len(data) > len(word) and (n := sum(data[i] & 0xC0 == 0x80 for i in upto[:-1])):
            self.splits[word] = n
        self[word] = ids = array("i", named).tobytes()
        return ids


class Spans(dict):
    """Of words: the starts and ends of their tokens' spans of characters, and their number."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokens = words(path).tokens

    def __missing__(self, word: str) -> tuple[bytes, bytes, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        data, tokens = self.tokens(word)
        upto = list(accumulate((len(t.value) for t in tokens), initial=0))
        spans = list(zip(upto, upto[1:]))
        if len(data) > len(word):
            char_of = [i for i, c in enumerate(word) for _ in c.encode()]
            spans = [(char_of[a], char_of[b - 1] + 1) for a, b in spans]
        self[word] = known = (*(array("i", x).tobytes() for x in zip(*spans)), len(spans))
        return known


@lru_cache(maxsize=2)
def spans(path: str) -> Spans:
    return Spans(path)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


@lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(maxsize=2)
def token_chars(path: str) -> dict[int, str]:
    """The characters of each token, one a byte."""
    return {rank: to_chars(token) for token, rank in read_ranks(path).items()}


@lru_cache(maxsize=1)
def byte_of() -> np.ndarray:
    """The byte table reversed: the byte for which each character stands, by code point."""
    out = np.zeros(0x200, np.uint8)
    for byte, char in enumerate(byte_table()):
        out[ord(char)] = byte
    return out


def joined(ids: list[int], path: str) -> bytes:
    """The bytes of a list of ids."""
    chars = "".join(map(token_chars(path).__getitem__, ids))
    return byte_of()[np.frombuffer(chars.encode("utf-16-le"), np.uint16)].tobytes()


def _coded(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text, as bytes of int32."""
    known, split = words(path), splitter().findall
    return [b"".join(map(known.bounded().__getitem__, split(x))) if x else b"" for x in texts]


def spanned(text: str | None, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The starts and ends of the spans of a text's tokens."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    found = splitter().findall(text)
    starts, ends, counts = zip(*map(spans(path).__getitem__, found))
    upto = np.cumsum(np.fromiter(map(len, found), np.int32, len(found)), dtype=np.int32)
    before = np.repeat(np.concatenate([[np.int32(0)], upto[:-1]]), counts)
    return np.frombuffer(b"".join(starts), np.int32) + before, np.frombuffer(b"".join(ends), np.int32) + before


def _id_lists(coded: list[bytes]) -> pa.Array:
    return _lists([len(x) // 4 for x in coded], np.frombuffer(b"".join(coded), np.int32))


def _lists(lengths: list[int], values: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, offsets: bool = False, ids_col: str = "ids", starts_col: str = "starts", ends_col: str = "ends") -> DataFrame:
    """``carry`` (default: all columns) and ``ids array<int>``; with ``offsets`` also each token's span of characters.

    A token that holds only some bytes of a character has that whole character as its span.
    """
    ints = T.ArrayType(T.IntegerType(), False)
    outputs = [T.StructField(x, ints) for x in ([ids_col, starts_col, ends_col] if offsets else [ids_col])]

    def plain(texts: pa.Array) -> list:
        return [_id_lists(_coded(texts.to_pylist(), path))]

    def with_spans(texts: pa.Array) -> list:
        told = texts.to_pylist()
        each = [spanned(x, path) for x in told]
        lengths = [len(x) for x, _ in each]
        return [_id_lists(_coded(told, path))] + [_lists(lengths, np.concatenate([*(x[at] for x in each), np.zeros(0, np.int32)]).astype(np.int32)) for at in (0, 1)]

    kernel = with_spans if offsets else plain
    return arrow_map(docs, docs.columns if carry is None else carry, [quoted(text_col)], outputs, kernel)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None, bytes_col: str = "decoded", as_text: bool = False) -> DataFrame:
    """``carry`` (default: all columns) and the decoded bytes, or with ``as_text`` the decoded string."""
    outputs = [T.StructField(bytes_col, T.StringType() if as_text else T.BinaryType())]

    def kernel(ids: pa.Array) -> list:
        made = [joined(x, path) if x else b"" for x in ids.to_pylist()]
        if as_text:
            return [pa.array([x.decode("utf-8", "replace") for x in made], pa.string())]
        return [pa.array(made, pa.binary())]

    return arrow_map(frame, frame.columns if carry is None else carry, [quoted(ids_col)], outputs, kernel)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass of the executors' Python: ids, and the bytes that they decode to.

    Besides ``n_split``, how many tokens begin inside a character, and ``covered``, whether the tokens' spans cover the
    text without a gap: both are sums over words, as no token goes beyond one.
    """
    outputs = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(bytes_col, T.BinaryType()), T.StructField("n_split", T.LongType()), T.StructField("covered", T.BooleanType())]

    def kernel(texts: pa.Array) -> list:
        known, find = words(path), splitter().findall
        coded, decoded, split, covered = [], [], [], []
        for text in texts.to_pylist():
            found = find(text) if text else []
            ids = b"".join(map(known.bounded().__getitem__, found))
            coded.append(ids)
            decoded.append(joined(np.frombuffer(ids, np.int32).tolist(), path))
            split.append(0 if not text or text.isascii() else sum(map(known.splits.__getitem__, filter(known.splits.__contains__, found))))
            covered.append(sum(map(len, found)) == len(text or "") and known.gaps.isdisjoint(found))
        return [_id_lists(coded), pa.array(decoded, pa.binary()), pa.array(split, pa.int64()), pa.array(covered, pa.bool_())]

    return arrow_map(docs, docs.columns if carry is None else carry, [quoted(text_col)], outputs, kernel)


def token_texts(ids: list[int], path: str) -> list[str]:
    """The text that each token completes: a split character belongs to the token that holds its last byte."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(joined([i], path), final=at == len(ids)) for at, i in enumerate(ids, 1)]


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` encoded by the multilingual rank file and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = round_trip(docs, path, carry=["doc_id"])
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
        "covered",
    )

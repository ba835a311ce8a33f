"""Alignment of two tokenizers' tokens by the bytes they cover, and counts of which tokens meet.

Both tokenizers are applied to a space and the text. Neither joins a blank to the character before it, so texts are cut
before blanks that follow something else, and each distinct piece of a block of rows is encoded once. Per Arrow
partition DuckDB holds the two tables of token intervals, in which pieces follow each other on one line of bytes:
as-of joins find the first and the last B token that an A token meets, a range join names those between, and window sums
over the offsets where both end number the groups. A block's pairs of ids are counted there; Spark merges the partial
counts of all blocks, finds each B id's highest, and a second pass looks its links up.

The merged counts are one row for each pair of ids that meet anywhere. Vocabularies bound them, not the corpus; up to
``PAIRS`` of them go to every task, and beyond that the documents' own pairs travel to the counts instead. A block is
rows with ``PIECES`` distinct pieces or ``BLOCK_WORDS`` pieces in all, or one text; DuckDB gets the distinct pieces in
slices of ``SLICE_BYTES`` or one piece, so only a text or a piece without blanks that is itself huge makes a task large.

Defined results: a null or empty text, and a text whose joined token bytes under either tokenizer aren't a space and
the text, has no tokens: zeros, an empty string, and no part in the counts. Repeated rows count each. Null ids are kept.
An empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted, small_batches
from docloom.llm.bpe import byte_table
from docloom.session import materialise, ship_package

PIECES, BLOCK_WORDS, SLICE_BYTES = 600_000, 1 << 23, 1 << 20
#: So many pairs of ids, with their counts, go to every task.
PAIRS = 1 << 21

_CUT, _RUN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


@dataclass
class Tokens:
    """Encodes pieces, given without the blank that they begin with; the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    ids: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(x) for x in self.ids], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ids.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """A byte-level BPE file of the tokenizers library, without special tokens.

    If ids rise with the merges, as in the file that the contract names, the ranks library gives the same ids faster.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_table())}
    vocab: dict[str, int] = described["model"]["vocab"]
    special = {x["id"] for x in described["added_tokens"]}
    table = [b""] * (max([*vocab.values(), *special]) + 1)
    for token, i in vocab.items():
        table[i] = token.encode() if i in special else b"".join(byte_of[c] for c in token)
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
    level = described["pre_tokenizer"] or {}
    plain = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not described.get("normalizer")
    ranks = {table[i]: i for i in vocab.values() if i not in special}
    if plain and merged == sorted(merged) and set(merged) | {ranks.get(bytes([b]), -1) for b in range(256)} == set(ranks.values()):
        import public_tokenizers
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Tokens(lambda pieces: [coder.encode_ordinary(" " + x) for x in pieces], table)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    return Tokens(lambda pieces: [x.ids for x in whole.encode_batch_fast([" " + x for x in pieces], add_special_tokens=False)], table)


@lru_cache(maxsize=2)
def byte_fallback(path: str) -> Tokens:
    """A sentencepiece model that puts a blank before a text."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = [pieces.piece_to_id("▁")]

    def bytes_of(i: int) -> bytes:
        return bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [x or blank for x in pieces.encode(texts, num_threads=1)]

    return Tokens(encode, [bytes_of(i) for i in range(pieces.vocab_size())])


def cut(text: str) -> list[str]:
    """The pieces of a blank and a text, each without the blank that it begins with."""
    if text[0] != " " and not _RUN.search(text):
        return text.split(" ")
    return [piece[1:] for piece in _CUT.split(" " + text)]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has: one or more."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


@dataclass
class Line:
    """Ids under both tokenizers, in order, of pieces whose bytes both give back."""

    pieces: np.ndarray  # numbers of these pieces
    ids: list[np.ndarray]
    counts: list[np.ndarray]  # of ids, for each piece

    @classmethod
    def of(cls, pieces: list[str], first: int, both: tuple[Tokens, Tokens]) -> Line:
        wholes = [b" " + piece.encode() for piece in pieces]
        line, sizes = b"".join(wholes), np.fromiter(map(len, wholes), np.int64, len(wholes))
        coded = [tokens.encode(pieces) for tokens in both]
        right = np.ones(len(pieces), bool)
        flat, counts = zip(*map(flattened, coded))
        for tokens, ids, own, n in zip(both, coded, flat, counts):
            if not (np.array_equal(np.add.reduceat(tokens.sizes[own], np.cumsum(n) - n), sizes) and tokens.joined(own.tolist()) == line):
                right &= np.array([tokens.joined(x) == whole for x, whole in zip(ids, wholes)], bool)
        if not right.all():
            flat, counts = zip(*(flattened([x for x, fine in zip(ids, right) if fine]) for ids in coded))
        return cls(first + np.flatnonzero(right), list(flat), list(counts))

    def tables(self, both: tuple[Tokens, Tokens]) -> list[pa.Table]:
        """The tokens' intervals, one piece after the other."""
        made = []
        for tokens, ids, counts in zip(both, self.ids, self.counts):
            sizes = tokens.sizes[ids]
            ends = np.cumsum(sizes)
            made.append(pa.table({"k": np.arange(len(ids)), "piece": np.repeat(self.pieces, counts), "s": ends - sizes, "e": ends, "id": ids}))
        return made


#: From tables a and b, intervals on one line: links (piece, a, b), and the tokens with the numbers of their groups.
_LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
WITH lows AS (SELECT a.k, a.piece, a.id, b.k AS low FROM a ASOF JOIN b ON a.s >= b.s),
     highs AS (SELECT a.k, b.k AS high FROM a ASOF JOIN b ON a.e > b.s),
     spans AS (SELECT piece, id, unnest(range(low, high + 1)) AS k FROM lows JOIN highs USING (k))
SELECT spans.piece, spans.id AS a, b.id AS b FROM spans JOIN b USING (k)"""
_GROUPS = """
SELECT x.k, x.piece, x.id, coalesce(sum((y.e IS NOT NULL)::INT) OVER (ORDER BY x.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM {0} x LEFT JOIN {1} y USING (e) ORDER BY x.k"""
_COUNTED = "SELECT a, b, sum(rows)::BIGINT AS n FROM links JOIN used USING (piece) WHERE rows > 0 GROUP BY a, b"
_LOOKED_UP = "SELECT piece, count(*) AS n_links, sum(n)::BIGINT AS count_sum, sum(best::INT)::BIGINT AS n_best FROM links JOIN counts USING (a, b) GROUP BY piece"
_OWN = "SELECT piece, a, b, count(*) AS n FROM links GROUP BY ALL"


def connection() -> object:
    import duckdb

    return duckdb.connect(config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})


def joined_groups(con: object) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of the tables a and b: each group's piece; the pieces in order, their numbers of groups and their groups as text."""
    texts, piece_of = [], None
    for x, y in (("a", "b"), ("b", "a")):
        rows = con.sql(_GROUPS.format(x, y)).to_arrow_table().combine_chunks()
        g = rows["g"].to_numpy()
        starts = np.flatnonzero(np.diff(g, prepend=-1)).astype(np.int32)
        ids = pc.cast(rows["id"].combine_chunks(), pa.string())
        texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(g)).astype(np.int32)), ids), ","))
        piece_of = rows["piece"].to_numpy()[starts]
    both = pc.binary_join_element_wise(*texts, "|")
    starts = np.flatnonzero(np.diff(piece_of, prepend=-1)).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(piece_of)).astype(np.int32)), both), ";")
    return piece_of[starts], np.diff(np.append(starts, len(piece_of))), whole.to_pylist()


class Numbers(dict):
    """Numbers pieces as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Block:
    """Rows' pieces as numbers, and the distinct pieces."""

    def __init__(self) -> None:
        self.known, self.ids, self.rows, self.words = Numbers(), [], [], 0

    def add(self, row_id: int | None, text: str | None) -> None:
        words = list(map(self.known.__getitem__, cut(text))) if text else []
        self.ids.append(row_id)
        self.rows.append(np.array(words, np.int32))
        self.words += len(words)

    def full(self) -> bool:
        return len(self.known) >= PIECES or self.words >= BLOCK_WORDS

    def lines(self, both: tuple[Tokens, Tokens]) -> Iterator[Line]:
        pieces = list(self.known)
        start, held = 0, 0
        for i, piece in enumerate(pieces):
            held += len(piece) + 1
            if held >= SLICE_BYTES or i + 1 == len(pieces):
                yield Line.of(pieces[start : i + 1], start, both)
                start, held = i + 1, 0

    def right(self, lines: list[Line]) -> list[bool]:
        """Rows that have pieces, all of them on a line."""
        fine = np.zeros(len(self.known), bool)
        for line in lines:
            fine[line.pieces] = True
        return [bool(len(r)) and bool(fine[r].all()) for r in self.rows]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """From batches of (id, text)."""
    block = Block()
    for batch in small_batches(batches):
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block.add(row_id, text)
            if block.full():
                yield block
                block = Block()
    if block.ids:
        yield block


def pair_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n, best) of all links of rows (id, text): how many links join ids a and b, and whether none of b's pairs has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, con = (byte_level(a_path), byte_fallback(b_path)), connection()
        for block in _blocks(batches):
            lines = list(block.lines(both))
            counted = [r for r, ok in zip(block.rows, block.right(lines)) if ok]
            uses = np.bincount(np.concatenate([*counted, np.zeros(0, np.int32)]), minlength=len(block.known))
            for line in lines:
                if len(line.pieces):
                    used = pa.table({"piece": line.pieces, "rows": uses[line.pieces]})
                    for name, table in zip(("a", "b", "used"), (*line.tables(both), used)):
                        con.register(name, table)
                    con.execute(_LINKS)
                    for part in con.sql(_COUNTED).to_arrow_table().to_batches():
                        yield pa.RecordBatch.from_arrays(part.columns, names=["a", "b", "n"])
        pa.default_memory_pool().release_unused()

    partial = texts.select("id", "text").mapInArrow(count, "a int, b int, n long")
    merged = materialise(partial.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    highest = merged.groupBy("b").agg(F.max("n").alias("most"))
    return materialise(merged.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_ROW = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _aligner(a_path: str, b_path: str, counts: object | None) -> Callable:
    """Rows of _ROW; without ``counts`` also the row's own pairs of ids, whose counts are looked up elsewhere."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, con = (byte_level(a_path), byte_fallback(b_path)), connection()
        if counts is not None:
            con.register("sent", pa.ipc.open_stream(counts.value).read_all())
            con.execute("CREATE TEMP TABLE counts AS SELECT * FROM sent")
        for block in _blocks(batches):
            n = len(block.known)
            sums = {name: np.zeros(n, np.int64) for name in _SUMS}
            texts: list[str] = [""] * n
            own: list[pa.Table] = []
            lines = list(block.lines(both))
            right = block.right(lines)
            for line in lines:
                if not len(line.pieces):
                    continue
                for name, table in zip("ab", line.tables(both)):
                    con.register(name, table)
                con.execute(_LINKS)
                sums["n_a"][line.pieces], sums["n_b"][line.pieces] = line.counts
                pieces, groups, joined = joined_groups(con)
                sums["n_groups"][pieces] = groups
                for i, text in zip(pieces.tolist(), joined):
                    texts[i] = text
                if counts is None:
                    own.append(con.sql(_OWN).to_arrow_table())
                    continue
                looked = con.sql(_LOOKED_UP).to_arrow_table()
                for name in ("n_links", "n_best", "count_sum"):
                    sums[name][looked["piece"].to_numpy()] = looked[name].to_numpy()
            empty = np.zeros(0, np.int32)
            rows = [r if ok else empty for r, ok in zip(block.rows, right)]
            digests = [sha256(";".join(map(texts.__getitem__, r.tolist())).encode()).hexdigest() if ok else "" for r, ok in zip(rows, right)]
            columns = [pa.array(block.ids, pa.int64())] + [pa.array([int(sums[name][r].sum()) for r in rows], pa.int64()) for name in _SUMS] + [pa.array(digests)]
            names = ["id", *_SUMS, "groups_sha256"]
            if counts is None:
                columns.append(_pairs_of(rows, n, own))
                names.append("pairs")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()

    return align


def _pairs_of(rows: list[np.ndarray], n: int, own: list[pa.Table]) -> pa.Array:
    """Each row's pairs of ids with how many of its links join them."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))
    by_piece: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for table in own:
        for piece, a, b, m in zip(*(table[c].to_pylist() for c in ("piece", "a", "b", "n"))):
            by_piece[piece].append((a, b, m))
    out = []
    for r in rows:
        found: dict[tuple[int, int], int] = {}
        for piece in r.tolist():
            for a, b, m in by_piece[piece]:
                found[a, b] = found.get((a, b), 0) + m
        out.append([{"a": a, "b": b, "m": m} for (a, b), m in found.items()])
    return pa.array(out, kind)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = PAIRS) -> DataFrame:
    """``id`` and the sums over each row's tokens, groups and links; see the module's docstring."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    pairs = pair_counts(texts, a_path, b_path)
    if pairs.count() <= most_pairs:
        table = pairs.toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        return texts.mapInArrow(_aligner(a_path, b_path, sent), _ROW)
    rows = texts.mapInArrow(_aligner(a_path, b_path, None), f"{_ROW}, pairs array<struct<a: int, b: int, m: long>>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    links = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.*").join(pairs, ["a", "b"])
    found = links.groupBy("row").agg(F.sum("m").alias("l"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("h"), F.sum(F.col("m") * F.col("n")).alias("c"))
    whole = rows.drop("pairs", "n_links", "n_best", "count_sum").join(found, "row", "left")
    zero = F.lit(0).cast("long")
    return whole.select("id", "n_a", "n_b", "n_groups", F.coalesce("l", zero).alias("n_links"), F.coalesce("h", zero).alias("n_best"), F.coalesce("c", zero).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte_bpe_50k with piece_bpe_32k over every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")

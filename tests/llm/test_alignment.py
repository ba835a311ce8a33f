"""Alignment against whole texts encoded by the libraries and walked token by token."""

from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import alignment
from docloom.llm.alignment import align, byte_level, cut, op13_token_alignment
from docloom.llm.bpe import byte_table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=B)


def walked(libraries, text):
    """Ids of both, groups as text, links; None if a tokenizer doesn't give back the bytes."""
    whole, pieces = libraries
    byte_of = {c: b for b, c in enumerate(byte_table())}
    bytes_of = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    coded = whole.encode(" " + text, add_special_tokens=False)
    ids = (coded.ids, pieces.encode(text))
    parts = ([bytes(byte_of[c] for c in t) for t in coded.tokens], [bytes_of(i) for i in ids[1]])
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    owners = [[i for i, t in enumerate(p) for _ in t] for p in parts]  # of each byte
    links = [(ids[0][x], ids[1][y]) for x, y in sorted(set(zip(*owners)))]
    ends = [Counter(), Counter()]
    for side in (0, 1):
        at = 0
        for t in parts[side]:
            at += len(t)
            ends[side][at] += 1
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, start = [], 0
    for end in cuts:
        groups.append("|".join(",".join(str(ids[side][i]) for i in dict.fromkeys(owners[side][start:end])) for side in (0, 1)))
        start = end
    return ids, groups, links


def expected(libraries, texts):
    """For each text in order the sums and the digest."""
    seen = [walked(libraries, x) if x else None for x in texts]
    counts = Counter(link for s in seen if s for link in s[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for s in seen:
        if s is None:
            out.append(NONE)
            continue
        ids, groups, links = s
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), best, sum(counts[x] for x in links), sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "\n", "a\n b", "don't it's 12345 6", "x" * 20_000, "word " * 5_000, "ab▁cd", "é é", "<s> </s> <|endoftext|>",
    " a　b", "a\x00b\x85 c", "\U0001f600\U0001f468‍\U0001f469 中文字 ก", "tab\t tab \r\n\x0b\x0c end", "ends " + " " * 40, "same", "same", "9" * 700,
]


@pytest.mark.parametrize("most_pairs", [alignment.PAIRS, 1])
def test_odd_texts(spark, libraries, most_pairs):
    """Nulls, blanks, long texts, special strings and repeated rows, by both ways of looking counts up."""
    rows = list(enumerate(ODD)) + [(None, "same"), (None, None)]
    got = align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, most_pairs=most_pairs).select(COLUMNS).collect()
    truth = sorted(((i, *e) for (i, _), e in zip(rows, expected(libraries, [x for _, x in rows]))), key=repr)
    assert sorted(map(tuple, got), key=repr) == truth


def test_whole_query(spark, small_tables, libraries):
    rows = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_token_alignment(spark, small_tables).select("doc_id", *COLUMNS[1:]).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], expected(libraries, [r["text"] for r in rows])))
    assert sum(v[4] for v in got.values()) < sum(v[3] for v in got.values())


def test_small_blocks_and_slices(spark, libraries, monkeypatch):
    """What a block or a slice holds doesn't change the result."""
    texts = [f"The number {i} of {i * i} words, repeated; Wörter und Straße {i % 3}." * (1 + i % 4) for i in range(40)] + ODD
    truth = expected(libraries, texts)
    for pieces, words, piece in ((5, 1 << 20, 50), (1 << 20, 100, 100), (1 << 20, 1 << 20, 300)):
        monkeypatch.setattr(alignment, "PIECES", pieces)
        monkeypatch.setattr(alignment, "BLOCK_WORDS", words)
        monkeypatch.setattr(alignment, "SLICE_BYTES", piece)
        batches = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}).to_batches()
        rows = [r for b in alignment._aligner(A, B, None)(iter(batches)) for r in b.to_pylist()]
        assert [(r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in rows] == [(*t[:3], t[6]) for t in truth]
        assert [sum(p["m"] for p in r["pairs"]) for r in rows] == [t[3] for t in truth]


def test_cuts_are_exact(libraries):
    """Pieces encoded one by one give the ids of the whole text."""
    one, other = byte_level(A), alignment.byte_fallback(B)
    for x in filter(None, ODD):
        assert [i for ids in one.encode(cut(x)) for i in ids] == libraries[0].encode(" " + x, add_special_tokens=False).ids
        assert [i for ids in other.encode(cut(x)) for i in ids] == libraries[1].encode(x)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align(none, A, B).collect() == []
    df = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    more = df.withColumns({c: F.lit("x") for c in (*COLUMNS, "a", "b", "n", "row", "pairs", "best")})
    assert sorted(align(more, A, B).collect()) == sorted(align(df, A, B).collect())

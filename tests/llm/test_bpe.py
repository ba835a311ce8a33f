import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from docloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "Hello  world\n\n it's", "naïve 日本語 😀 text", "aaaaaaaaaaaa    \t b", "x" * 5000, "<|endoftext|> 123456", "ی‌ب Ωmega\r\n", " word" * 3000, " ", "́á"]


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_vocabularys():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_ids_and_round_trip(spark, plain):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash") for i, t in enumerate(TEXTS)] + [Row(doc_id=None, text=None, ids=None)])
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r["ids"] == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_offsets_give_whole_characters(spark, plain):
    docs = spark.createDataFrame([Row(text=t) for t in TEXTS])
    for r in bpe.encode(docs, PATH, offsets=True).collect():
        assert r["ids"] == plain.encode_ordinary(r["text"])
        covered = set()
        for s, e in zip(r["starts"], r["ends"]):
            covered |= set(range(s, e))
        assert covered == set(range(len(r["text"])))
        whole = bpe.tokenizer(PATH).encode(r["text"], add_special_tokens=False)
        assert (r["ids"], list(zip(r["starts"], r["ends"]))) == (whole.ids, whole.offsets)


def test_decoding_reverses_the_byte_table():
    assert [bpe.byte_of()[ord(c)] for c in bpe.byte_table()] == list(range(256))
    ranks = bpe.read_ranks(PATH)
    for token in (bytes([0]), bytes([0x20]), bytes([0xAD]), bytes([0xFF])):
        assert bpe.token_chars(PATH)[ranks[token]] == bpe.to_chars(token) != token.decode("latin-1") or token == b"\xff"
        assert bpe.joined([ranks[token]], PATH) == token


def test_split_characters_are_counted(spark, plain):
    texts = ["plain", "a😀ж𝔘", "", None, "\U0001f9ff\U0001f9ff x"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    for r in bpe.round_trip(docs, PATH).collect():
        ids, at, split = plain.encode_ordinary(r["text"] or ""), 0, 0
        for i in ids:
            token = plain.decode_single_token_bytes(i)
            split += at > 0 and token[0] & 0xC0 == 0x80
            at += len(token)
        assert (r["n_split"], r["covered"]) == (split, True)


def test_split_characters_come_back_whole(plain):
    ids = plain.encode_ordinary("a😀ж𝔘")
    assert "".join(bpe.token_texts(ids, PATH)) == "a😀ж𝔘"
    assert bpe.token_texts([], PATH) == []


def test_text_form_replaces_what_is_no_utf8(spark):
    broken = bpe.read_ranks(PATH)[b"\xf0"]
    frame = spark.createDataFrame([Row(ids=[broken])])
    assert bpe.decode(frame, PATH, as_text=True).first()["decoded"] == "�"
    assert bytes(bpe.decode(frame, PATH).first()["decoded"]) == b"\xf0"


def test_odd_alphabets_agree_with_brute_force(plain):
    import random

    draw = random.Random(3)
    words, split = bpe.words(PATH), bpe.splitter().findall
    for alphabet in ["ab", " \n\t", "=-", "aA1 ", "日本 ", "'st dre", "\x1c\x85​ ᠎a", "😀a "]:
        for _ in range(300):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60)))
            ids = list(memoryview(b"".join(words[w] for w in split(text))).cast("i"))
            assert ids == plain.encode_ordinary(text), text


def test_query_digests(spark, small_tables, plain):
    rows = {r["doc_id"]: r for r in bpe.op1_bpe_round_trip(spark, small_tables).collect()}
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = plain.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
        assert r["covered"]


def test_one_pass_equals_two(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate([*TEXTS, None])])
    both = bpe.round_trip(docs, PATH).drop("n_split", "covered").orderBy("doc_id").collect()
    assert both == bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []

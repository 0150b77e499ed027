"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from folioflow.llm import byte_bpe

ODD = ["a", "e", "aa", " ", "  ", "\n", "\t", "　", "é", "🙂", "1", "22", "'s", "'ll", "-", "====", "x", "́", "中", "\x00", "\r\n", "\x85", "the", "\x1c", "\x1f", "!", "​", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = ["".join(rng.choices(ODD, k=rng.randint(1, 60))) for _ in range(300)]
    any_char = ["".join(chr(rng.choice([rng.randrange(0x500), rng.randrange(0x500, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(100)]
    return [*odd, *any_char, None, "", "   ", "a" * 300_000, "word, " * 60_000, " " * 5000 + "x", "the quick " * 3]


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("at_space", [True, False])
def test_ids_and_bytes_are_those_of_tiktoken(spark, ranks, texts, plain, at_space):
    df = spark.createDataFrame([(i % 50, t, "clash", i) for i, t in enumerate(texts)], "doc_id int, text string, ids string, starts int").repartition(3)
    coded = byte_bpe.encode(df, ranks, P.PATTERN, at_space=at_space)
    assert coded.columns == ["doc_id", "ids"]
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded), r.decoded_text) for r in byte_bpe.decode(coded, ranks).collect())
    want = sorted((i % 50, plain.encode_ordinary(t or ""), (t or "").encode(), t or "") for i, t in enumerate(texts))
    assert got == want
    assert byte_bpe.encode(df.limit(0), ranks, P.PATTERN).count() == 0


def test_spans_cover_the_characters_of_each_token(spark, ranks, texts, plain):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for at_space in (True, False):
        for r in byte_bpe.encode(df, ranks, P.PATTERN, offsets=True, at_space=at_space).collect():
            text, end = texts[r.doc_id] or "", 0
            assert list(r.ids) == plain.encode_ordinary(text)
            for token, a, b in zip(r.ids, r.starts, r.ends, strict=True):
                raw = plain.decode_single_token_bytes(token)
                assert raw in text[a:b].encode() and a in (end, end - 1) and a < b
                end = b
            assert end == len(text)


def test_decoding_of_windows_and_odd_lists(spark, ranks, plain):
    ids = plain.encode_ordinary("x🙂y")
    cut = next(k for k in range(1, len(ids)) if b"\xf0" in plain.decode_bytes(ids[:k]) and "�" in plain.decode(ids[:k]))
    rows = [(1, ids[:cut]), (2, ids[cut:]), (3, None), (4, []), (5, [ids[0], None])]
    got = {r.k: r for r in byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), ranks).collect()}
    assert bytes(got[1].decoded) + bytes(got[2].decoded) == "x🙂y".encode()
    assert "�" in got[1].decoded_text and "�" in got[2].decoded_text
    assert [bytes(got[k].decoded) for k in (3, 4, 5)] == [b"", b"", b"x"]
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(spark.createDataFrame([(1, [len(ranks)])], "k int, ids array<int>"), ranks).collect()
    with pytest.raises(ValueError):
        byte_bpe.decode(spark.createDataFrame([(1, [1], 2)], "k int, ids array<int>, decoded int"), ranks)
    with pytest.raises(ValueError):
        byte_bpe.tokenizer_json({b"a": 0}, P.PATTERN)


def test_tokens_that_no_merge_reaches_and_other_patterns(spark):
    """A vocabulary with a token that only a whole match can be; what the pattern doesn't match is left out."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    plain = tiktoken.Encoding("own", pat_str=r"[a-z]+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abc xyz", "xyzabc", "ab1bc", "bcbcab abcabc", "é"]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ranks, r"[a-z]+|\s+").collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


def test_op13_digests(spark, plain):
    got = byte_bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (texts[r.doc_id] or "").encode())]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]

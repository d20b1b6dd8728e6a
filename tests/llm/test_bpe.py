from __future__ import annotations

import base64
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverlake.llm import bpe
from tests.conftest import rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
ENCODER = bpe.Encoder(bpe.read_ranks(DATA), P.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abe thingßé漢 \n01!=.x", max_size=120))
def test_ids_equal_the_merges(text):
    ids = ENCODER.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert bpe.Decoder(ENCODER.entries).decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, "=" * 3000, " " * 1000 + "x", "ab" * 4000, "\u0000﻿", "👩‍🚀🇫🇮", "don't we'll"])
def test_odd_texts(text):
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


def test_long_pieces_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        ENCODER.encode_piece(b"ab" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 2)
    e = bpe.Encoder(ENCODER.entries, P.PATTERN)
    assert [e.encode(t) for t in ("a b c d", "a b c d")] == [OTHER.encode_ordinary("a b c d")] * 2 and len(e.memo) <= 2


def test_tables(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (4, " \n")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    enc = bpe.encode_texts(docs, PATH, P.PATTERN)
    assert rows(enc) == sorted([(1, OTHER.encode_ordinary("Hello world"))] * 2 + [(2, []), (3, []), (None, OTHER.encode_ordinary("x")), (4, OTHER.encode_ordinary(" \n"))], key=repr)
    assert ("Hello world",) in rows(bpe.decode_ids(enc, PATH).select("text"))
    assert rows(bpe.encode_texts(docs.limit(0), PATH, P.PATTERN)) == []
    assert rows(bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), PATH)) == [(1, None)]

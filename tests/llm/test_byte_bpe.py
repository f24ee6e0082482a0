"""Byte-level BPE against the tokenizer library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DDL = "doc_id bigint, text string, n_tokens string, ids string"


def library(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return library(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), dtype="<u4").tolist()


def test_random_texts(own, theirs):
    draw = random.Random(11)
    letters = [chr(k) for k in range(128)] + list("éüß\x85\xa0  　中文😀٠\x1c﻿​")
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        assert ids(own, text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", [
    "", " ", "a" * 900, "-" * 500, "thethethe" * 60, "x  y", " x", "x ", "a \nb", "<|endoftext|>", "it's we'll 'tis",
    "supercalifragilisticexpialidocious " * 30, "1234567890" * 40, "日本語" * 100,
])
def test_single_texts(own, theirs, text):
    assert ids(own, text) == theirs.encode_ordinary(text)


def test_other_vocabulary_and_pattern():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "Größe, naïve façade, übermäßig — 東京 and so on"
    assert ids(byte_bpe.codec(path, public_tokenizers.PATTERN), text) == library(path).encode_ordinary(text)
    assert byte_bpe.codec(PATH, r"(?s:.)").decode(np.frombuffer(
        byte_bpe.codec(PATH, r"(?s:.)").encode(text), dtype="<u4")) == text.encode()


def test_tables_are_forgotten_and_made_anew(theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 50)
    monkeypatch.setattr(byte_bpe, "PIECES", 20)
    monkeypatch.setattr(byte_bpe, "PAIRS", 30)
    small = byte_bpe.Codec(theirs._mergeable_ranks, public_tokenizers.PATTERN)
    draw = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(draw.choice("abcdethion") for _ in range(draw.randrange(1, 12))) for _ in range(20))
        assert ids(small, text) == theirs.encode_ordinary(text)
    assert len(small.transducer.states) <= 50 and len(small.parts) <= 20


def test_stream_of_chunks_cut_anywhere():
    raw = "aé中😀\x00z".encode() + b"\xff\xc3" + "ß".encode() + b"\xe4\xb8"
    for size in range(1, 8):
        stream = byte_bpe.Utf8Stream()
        out = "".join(stream.feed(raw[k:k + size]) for k in range(0, len(raw), size)) + stream.close()
        assert out == raw.decode("utf-8", "replace")


def test_rows(spark, theirs):
    texts = [None, "", " \n", "Hello  world\n", "é" * 40000, "same", "same", "a\x00b", "word " * 20000]
    docs = spark.createDataFrame([(k if k != 5 else None, t, "n", "i") for k, t in enumerate(texts)], DDL)
    got = byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for k, text in enumerate(texts):
        tokens = theirs.encode_ordinary(text or "")
        want.append((k if k != 5 else None, len(tokens), hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_encoded_then_decoded(spark):
    docs = spark.createDataFrame([(1, "Ça va? 😀"), (2, None), (3, "plain")], "doc_id bigint, text string")
    tokens = byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "n_tokens", "ids"]
    back = {r.doc_id: r.text for r in byte_bpe.decoded(tokens, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {1: "Ça va? 😀", 2: "", 3: "plain"}


def test_given_documents(spark, small, theirs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        tokens = theirs.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(tokens)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()

"""Counts against the tokenizer library's own unigram model over the same vocabulary."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from tidemark.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, bytes_too):
    vocabulary = [("<unk>", 0.0)] + ([(f"<0x{k:02X}>", 0.0) for k in range(256)] if bytes_too else []) + pieces
    made = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=bytes_too))
    made.pre_tokenizer = Metaspace()
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def theirs():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())
              if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return library(pieces, True)


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", " a", "a ", "a  b", "Hello, world!\nNew line\ttab", "naïve façade ▁ mark", "日本語の文章", "😀😀 x😀y",
    "\x00\x01", "internationalization " * 50, "x" * 400, "1234567890" * 20,
])
def test_single_texts(theirs, text):
    assert token_counts.counter(PATH).count(text) == theirs(text)


def test_random_texts(theirs):
    draw, own = random.Random(3), token_counts.counter(PATH)
    letters = list("abcdefghinorstu   \n.,'éüß中😀\x07")
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
        assert own.count(text) == theirs(text)


def test_ties_and_runs_of_unknown_characters():
    draw = random.Random(9)
    for _ in range(200):
        pieces = {"".join(draw.choice("ab▁") for _ in range(draw.randrange(1, 5))) for _ in range(12)}
        vocabulary = [(p, float(-draw.randrange(1, 4))) for p in sorted(pieces)]
        own, theirs = token_counts.Counter(vocabulary, False), library(vocabulary, False)
        # the library's lowest score is over its whole list, the unknown entry at 0 included
        for _ in range(20):
            text = "".join(draw.choice("abc ") for _ in range(draw.randrange(15)))
            assert own.count(text) == theirs(text), (vocabulary, text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "n"), (1, "", "n"), (None, "some words", "n"), (2, "word " * 20000, "n")],
                                 "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.counted(docs, PATH).collect()), key=str)
    own = token_counts.counter(PATH)
    assert got == sorted([(1, 0), (1, 0), (None, own.count("some words")), (2, own.count("word " * 20000))], key=str)
    assert token_counts.counted(docs.limit(0), PATH).count() == 0


def test_given_documents(spark, small, theirs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs, PATH).collect()}
    assert got == {r.doc_id: theirs(r.text) for r in docs.collect()}

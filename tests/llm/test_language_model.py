"""Language model: counts and base score by brute force, normalised probabilities, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_model

DDL = "doc_id bigint, text string, score string, token string"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def out(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2


def check_base(rows, got):
    c = Counter(w for i, text in rows if not out(i) for w in tokens(text))
    total, distinct = sum(c.values()), len(c)
    want = []
    for i, text in rows:
        own = tokens(text)
        want.append((i, out(i), len(own), sum(w in c for w in own), total,
                     sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in own)))
    key = lambda x: str(x[:5]) + f"{x[5]:.4f}"
    for g, w in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.scored(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_rare_tokens_come_by_the_join(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = {r.doc_id: r for r in language_model.scored(docs).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 3000)
    again = language_model.scored(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], again)
    for r in again:
        assert r.score == pytest.approx(once[r.doc_id].score, rel=0.02)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b a"), (4, "a B c"), (4, "a B c"), (5, "z " * 30000), (6, "unheard of"),
            (12, "é É ü")]
    docs = spark.createDataFrame([(*r, "s", "t") for r in rows], DDL)
    got = language_model.scored(docs).collect()
    check_base(rows, got)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.scored(docs.limit(0)).count() == 0
    held = [i for i in range(200) if out(i)][:3]
    only = language_model.scored(spark.createDataFrame([(i, "x y", "s", "t") for i in held], DDL)).collect()
    assert len(only) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in only)


def test_probabilities_of_all_classes_add_up_to_one():
    frequency = np.array([0.5, 0.2, 0.2, 0.1])
    start = language_model.Parameters.start(frequency)
    start.target += 1.0
    scorer = language_model.Scorer(start)
    for one in range(5):
        for two in range(5):
            p = 10 ** scorer.score(np.arange(4), np.full(4, one), np.full(4, two))
            assert p.sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_which_word_follows():
    draw = np.random.default_rng(5)
    frequency = np.full(6, 1 / 6)
    trainer = language_model.Trainer(language_model.Parameters.start(frequency), frequency)
    for _ in range(300):
        one = draw.integers(0, 6, 512)
        trainer.step((one + 1) % 6, one, draw.integers(0, 6, 512))
    scorer = language_model.Scorer(trainer.p)
    one = np.arange(6)
    assert (10 ** scorer.score((one + 1) % 6, one, np.full(6, 3)) > 0.6).all()


def test_contexts_end_at_texts():
    one, two = language_model.contexts(np.array([1, 2, 3, 4, 9, 5, 9]), np.array([0, 1, 5, 7]), 99)
    assert one.tolist() == [99, 99, 2, 3, 4, 99, 5]
    assert two.tolist() == [99, 99, 99, 2, 3, 99, 99]

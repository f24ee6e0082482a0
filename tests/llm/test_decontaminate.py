"""Decontamination against verbatim search, brute-force subsequences, and made paraphrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate

DOCS = "doc_id bigint, text string, item_id string, cosine string"
ITEMS = "item_id bigint, text string"


def plain(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            row[j], diagonal = (diagonal + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_every_verbatim_item_and_no_clean_document(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = {r.item_id: " " + " ".join(plain(r.text)) + " " for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = " " + " ".join(plain(r.text)) + " "
        want |= {(r.doc_id, i) for i, item in items.items() if item in text}
    assert want and got == want
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_brute_force_agrees_on_changed_copies(spark):
    draw = random.Random(4)
    lexicon = [f"w{draw.randrange(10**6)}" for _ in range(3000)] + ["the", "of", "and", "to"] * 200
    items = [(k, " ".join(draw.choice(lexicon) for _ in range(draw.randrange(12, 120)))) for k in range(60)]
    rows, want = [], set()
    for d in range(400):
        text = [draw.choice(lexicon) for _ in range(draw.randrange(5, 400))]
        if d % 2:
            k, item = items[draw.randrange(60)]
            changed = [draw.choice(lexicon) if draw.random() < draw.choice([0, 0.1, 0.3]) else w for w in item.split()]
            at = draw.randrange(len(text))
            text[at:at] = changed
            share = lcs(item.split(), changed) / len(item.split())
            answer = lcs(item.split()[-5:], changed) >= 4
            if share >= 0.8 or (share >= 0.6 and answer):
                want.add((d, k))
        rows.append((d, " ".join(text), "i", "c"))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want & set(found)) >= 0.98 * len(want)
    texts = {d: t.split() for d, t, _, _ in rows}
    for (d, k), r in found.items():  # whatever is found is confirmed on the words themselves
        assert lcs(items[k][1].split(), texts[d]) >= r.lcs * len(items[k][1].split()) - 1e-9
        assert r.lcs >= 0.6 and 0 <= r.cosine <= 1
    assert {d for d, _ in set(found) - want} <= {d for d in range(400) if d % 2}


def test_several_blocks_give_the_same(spark, small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    stay = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert stay == {r.doc_id for r in docs.collect()} - {i for i, _ in once}
    monkeypatch.setattr(decontaminate, "BLOCK", 8)
    assert len(list(decontaminate.blocks(bench))) > 4
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == stay
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == once


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([
        (1, None, "i", "c"), (2, "", "i", "c"), (3, " \n..", "i", "c"), (None, item, "i", "c"), (4, item.upper(), "i", "c"),
        (4, item, "i", "c"), (5, "x " * 20000 + item.replace(" ", ", ") + " y" * 20000, "i", "c"), (6, "two words", "i", "c"),
        (7, "words two", "i", "c"), (8, "ÉTÉ ÑU " * 9, "i", "c"), (9, "alpha beta", "i", "c")], DOCS)
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "Two words."), (None, "été ñu " * 9)], ITEMS)
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(None, 10), (4, 10), (4, 10), (5, 10), (6, 13), (8, None)], key=str)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 3, 7, 9]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_bits_count_the_subsequence():
    draw = random.Random(8)
    for _ in range(300):
        a = tuple(draw.randrange(9) for _ in range(draw.randrange(1, 80)))
        b = [draw.randrange(9) for _ in range(draw.randrange(90))]
        assert decontaminate.common_subsequence(a, decontaminate._masks(a), b) == lcs(a, b)


def test_decomposition_spans_the_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(np.sort(draw.choice(300, 20, replace=False)).tolist(), draw.random(20).tolist()) for _ in range(30)]
    frame = spark.createDataFrame(rows, "columns array<int>, vals array<double>")
    dense = np.zeros((30, 300))
    for k, (c, v) in enumerate(rows):
        dense[k, c] = v
    basis = decontaminate.decomposition(frame, 300, 30)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-8)
    values = np.linalg.svd(dense, compute_uv=False)
    assert np.linalg.norm(dense @ decontaminate.decomposition(frame, 300, 10)) == pytest.approx(
        np.linalg.norm(values[:10]), rel=0.05)


def changed(words, way, lexicon, often, draw):
    """A copy of an item's words: some replaced at random, or the rarest ones, the answer kept."""
    out, n = list(words), len(words)
    places = {"none": [], "any 35 %": draw.sample(range(n), int(0.35 * n)),
              "rarest 20 %": sorted(range(n), key=lambda k: often[words[k]])[:int(0.2 * n)],
              "rarest 35 %": sorted(range(n - 5), key=lambda k: often[words[k]])[:int(0.35 * n)]}[way]
    for k in places:
        out[k] = draw.choice(lexicon)
    return out


def recall(known, items, texts, way, seed):
    """Of inserted copies that the confirmation itself accepts, the share that is found."""
    draw, rows, want = random.Random(seed), [], []
    often = collections.Counter(w for t in texts for w in set(t))
    lexicon = [w for t in texts for w in t]
    for j, text in enumerate(texts):
        number, words = items[j % len(items)]
        at, n = draw.randrange(len(text)), len(words)
        new = text[:at] + changed(words, way, lexicon, often, draw) + text[at:]
        near = new[max(0, at - n):at + 2 * n]
        share, answer = lcs(words, near) / n, lcs(words[-5:], near) >= 4
        if share >= 0.8 or (share >= 0.6 and answer):
            want.append((j, number))
        rows.append(" ".join(new))
    got = {(lo + r[0], known.items[r[1]].item_id) for lo, _, found in decontaminate._chunks(pa.array(rows))
           for r in decontaminate.leaks(known, found)}
    return len([w for w in want if w in got]) / len(want)


def test_paraphrases_that_change_the_rarest_words(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [t for t in (plain(r.text) for r in docs.collect()) if len(t) > 150][:300]
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    known = decontaminate.index(docs, next(decontaminate.blocks(bench)))
    got = {way: recall(known, items, texts, way, 5) for way in ("none", "any 35 %", "rarest 20 %", "rarest 35 %")}
    assert got["none"] == 1 and min(got.values()) >= 0.95, got


def test_more_items_than_directions(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 60)
    draw = random.Random(6)
    lexicon = [f"w{int(draw.paretovariate(0.6))}" for _ in range(60000)]
    texts = [[draw.choice(lexicon) for _ in range(200)] for _ in range(240)]
    items = [(k, [draw.choice(lexicon) for _ in range(40)]) for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(t), "", "") for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], ITEMS)
    known = decontaminate.index(docs, next(decontaminate.blocks(bench)))
    assert 60 <= known.latent.shape[1] < 200
    for way in ("none", "rarest 20 %", "rarest 35 %"):
        assert recall(known, items, texts, way, 7) >= 0.95, way


def test_cosine_is_one_of_vectors(spark):
    item = [f"i{k}" for k in range(20)]
    docs = spark.createDataFrame([(k, " ".join(draw), "", "") for k, draw in enumerate([item, ["x"] * 30, ["y", "z"] * 20])], DOCS)
    known = decontaminate.index(docs, [decontaminate.Item(1, tuple(
        next(decontaminate.blocks(spark.createDataFrame([(1, " ".join(item))], ITEMS)))[0].words))])

    def cosine(words):
        _, _, found = next(decontaminate._chunks(pa.array([" ".join(words)])))
        return max(c for c, _ in decontaminate._candidates(known, found).values())
    assert cosine(item) == pytest.approx(1.0, abs=1e-5)
    assert cosine(item[:8] + ["unknown"] * 24) == pytest.approx(1.0, abs=1e-5)  # one item spans one direction
    two = decontaminate.index(docs, [*known.items, decontaminate.Item(2, tuple(
        next(decontaminate.blocks(spark.createDataFrame([(2, "y z " * 10)], ITEMS)))[0].words))])
    _, _, found = next(decontaminate._chunks(pa.array([" ".join(item[:10] + ["y"] * 5)])))
    for (_, k), (c, _) in decontaminate._candidates(two, found).items():
        assert 0 < c < 0.99, k

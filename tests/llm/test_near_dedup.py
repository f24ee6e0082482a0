"""Near duplicates against all pairs, on a small table and on made cases."""

import random
import re
import tracemalloc

import numpy as np

from tidemark.llm import near_dedup

DDL = "doc_id bigint, text string, component_id string, kept string"


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        own = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def agree(spark, rows, size, percent, extra=("x", "y")):
    docs = spark.createDataFrame([(i, t, *extra) for i, t in rows], DDL)
    got = near_dedup.near_duplicates(docs, size, percent).collect()
    want, sets = brute(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_given_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    agree(spark, rows, 3, 85)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    agree(spark, [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "two one"),
        (None, "one"), (None, None), (9, long), (10, long + " more"), (10, long + " more"), (11, "a b c d"),
        (11, "one"), (-5, "\tone two three four "), (12, "one two three four"),
    ], 3, 85)


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    draw = random.Random(3)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(draw.randrange(0, 14)):
            text[draw.randrange(len(text))] = f"n{draw.randrange(9999)}"
        rows.append((1000 - i, " ".join(text)))
    agree(spark, rows, 3, 85)


def test_no_rows(spark):
    empty = spark.createDataFrame([], DDL)
    assert near_dedup.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_signature_keeps_both_ends():
    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64))
    one = near_dedup.signatures(values, np.array([0, 500]), 40)
    assert one.shape == (1, 80)
    assert (one[:, 0::2] <= one[:, 1::2]).all()


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 3)], "u bigint, v bigint")
    got = {r.node: r.component for r in near_dedup.components(chain).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {3: 3, 7: 3}


def test_groups_of_many_members_are_cut(spark, monkeypatch):
    paired = spark.range(5000).selectExpr("0L AS centre", "id AS cid")
    weight = spark.range(5000).selectExpr("id AS cid", "20L AS n")
    assert [tuple(r) for r in near_dedup._blocks(paired, weight).collect()] == [(0, 3)]
    # rows drift away from the first, so that most links do not lead to their centre
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    rows, text = [], [f"w{k}" for k in range(150)]
    for i in range(120):
        text[(i * 7) % 150] = f"n{i}"
        rows.append((500 + i * 37 % 120, " ".join(text)))
    agree(spark, rows, 3, 85)


def test_links_take_no_wide_arrays_of_pairs():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    sets = []
    for k in range(3000):
        own = base.copy()
        own[:draw.integers(0, 12)] = k * 100 + np.arange(40, dtype=np.uint64)[:1]
        sets.append(np.unique(own))
    tracemalloc.start()
    found = list(near_dedup.links_of(sets, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(sets)**2  # bytes
    root = list(range(len(sets)))
    for a, b in found:
        root[b] = a
    for k in range(0, 3000, 97):
        near = {j for j in range(len(sets)) if j != k and
                100 * len(np.intersect1d(sets[k], sets[j])) >= 80 * len(np.union1d(sets[k], sets[j]))}
        assert all(root[j] == root[k] for j in near)


def test_bands_follow_the_similarity():
    for percent in (50, 80, 85, 95):
        bands = near_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** 4) ** bands <= near_dedup.MISSED or 2 * near_dedup.PERMUTATIONS == bands * 4
    assert near_dedup.bands_for(85) < near_dedup.bands_for(80) and near_dedup.bands_for(100) == 1


def test_filter_lets_all_wanted_through(spark, monkeypatch):
    texts = spark.range(-500, 3000).selectExpr("id AS doc_id", "'x' AS text")
    wanted = {r.cid for r in spark.range(-500, 3000, 7).selectExpr("id AS cid").collect()}
    ids = spark.createDataFrame([(x,) for x in wanted], "cid bigint")
    kept = {r.doc_id for r in near_dedup.filtered(texts, ids).collect()}
    assert wanted <= kept and len(kept) - len(wanted) < 0.1 * 3000
    monkeypatch.setattr(near_dedup, "FILTER_BITS", 256)  # past its bound the filter lets more through
    kept = {r.doc_id for r in near_dedup.filtered(texts, ids).collect()}
    assert wanted <= kept
    assert near_dedup.filtered(texts, ids.limit(0)).count() == 0


def test_sets_of_unpaired_texts_are_not_staged(spark, tmp_path):
    staged = {}
    real = near_dedup.stage

    def watched(df, label):
        staged[label] = df.columns
        return real(df, label)

    near_dedup.stage = watched
    try:
        near_dedup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id bigint, text string")).count()
    finally:
        near_dedup.stage = real
    assert "bands" in staged and not any("shingles" in columns or "text" in columns for columns in staged.values())


def test_reused_ids_lose_no_text(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    near = y + " more"

    def kept(*rows):
        docs = spark.createDataFrame([(*r, "c", "k") for r in rows], DDL)
        return sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(docs, 5, 80).collect())

    for rows in (((1, x), (1, y), (5, near)), ((5, x), (5, y), (1, near)), ((1, x), (1, y), (5, near), (1, x))):
        texts = [t for _, t in kept(*rows)]
        assert len(texts) == 2 and x in texts and (y in texts or near in texts)
    assert kept((1, x), (1, x), (2, y)) == [(1, x), (2, y)]
    assert kept((1, x), (1, x + " more"), (2, y)) in ([(1, x), (2, y)], [(1, x + " more"), (2, y)])
    assert [i for i, _ in kept((3, x), (2, y), (7, near), (9, x))] == [2, 3]

"""Cuts and outputs against the plain definition, the list's ranks against counting, and the SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import checks, fill_middle

DDL = "doc_id bigint, text string, n string, form string"


def plain_result(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def drawn_text(draw, size):
    return "".join(draw.choice(["word", "a", " ", "\n", "é", "中", "😀", "Z", "z", "@", "[", "`", "{", "<", ">", "\x00", "0"])
                   for _ in range(size))


def agree(spark, rows):
    made = fill_middle.transformed(spark.createDataFrame([(*r, "n", "f") for r in rows], DDL))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted((plain_result(*r) for r in rows), key=str)
    assert sorted(map(tuple, made.collect()), key=str) == want
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    got = fill_middle.digests(made).select("doc_id", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        ((r[0], sha(plain_result(*r)[-1]), sha(r[1])) for r in rows), key=str)


@pytest.mark.parametrize("size", [0, 1, 2, 15, 16, 17, 300, 5000])
def test_every_rank(size):
    draw = random.Random(size)
    text = drawn_text(draw, size)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    made = fill_middle.SkipList(np.frombuffer(text.encode(), np.uint8))
    assert made.size == len(units) and made.points == len(text) and made.octets == len(text.encode())
    points = octets = 0
    for rank, unit in enumerate([*units, ""]):
        assert made.before(rank) == (points, octets)
        points, octets = points + len(unit), octets + len(unit.encode())


def test_lanes_thin_out_and_widths_add_up():
    made = fill_middle.SkipList(np.frombuffer(("ab " * 50_000).encode(), np.uint8))
    sizes = [len(lane[0]) for lane in made.lanes]
    assert sizes[0] == 100_000 and sizes[-1] <= fill_middle.FAN and len(sizes) >= 4
    for units, points, octets, _ in made.lanes:
        assert units.sum() == 100_000 and points.sum() == octets.sum() == 150_000
    assert all(b < a / 8 for a, b in zip(sizes, sizes[1:]) if a > 1000)


def test_blocks_cut_words_and_code_points(monkeypatch):
    draw = random.Random(7)
    text = drawn_text(draw, 400) + "x" * 50
    whole = fill_middle.offsets(np.frombuffer(text.encode(), np.uint8))
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        for a, b in zip(whole, fill_middle.offsets(np.frombuffer(text.encode(), np.uint8)), strict=True):
            assert (a == b).all()


def test_rows(spark):
    draw = random.Random(3)
    rows = [(k, drawn_text(draw, draw.randrange(0, 60))) for k in range(400)]
    rows += [(None, "a b"), (None, None), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "x <P> y"), (5, "<S"), (6, "<M>"),
             (-7, "below zero"), (2**63 - 1, "<" * 30), (8, "P>S>M><P <S <M"), (9, "é" * 300_000), (10, "w " * 500_000),
             (11, "x" * 3_000_000), (12, "中")]
    agree(spark, rows)
    empty = fill_middle.transformed(spark.createDataFrame([], DDL))
    assert fill_middle.digests(empty).count() == 0


def test_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = fill_middle.digests(fill_middle.transformed(spark.read.parquet(f"{small}/documents.parquet")))
    assert sorted(map(tuple, got.collect())) == sorted(
        db.execute(f"SELECT {', '.join(got.columns)} FROM ({checks.FILL_MIDDLE})").fetchall())

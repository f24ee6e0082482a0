"""Cheapest edits against trying all of them, runs joined against whole parses, rows against the definition, and the SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidemark.llm import checks, conversation_repair as cr

DDL = "conv_id bigint, turn bigint, role string, text string, letters string, copies string"
FORM = re.compile(r"(s?(ua)+)?")


def by_trial(letters):
    """Smallest (cost, audit) over all edits with up to two insertions in a place."""
    inserts = ["", "u", "a", "ua", "au"]
    options = []
    for letter in letters:
        fault, initial = divmod(cr.LETTERS.index(letter), 4)
        extra = 5 if fault == 1 else 0
        own = [("D", "", 2)]
        if fault < 2:
            own += [("K", cr.INITIALS[initial], extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(own)
    best = None
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(letters) + 1):
            word = "".join(g + e[1] for g, e in zip(gaps, edits)) + gaps[-1]
            if FORM.fullmatch(word):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                best = min(best or (10**9, ""), (sum(e[2] for e in edits) + 5 * sum(map(len, gaps)), audit))
    return best


def best_of(letters):
    return cr.cheapest(letters)[1:]


def test_all_short_conversations():
    for n in (0, 1):
        for letters in itertools.product(cr.LETTERS, repeat=n):
            assert best_of("".join(letters)) == by_trial(letters)
    draw = random.Random(4)
    for n, cases in ((2, 120), (3, 40)):
        for _ in range(cases):
            letters = "".join(draw.choice(cr.LETTERS[:8] * 2 + cr.LETTERS) for _ in range(n))
            assert best_of(letters) == by_trial(letters), letters


def test_stacks_of_the_grammar():
    assert len(cr.AUTOMATON.stacks) == 8 and len(cr.AUTOMATON.accepting) == 3
    nested = cr.Automaton((("C", ""), ("C", "P"), ("P", "ua"), ("P", "usa")))
    assert len(nested.accepting) == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_joined_runs(size):
    draw = random.Random(size)
    for _ in range(60):
        letters = "".join(draw.choice(cr.LETTERS) for _ in range(draw.randrange(0, 30)))
        joined = cr.Joined()
        for k in range(0, len(letters), size):
            joined.add([(s, e, *way) for s in range(8) for e, way in cr.parsed(letters[k:k + size], s).items()])
        if letters:
            assert joined.result() == best_of(letters)


def hurt(rows):
    """(conv_id, turn, role, text) rows after damage, every conversation's in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(key.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        out[conv] += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {c: sorted(v, key=order) for c, v in out.items()}


def plainly(conv, rows):
    seen, letters, initials, counts = set(), "", [], {"blank": 0, "duplicate": 0, "truncated": 0, "fine": 0}
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "fine" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        initials.append(role[:1])
        letters += cr.LETTERS[4 * cr.FAULTS.index(fault) + (cr.INITIALS.index(role[:1]) if role[:1] in ("s", "u", "a") else 3)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = best_of(letters)
    out, k, spoken = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[k][1:]
        k += edit != "I"
        if edit != "D":
            spoken += not (edit == "K" and role[:1] == "s")
            out.append((edit, role if edit == "K" else ("assistant", "user")[spoken % 2], text))
    assert FORM.fullmatch("".join(r[:1] for _, r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), out


def agree(spark, rows):
    frame = cr.damaged(spark.createDataFrame([(*r, "l", "c") for r in rows], DDL))
    want = {c: plainly(c, v) for c, v in hurt(rows).items()}
    assert sorted(map(tuple, cr.audited(frame).collect()), key=str) == sorted((w[0] for w in want.values()), key=str)
    turns = sorted(((c, k + 1, *t) for c, w in want.items() for k, t in enumerate(w[1])), key=str)
    assert sorted(map(tuple, cr.repaired(frame).collect()), key=str) == turns


def conversations(seed, n, longest=9):
    draw, rows = random.Random(seed), []
    for c in range(n):
        for k in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant"] * 6 + ["system", "tool", "", "ugly", None])
            rows.append((c, draw.choice([k, k, k, k + 3, None]), role,
                         draw.choice(["Hi.", "ok", "Yes!", " \n", None, "why?", "é. ", "x\u2028", "中。", "a.\n\x0b"])))
    draw.shuffle(rows)
    return rows


def test_drawn_conversations(spark):
    agree(spark, conversations(1, 120))


def test_one_long_conversation_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(cr, "RUN", 3)
    draw = random.Random(9)
    rows = [(7, k // 2, draw.choice(["user", "assistant", "system"]), draw.choice(["Hi.", "ok", f"t{k}.", f"u{k}"])) for k in range(900)]
    agree(spark, rows + conversations(2, 30))
    agree(spark, [(7, None, "user", f"t{k}.") for k in range(60)] + [(8, 1, "user", "same.") for _ in range(40)])


def test_odd_rows(spark):
    agree(spark, [(None, None, None, None), (None, 3, "user", "x."), (1, 0, "user", "long. " * 200_000), (2, -5, "user", "a."),
                  (2, 10**15, "assistant", "b."), (3, 1, "user", "q?"), (3, 1, "user", "q?"), (3, 1, "assistant", "q?")])
    assert cr.audited(cr.damaged(spark.createDataFrame([], DDL))).count() == 0
    assert cr.repaired(cr.given(spark.createDataFrame([], DDL))).count() == 0


def test_undamaged_rows(spark):
    frame = cr.given(spark.createDataFrame([(1, 0, "system", "S.", "", ""), (1, 1, "user", "U.", "", ""), (1, 2, "assistant", "A.", "", "")],
                                           DDL))
    assert [tuple(r)[:8] for r in cr.audited(frame).collect()] == [(1, 0, 0, 0, 0, 0, 0, "KKK")]


def test_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    got = cr.audited(cr.damaged(spark.read.parquet(f"{small}/conversations.parquet")))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({checks.CONVERSATION_REPAIR})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sql_on_odd_rows(spark):
    rows = conversations(11, 80) + [(None, 2, None, "x.")]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = cr.audited(cr.damaged(spark.createDataFrame([(*r, "", "") for r in rows], DDL)))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({checks.CONVERSATION_REPAIR})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

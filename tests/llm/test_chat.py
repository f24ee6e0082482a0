"""Snapshot collapse against all prefixes by brute force, and against its SQL."""

import random

import duckdb

from tidemark.llm import chat, checks

DDL = "conv_id bigint, turn bigint, role string, text string, place string, n string"


def brute(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    seq = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (low(x[0]), (x[1] is not None, x[1] or ""), (
        x[2] is not None, x[2] or "")))] for c, v in by.items()}
    out = []
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in seq.values())
        same = [k for k, o in seq.items() if o == s]
        if not longer and c == min(same):
            out += [(c, k + 1, len(s), len(same), f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n")
                    for k, (r, t) in enumerate(s)]
    return sorted(out)


def agree(spark, rows):
    frame = spark.createDataFrame([(*r, "p", "n") for r in rows], DDL)
    assert sorted(map(tuple, chat.rendered(frame).collect())) == brute(rows)


def snapshots(seed, n):
    draw, rows = random.Random(seed), []
    bases = [[(draw.choice(["user", "assistant", None]), draw.choice(["hi", "ok", None, "", "no", "more"]))
              for _ in range(draw.randrange(1, 9))] for _ in range(12)]
    for c in range(n):
        base = draw.choice(bases)
        start = draw.choice([0, 1, 5])
        rows += [(c, start + 2 * k, *turn) for k, turn in enumerate(base[:draw.randrange(1, len(base) + 1)])]
    draw.shuffle(rows)
    return rows


def test_snapshots(spark):
    agree(spark, snapshots(1, 60))


def test_runs_of_few_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 3)
    agree(spark, snapshots(2, 40))
    agree(spark, [(7, k, "user", f"t{k}") for k in range(50)] + [(8, k, "user", f"t{k}") for k in range(31)]
          + [(9, k + 100, "user", f"t{k}") for k in range(50)])


def test_odd_rows(spark):
    agree(spark, [(None, 0, "user", "x"), (1, None, "user", "x"), (1, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"),
                  (3, 0, "user", "x"), (4, 0, "", "x"), (5, 0, None, "x"), (6, 0, "x", None), (7, 0, "user", "long " * 40000),
                  (8, -3, "user", "below"), (8, 10**12, "user", "above")])
    assert chat.rendered(spark.createDataFrame([], DDL)).count() == 0


def test_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = sorted(db.execute(f"SELECT conv_id, place, n_turns, n_copies, rendered FROM ({checks.CHAT})").fetchall())
    got = chat.rendered(spark.read.parquet(f"{small}/conversations.parquet"))
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Quality rules against their SQL, and on made rows."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import checks, quality_rules

DDL = "doc_id bigint, text string, lang string, source string, n_words string, kept string"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    seen = Counter(windows)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len({k + j for k, g in enumerate(windows) if seen[g] > 1 for j in range(5)})
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat,
            len(w) < 10 or 100 * repeat > 20 * len(w))


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\x0b\x0c\r ", "en", None), (4, "a", "en", "a"),
    (5, "a b c d e a b c d e", "en", "a"), (6, "a a a a a a a a a a a", "en", "a"), (7, "ü ß 😀 # | <b>\n\n x\nx\nx", "de", "b"),
    (8, " lead and trail of ten words is quite enough here ", "en", "a"), (8, "one two three four five six seven", "en", "a"),
    (None, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (9, "x y z p q " + " ".join(f"w{k}" for k in range(40)) + " x y z p q r", "en", "a"),
    (10, " ".join(f"w{k % 7000}" for k in range(20000)), "en", "a"),
]


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "n", "k") for r in ODD], DDL)
    got = sorted((tuple(r) for r in quality_rules.quality(docs).collect()), key=str)
    want = sorted(((i, *plain(t)) for i, t, _, _ in ODD), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(not (g[6] and g[7]) for g in got)


def test_accepted_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(*r, "n", "k") for r in ODD], DDL)
    kept = quality_rules.accepted(docs)
    assert kept.schema.names == docs.schema.names
    assert {r.n_words for r in kept.collect()} == {"n"}
    assert quality_rules.accepted(docs.limit(0)).count() == 0


def test_fences_follow_the_source(spark):
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(k, text, "en", "plain") for k in range(300)] + [(k, text.replace("word", "w#"), "en", "marked")
                                                            for k in range(300, 600)]
    rows += [(600, text.replace("word", "w#"), "en", "plain"), (601, text, "en", "marked")]
    docs = spark.createDataFrame([(*r, "n", "k") for r in rows], DDL)
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    assert kept == set(range(600)) | {601}


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_equals_sql(spark, small, folder):
    got = quality_rules.quality(spark.read.parquet(f"{small}/documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = db.execute(checks.QUALITY_RULES)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_no_python_in_the_plan(spark, small):
    plan = quality_rules.quality(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fences_follow_sources_of_very_long_words(spark):
    draw = random.Random(6)
    rows = [(k, " ".join("x" * draw.randrange(220, 480) + str(j) for j in range(12)), "zh", "a") for k in range(300)]
    rows += [(k, " ".join("x" * (5000 + k % 2) + str(j) for j in range(12)), "ja", "a") for k in range(300, 600)]
    rows += [(600, " ".join("x" * 9000 + str(j) for j in range(12)), "zh", "a"),
             (601, " ".join("x" * 9000 + str(j) for j in range(12)), "ja", "a")]
    docs = spark.createDataFrame([(*r, "n", "k") for r in rows], DDL)
    assert {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()} == set(range(600))


def test_steps_are_taken_together_by_their_leading_digits(spark):
    got = spark.range(200000).select("id", quality_rules._coarse(F.col("id")).alias("a"),
                                     quality_rules._last(quality_rules._coarse(F.col("id"))).alias("b"))
    assert got.where("NOT (a <= id AND id <= b AND b - a <= id / 1000)").count() == 0
    assert got.where("id < 2048 AND (a <> id OR b <> id)").count() == 0

"""The pipeline against its stages done by brute force on the smallest tables."""

import base64
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from tidemark.llm import checks, quality_classifier

from test_near_dedup import brute


def plain(text):
    return " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())) + " "


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_stages_in_order(spark, small, texts):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    left = {r[0] for r in db.execute(f"SELECT doc_id FROM ({checks.QUALITY_RULES}) WHERE kept").fetchall()}

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality_classifier.scored(docs, labels).where("predicted = 1").collect()}
    left &= good
    component, _ = brute([(i, texts[i]) for i in left], 5, 80)
    left = {i for i in left if component[i] == i}
    items = [plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {i for i in left if not any(x in plain(texts[i]) for x in items)}

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = __spark_entry__.queries()["pipeline"](spark, small).collect()
    assert {r.doc_id for r in rows} == left and len(rows) == len(left)
    for r in rows:
        assert r.ids == theirs.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_stages_take_odd_and_extra_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr(
        "*", "1 AS kept", "'x' AS n_words", "2 AS ids", "3 AS component_id", "4 AS cid", "5 AS f_lang")
    odd = spark.createDataFrame([
        (None, None, None, None, None, 1, "x", 2, 3, 4, 5), (1, None, "en", "src1", 0, 1, "x", 2, 3, 4, 5),
        (1, "", None, "src1", 0, 1, "x", 2, 3, 4, 5)], docs.schema)
    whole = docs.unionByName(docs.limit(30)).unionByName(odd)
    for name, step in corpus_pipeline.STAGES:
        for rows in (whole, whole.limit(0)):
            out = step(spark, rows, small)
            if name != "byte_bpe":
                assert out.columns == docs.columns, name
            found = out.collect()
            if name == "near_dedup":
                texts = [(r.doc_id, r.text or "") for r in found if r.doc_id is not None]
                assert len(texts) == len(set(texts))  # the two texts of document 1 stay

"""Quality classifier: held-out accuracy, and the discriminant against densities written out."""

import zlib

import numpy as np

from tidemark.llm import quality_classifier as qc

DDL = "doc_id bigint, text string, score string, x string"


def test_accuracy_on_the_fold_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.scored(docs, labels).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 50
    assert np.mean([r.predicted == r.quality for r in unseen]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_discriminant_is_the_difference_of_log_densities():
    draw = np.random.default_rng(1)
    d = len(qc.STATISTICS)
    total, parts = np.zeros((2, d + 1, d + 1)), []
    for k, (n, scale) in enumerate(((400, 2.0), (900, 1.0))):
        x = draw.normal(k, scale, (n, d))
        parts.append(x)
        ones = np.column_stack([np.ones(n), x])
        total[k] = ones.T @ ones
    model = qc.discriminant(total)
    x = draw.normal(0.5, 1.5, (50, d))
    pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts) / 1300
    log = []
    for k, p in enumerate(parts):
        cov = (1 - qc.TO_POOLED) * np.cov(p.T, bias=True) + qc.TO_POOLED * pooled
        cov = (1 - qc.TO_DIAGONAL) * cov + qc.TO_DIAGONAL * np.diag(np.diag(cov)) + qc.FLOOR * np.eye(d)
        off = x - p.mean(0)
        log.append(np.log(len(p) / 1300) - 0.5 * np.linalg.slogdet(cov)[1]
                   - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_odd_rows(spark):
    docs = spark.createDataFrame([
        (1, None, "a", "b"), (2, "", "a", "b"), (3, " \n", "a", "b"), (None, "some words here", "a", "b"),
        (4, "w " * 30000, "a", "b"), (4, "again the same id", "a", "b"), (5, "é" * 50, "a", "b")], DDL)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0), (5, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = qc.scored(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert qc.scored(docs.limit(0), labels).count() == 0
    one = qc.scored(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1
    model = qc.fit(qc.measured(docs), labels.limit(0))
    assert model.constant == 0.5
    kept = qc.accepted(docs, model, threshold=0.5)
    assert kept.schema == docs.schema and kept.count() == 7
    assert qc.accepted(docs, model).count() == 0

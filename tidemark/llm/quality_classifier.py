"""Document quality by a regularised quadratic discriminant over document statistics.

Statistics come from the bytes of whole texts, vectorised over Arrow batches. Each class has its mean and a
covariance shrunk towards the pooled one and towards a diagonal; the fit needs only counts, sums and products per
class, which are added up in Spark before a few hundred numbers reach the driver. All labelled rows outside the
held-out fold are used. The score is the logistic of the difference of the two log densities plus the log odds of
the classes; densities use Mahalanobis distances through the inverse Cholesky factors, computed once per model.

Defined results: null and empty texts have all statistics at zero and get a score like any other text. Rows of
``labels`` with a null id or label are no examples; rows that share an id each count. A missing ``doc_id`` is in
no fold (not held out). With no examples of one class the score is the share of class 1, plus one over plus two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.session import stage

HELD_OUT = (4, 2)
THRESHOLD = 0.7
TO_POOLED = 0.1
TO_DIAGONAL = 0.05
#: Least variance of a statistic, so that one which is constant in a class stays usable.
FLOOR = 1e-4

_UPPER, _DIGIT, _SYMBOL, _STOP, _LOUD, _LETTER = (1 << k for k in range(6))
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] |= _UPPER | _LETTER
_KIND[97:123] |= _LETTER
_KIND[0xC3:0xF5] |= _LETTER  # first bytes of most letters beyond ASCII
_KIND[48:58] |= _DIGIT
for _c in b"#*$%&|<>=_~^@\\{}[]":
    _KIND[_c] |= _SYMBOL
for _c in b".,;:?":
    _KIND[_c] |= _STOP
_KIND[ord("!")] |= _LOUD

STATISTICS = ("words", "word_length", "length_spread", "upper", "digits", "symbols", "stops", "loud", "lone",
              "distinct", "echo", "repeated", "bare")


def held_out(doc_id: Column, fold: tuple[int, int] = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold[0] == fold[1]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(found: words.Words) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, bounds = found.data, found.bounds
    n = found.counts.astype(np.float64)
    some, kinds = np.maximum(n, 1), _KIND[data]
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    length = (at[found.ends] - at[found.starts]).astype(np.float64)
    chars = np.maximum(_sums(length, found.first), 1)
    mean = _sums(length, found.first) / some
    spread = np.sqrt(np.maximum(_sums(length**2, found.first) / some - mean**2, 0))
    share = {k: _sums((kinds & k) != 0, bounds) for k in (_UPPER, _DIGIT, _SYMBOL, _STOP, _LOUD, _LETTER)}
    letters = np.maximum(share[_LETTER], 1)
    own, text = found.hashes(), found.text_of_word()
    same = np.zeros(len(own))
    same[1:] = (own[1:] == own[:-1]) & (text[1:] == text[:-1])
    once = np.diff(words.shingles(found, 1)[1])
    triples = np.diff(words.shingles(found, 3)[1])
    possible = np.maximum(n - 2, np.minimum(n, 1))
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.sqrt(share[_UPPER] / letters), np.sqrt(share[_DIGIT] / chars),
        np.sqrt(share[_SYMBOL] / chars), np.sqrt(share[_STOP] / chars), np.sqrt(share[_LOUD] / chars),
        np.sqrt(_sums(length == 1, found.first) / some), np.log((once + 1) / (n + 1)) / np.log(n + 2),
        np.sqrt(_sums(same, found.first) / some), np.sqrt(np.maximum(possible - triples, 0) / np.maximum(possible, 1)),
        np.sqrt(np.maximum(1 - share[_LETTER] / np.maximum(_sums(lead, bounds), 1), 0)),
    ])


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi, found in words.chunks(texts):
        yield lo, hi, statistics(found)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, found in _runs(batch.column(1)):
            flat = pa.array(found.reshape(-1))
            ends = pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "x"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of each class, as rows of (class, place, value)."""
    d = len(STATISTICS) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.ones((len(label), d))
        x[:, 1:] = batch.column(1).flatten().to_numpy().reshape(len(label), d - 1)
        for k in (0, 1):
            total[k] += x[label == k].T @ x[label == k]
    for k in (0, 1):
        if total[k, 0, 0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d * d, k, dtype=np.int32)), pa.array(np.arange(d * d, dtype=np.int32)),
                 pa.array(total[k].reshape(-1))], ["label", "place", "value"])


@dataclass(frozen=True)
class Discriminant:
    """Means, transposed inverse Cholesky factors, log determinants and log odds of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [-0.5 * (((x - self.means[k]) @ self.factors[k]) ** 2).sum(axis=1) + self.offsets[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def discriminant(total: np.ndarray) -> Discriminant:
    """From the products of each class, whose first row and column belong to the constant 1."""
    n = total[:, 0, 0]
    if not n.all():
        empty = np.zeros(0)
        return Discriminant(empty, empty, empty, float((n[1] + 1) / (n.sum() + 2)))
    d = total.shape[1] - 1
    means = total[:, 0, 1:] / n[:, None]
    scatter = total[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        # few examples of a class lean on the pooled covariance
        lean = max(TO_POOLED, min(1.0, d / n[k]))
        own = (1 - lean) * scatter[k] / n[k] + lean * pooled
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower).T)
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of every row, staged; texts are read once for fit and scores."""
    made = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stage(made.mapInArrow(_measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>"),
                 "document-statistics")


def fit(found: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows of ``found`` outside the held-out fold."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    joined = found.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("label", "x")
    sums = joined.mapInArrow(_products, "label int, place int, value double").groupBy("label", "place").agg(
        F.sum("value").alias("value")).collect()
    d = len(STATISTICS) + 1
    total = np.zeros((2, d * d))
    for r in sums:
        total[r.label, r.place] = r.value
    return discriminant(total.reshape(2, d, d))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    found = measured(docs)
    model = fit(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _runs(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)

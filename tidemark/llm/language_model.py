"""Log-bilinear language model trained in numpy by noise-contrastive estimation, and a counted base model beside it.

Tokens are words (A-Z lowered) and an end per text, named by 64-bit hashes. Counts of all training tokens are added up
in Spark. The ``CLASSES`` most frequent tokens are the neural model's own vocabulary; every other token is of the
class "other", within which it has its counted share, so the model gives every token a normalised probability.

The model predicts a vector from the two words before (each through its own matrix) and scores a class by the inner
product with the class's vector plus a bias. Every task trains over its whole share of the training texts from the
same start (minibatches, AdaGrad; data against noise words drawn by frequency), and the parameters are averaged by
tokens in Spark. For scoring, normalisers come from batched matrix products over all classes, once for each pair of
words before that occurs.

Counts that a task needs per token: tokens above a count that at most ``FREQUENT`` of them reach go out with the
tasks; the occurrences of all others are joined with the count table, whose keys are rare by construction, and summed
up per text. Nothing else that grows leaves the executors.

Defined results: null, empty and blank texts are one end token. A missing ``doc_id`` is in no fold (training).
Repeated rows count and are scored each. Without training rows all tokens are unknown and the model is uniform over
its classes. The base score is the sum of log10((c + 1) / (N + V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.quality_classifier import held_out
from tidemark.session import stage

HELD_OUT = (7, 2)
CLASSES = 1024
FREQUENT = 1 << 17
DIMENSIONS = 24
NOISE = 64
BATCH = 4096
RATE = 0.15
END = 0

_BLOCK = 128
_TEN = np.log(10.0)


def _tokens(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended, and where each text's begin."""
    counts = found.counts + 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(begin[-1], END, dtype=np.uint64)
    own = np.ones(begin[-1], dtype=bool)
    own[begin[1:] - 1] = False
    out[own] = found.hashes()
    return out, begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_tokens(found)[0] for _, _, found in words.chunks(batch.column(0))]
        if parts:
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "c"])


def counts(docs: DataFrame) -> DataFrame:
    """token, c over all texts of ``docs``, staged."""
    made = docs.select(F.col("text").cast("string")).mapInArrow(_count, "token bigint, c bigint")
    return stage(made.groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


@dataclass(frozen=True)
class Vocabulary:
    """Frequent tokens (ascending) with counts and classes; totals over all training tokens."""

    tokens: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    size: int
    total: int
    distinct: int
    other_total: int
    other_distinct: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table (0 if absent) and whether a token is there."""
        if not len(self.tokens):
            return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at, self.tokens[at] == tokens

    def classed(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Class of each token; ``size`` is the class of all others."""
        if not len(self.tokens):
            return np.full(len(at), self.size)
        return np.where(there, self.classes[at], self.size)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The tokens of the highest counts, at most ``FREQUENT`` of them, and the totals."""
    step = F.floor(8 * F.log2("c"))
    rows = sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(),
                  reverse=True)
    total, distinct = sum(r.c for r in rows), sum(r.n for r in rows)
    least, held = float("inf"), 0
    for r in rows:
        if held + r.n > FREQUENT:
            break
        least, held = r.step, held + r.n
    table = counted.where(step >= F.lit(least)).toArrow() if held else counted.limit(0).toArrow()
    token = table.column("token").to_numpy().view(np.uint64)
    c = table.column("c").to_numpy()
    order = np.argsort(token)
    token, c = token[order], c[order]
    top = np.lexsort((token, -c))[:CLASSES]
    classes = np.full(len(token), len(top), dtype=np.int64)
    classes[top] = np.arange(len(top))
    return Vocabulary(token, c, classes, len(top), total, distinct, total - int(c[top].sum()), distinct - len(top))


def contexts(classed: np.ndarray, begin: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; ``blank`` before a text."""
    one = np.full(len(classed), blank)
    one[1:] = classed[:-1]
    two = np.full(len(classed), blank)
    two[2:] = classed[:-2]
    first = begin[:-1]
    one[first] = two[first] = blank
    two[np.minimum(first + 1, len(classed) - 1)[np.diff(begin) > 1]] = blank
    return one, two


@dataclass
class Parameters:
    """Word vectors (classes, other, blank), a matrix per place before, target vectors and biases."""

    before: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(frequency: np.ndarray) -> Parameters:
        draw, d, n = np.random.default_rng(13), DIMENSIONS, len(frequency)
        return Parameters(draw.normal(0, 0.3, (n + 1, d)).astype(np.float32), np.eye(d, dtype=np.float32),
                          0.5 * np.eye(d, dtype=np.float32), draw.normal(0, 0.05, (n, d)).astype(np.float32),
                          np.log(frequency).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.before, self.near, self.far, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.arrays()])

    def shaped(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)


def _add_rows(place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same place added up."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new], np.add.reduceat(rows[order], new, axis=0)


class Trainer:
    """AdaGrad over minibatches of noise-contrastive estimation."""

    def __init__(self, start: Parameters, frequency: np.ndarray):
        self.p = start.shaped(start.flat())
        self.squares = [np.full(x.shape, 0.1, dtype=np.float32) for x in self.p.arrays()]
        self.log_noise = np.log(NOISE * frequency).astype(np.float32)
        self.cumulated = np.cumsum(frequency)
        self.draw = np.random.default_rng(17)

    def _move(self, k: int, place, gradient: np.ndarray) -> None:
        values, squares = self.p.arrays()[k], self.squares[k]
        squares[place] += gradient**2
        values[place] += RATE * gradient / np.sqrt(squares[place])

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(word)
        noise = np.minimum(np.searchsorted(self.cumulated, self.draw.random(NOISE) * self.cumulated[-1]),
                           len(self.cumulated) - 1)
        vector_one, vector_two = p.before[one], p.before[two]
        guess = vector_one @ p.near + vector_two @ p.far
        own, others = p.target[word], p.target[noise]
        true = (guess * own).sum(axis=1) + p.bias[word] - self.log_noise[word]
        false = guess @ others.T + p.bias[noise] - self.log_noise[noise]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        to_guess = up[:, None] * own + down @ others
        scale = np.float32(1 / np.sqrt(n))
        self._move(1, slice(None), scale * (vector_one.T @ to_guess))
        self._move(2, slice(None), scale * (vector_two.T @ to_guess))
        self._move(0, *_scaled(_add_rows(np.concatenate([one, two]), np.concatenate(
            [to_guess @ p.near.T, to_guess @ p.far.T])), scale))
        place = np.concatenate([word, noise])
        self._move(3, *_scaled(_add_rows(place, np.concatenate([up[:, None] * guess, down.T @ guess])), scale))
        at, total = _add_rows(place, np.concatenate([up, down.sum(axis=0)])[:, None])
        self._move(4, at, scale * total[:, 0])


def _scaled(rows: tuple[np.ndarray, np.ndarray], scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    return rows[0], scale * rows[1]


def frequencies(known: Vocabulary) -> np.ndarray:
    """Share of each class, the class of all others last; never nothing."""
    n = np.zeros(known.size + 1)
    inside = known.classes < known.size
    n[known.classes[inside]] = known.counts[inside]
    n[-1] = known.other_total
    return (n + 1) / (n + 1).sum()


def train(docs: DataFrame, known: Vocabulary) -> Parameters:
    """One pass over all texts of ``docs`` in every task's own order, averaged by tokens."""
    frequency = frequencies(known)
    start = Parameters.start(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, tokens = Trainer(start, frequency), 0
        for batch in batches:
            for _, _, found in words.chunks(batch.column(0)):
                token, begin = _tokens(found)
                word = known.classed(*known.find(token))
                one, two = contexts(word, begin, known.size + 1)
                mixed = trainer.draw.permutation(len(word))
                for k in range(0, len(word), BATCH):
                    part = mixed[k:k + BATCH]
                    trainer.step(word[part], one[part], two[part])
                tokens += len(word)
        if tokens:
            flat = trainer.p.flat().astype(np.float64) * tokens
            size = len(flat) // _BLOCK + 1
            parts = [flat[k:k + size].tobytes() for k in range(0, len(flat), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int64()), pa.array([tokens] * len(parts), pa.int64()),
                 pa.array(parts, pa.binary())], ["block", "tokens", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in group["part"])
        return pd.DataFrame({"block": group["block"].iloc[:1], "tokens": [group["tokens"].sum()],
                             "part": [total.tobytes()]})

    schema = "block bigint, tokens bigint, part binary"
    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("block").applyInPandas(
        add, schema).collect()
    if not rows:
        return start
    return start.shaped(np.concatenate([np.frombuffer(r.part) / r.tokens for r in sorted(rows)]))


class Scorer:
    """Normalised log10 probabilities of classes, after the two classes before."""

    def __init__(self, p: Parameters):
        self.one = p.before @ p.near @ p.target.T
        self.two = p.before @ p.far @ p.target.T
        self.bias = p.bias
        self.log_sum = np.full((len(p.before), len(p.before)), np.nan, dtype=np.float32)

    def _normalise(self, one: np.ndarray, two: np.ndarray) -> None:
        code = np.unique(one * len(self.log_sum) + two)
        one, two = np.divmod(code, len(self.log_sum))
        new = np.isnan(self.log_sum[one, two])
        one, two = one[new], two[new]
        for k in range(0, len(one), 1024):
            a, b = one[k:k + 1024], two[k:k + 1024]
            score = self.one[a] + self.two[b] + self.bias
            top = score.max(axis=1)
            self.log_sum[a, b] = top + np.log(np.exp(score - top[:, None]).sum(axis=1))

    def score(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        self._normalise(one, two)
        return (self.one[one, word] + self.two[two, word] + self.bias[word] - self.log_sum[one, two]) / _TEN


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.float64), begin[:-1])


_PARTS = ("uid bigint, doc_id {}, n_tokens bigint, n_known bigint, n_other bigint, base double, model double, "
          "rare array<bigint>, times array<bigint>")


def _parts(docs: DataFrame, known: Vocabulary, p: Parameters) -> DataFrame:
    """Per row what a task can tell by itself, and the tokens whose counts it lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, uid = Scorer(p), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, found in words.chunks(batch.column(1)):
                token, begin = _tokens(found)
                at, there = known.find(token)
                word = known.classed(at, there)
                log_count = np.zeros(len(token))
                if there.any():
                    log_count[there] = np.log10(known.counts[at[there]] + 1.0)
                other = word == known.size
                value = scorer.score(word, *contexts(word, begin, known.size + 1)) + np.where(other, log_count, 0)
                # the tokens with unknown counts, once per text
                text = np.repeat(np.arange(hi - lo), np.diff(begin))[~there]
                rare = token[~there]
                order = np.lexsort((rare, text))
                text, rare = text[order], rare[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])
                place = np.flatnonzero(new)
                times = np.diff(np.append(place, len(rare)))
                ends = pa.array(np.searchsorted(text[place], np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(hi - lo)), batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(begin)), pa.array(_sums(there, begin).astype(np.int64)),
                    pa.array(_sums(other, begin).astype(np.int64)), pa.array(_sums(log_count, begin)),
                    pa.array(_sums(value, begin)),
                    pa.ListArray.from_arrays(ends, pa.array(rare[place].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))],
                    ["uid", "doc_id", "n_tokens", "n_known", "n_other", "base", "model", "rare", "times"])
                uid += hi - lo

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stage(made.mapInArrow(run, _PARTS.format(kind)), "language-model-parts")


def scored(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    learnt = docs.where(~held_out(F.col("doc_id"), HELD_OUT))
    counted = counts(learnt)
    known = vocabulary(counted)
    found = _parts(docs, known, train(learnt, known))

    rare = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("e")).select(
        "uid", F.col("e.rare").alias("token"), F.col("e.times").alias("times"))
    added = rare.join(counted, "token").groupBy("uid").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return found.select("uid", "doc_id", "n_tokens", "n_known", "n_other", "base", "model").join(added, "uid", "left").select(
        "doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(known.total + known.distinct + 1.0))).alias("base_score"),
        (F.col("model") + more
         - F.col("n_other") * float(np.log10(known.other_total + known.other_distinct + 1.0))).alias("score"))

"""Language of texts, with spans where a text changes its language.

Every word gets a score under each learnt language from its byte trigrams (with the word's ends), after script ranges
have narrowed the candidates: a language is a candidate for a word if it was learnt with one of the word's scripts;
where that leaves none, all are. A Viterbi pass over the words of a text, with a penalty for each switch, labels the
words; equal labels side by side are spans. The text's language is the one with most letters, its score their share.

What is learnt are counts: trigrams (in ``BUCKETS`` hashed classes) and letters of each script, per language, over
all training rows. Tasks count, Spark adds up, and only the totals per language, of fixed size, reach the driver.

Defined results: a null text, or one without letters, is ``und`` with score 0 and no spans. Rows without ``lang``
teach nothing; a missing ``doc_id`` is in no fold (not held out). Ties go to the first language by name. With no
rows to learn from, every text is ``und``. Repeated rows are labelled one by one; whole texts are, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.quality_classifier import held_out

HELD_OUT = (4, 2)
BUCKETS = 1 << 15
SWITCH = 12.0
#: Texts that take their Viterbi steps together.
STEP_BYTES = 1 << 21
ALPHA = 0.5
#: A script is a language's own from this share of its letters on.
OWN_SCRIPT = 0.01
OUTSIDE = -40.0

#: First code point of each range and its script, ascending.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])

SPANS = "lang_pred string, score double, spans array<struct<first_word: int, last_word: int, lang: string>>"


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)])


@dataclass
class Read:
    """Per word: trigram classes (and where each word's begin), letters, script bits."""

    grams: np.ndarray
    begin: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    by_script: np.ndarray


def read(found: words.Words) -> Read:
    data = words.LOWER[found.data]
    n = len(found.starts)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Read(none, np.zeros(1, dtype=np.int64), none, none, np.zeros((0, 2), dtype=np.int64))
    length = found.ends - found.starts
    # a word's bytes and one end mark, side by side
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.full(begin[-1], 32, dtype=np.int64)
    own = np.ones(begin[-1], dtype=bool)
    own[begin[1:] - 1] = False
    source = np.arange(begin[-1]) + np.repeat(found.starts - begin[:-1], length + 1)
    flat[own] = data[source[own]]
    before = np.full(len(flat), 32, dtype=np.int64)
    before[1:] = flat[:-1]
    earlier = np.full(len(flat), 32, dtype=np.int64)
    earlier[2:] = flat[:-2]
    earlier[begin[:-1]] = 32  # what stands before a word is of no account
    code = (earlier << 16 | before << 8 | flat).astype(np.uint64)
    grams = (words.mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)

    # code points of the characters that begin in the word
    raw = np.concatenate([found.data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
    lead = np.flatnonzero(((found.data & 0xC0) != 0x80) & ~words.IS_SPACE[found.data])
    b0, b1, b2, b3 = (raw[lead + k] for k in range(4))
    low = [x & 0x3F for x in (b1, b2, b3)]
    point = np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
                      [b0, (b0 & 0x1F) << 6 | low[0], (b0 & 0xF) << 12 | low[0] << 6 | low[1]],
                      (b0 & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2])
    point = np.minimum(point, 0x10FFFF)
    letter = _is_letter()[point]
    at, point = lead[letter], point[letter]
    word = np.searchsorted(found.starts, at, side="right") - 1
    script = _SCRIPT[np.searchsorted(_STARTS, point, side="right") - 1]
    bits = np.zeros(n, dtype=np.int64)
    np.bitwise_or.at(bits, word, 1 << script)
    return Read(grams, begin, np.bincount(word, minlength=n), bits, np.column_stack([word, script]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, n): trigram classes from 0, scripts from ``BUCKETS`` on."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, found in words.chunks(batch.column(1)):
            seen = read(found)
            names, number = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
            of_word = np.repeat(number, found.counts)
            size = BUCKETS + len(NAMES)
            gram = np.repeat(of_word, np.diff(seen.begin)) * size + seen.grams
            spoken = np.repeat(seen.letters > 0, np.diff(seen.begin))
            script = of_word[seen.by_script[:, 0]] * size + BUCKETS + seen.by_script[:, 1]
            n = np.bincount(gram[spoken], minlength=len(names) * size) + np.bincount(script, minlength=len(names) * size)
            for name, part in zip(names.tolist(), n.reshape(-1, size), strict=True):
                total[name] = total[name] + part if name in total else part
    for name, part in total.items():
        some = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(part[some].astype(np.int64))],
            ["lang", "place", "n"])


@dataclass(frozen=True)
class Model:
    """Languages by name, log probabilities of the trigram classes, and the languages of every set of scripts."""

    langs: list[str]
    grams: np.ndarray
    scripts: np.ndarray

    def word_scores(self, seen: Read) -> np.ndarray:
        """One row per word; words without letters score 0 under every language."""
        n, many = len(seen.letters), len(self.langs)
        out = np.zeros((n, many), dtype=np.float32)
        if not n:
            return out
        for k in range(many):
            out[:, k] = np.add.reduceat(self.grams[k][seen.grams], seen.begin[:-1])
        bits, number = np.unique(seen.scripts, return_inverse=True)
        allowed = np.zeros((len(bits), many), dtype=bool)
        for row, own in enumerate(bits.tolist()):
            for k in range(len(NAMES)):
                if own >> k & 1:
                    allowed[row] |= self.scripts[:, k]
        allowed[~allowed.any(axis=1)] = True
        out += np.where(allowed, 0.0, OUTSIDE)[number]
        out[seen.letters == 0] = 0
        return out


def learn(docs: DataFrame) -> Model:
    """Counts of the rows with ``lang`` outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), HELD_OUT)).select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_count, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(
        F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(langs)}
    total = np.zeros((len(langs), BUCKETS + len(NAMES)))
    total[[number[x] for x in counted.column("lang").to_pylist()], counted.column("place").to_numpy()] = (
        counted.column("n").to_numpy())
    grams, letters = total[:, :BUCKETS] + ALPHA, total[:, BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), share >= OWN_SCRIPT)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; ``first`` has each text's first word. All texts move on one word a step."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(order):
        return labels
    start, length = first[:-1][order], counts[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than the step
    came = np.zeros(scores.shape, dtype=np.int8 if scores.shape[1] < 128 else np.int16)
    stay = np.arange(scores.shape[1])
    value = scores[start].copy()
    for step in range(1, steps):
        n = active[step]
        value = value[:n] if len(ended := value[n:]) == 0 else _keep(value, n, ended, start, length, labels)
        best = value.argmax(axis=1)
        moved = value[np.arange(n), best][:, None] - switch
        leave = moved > value
        at = start[:n] + step
        came[at] = np.where(leave, best[:, None], stay)
        value = np.where(leave, moved, value) + scores[at]
    labels[start[:len(value)] + length[:len(value)] - 1] = value.argmax(axis=1)
    for step in range(steps - 1, 0, -1):
        n = active[step]
        at = start[:n] + step
        labels[at - 1] = came[at, labels[at]]
    return labels


def _keep(value: np.ndarray, n: int, ended: np.ndarray, start: np.ndarray, length: np.ndarray,
          labels: np.ndarray) -> np.ndarray:
    """Texts that end before this step get the label of their last word."""
    done = slice(n, n + len(ended))
    labels[start[done] + length[done] - 1] = ended.argmax(axis=1)
    return value[:n]


def _label(model: Model, found: words.Words) -> tuple[list, list, list]:
    seen, n = read(found), len(found.first) - 1
    if not model.langs or not len(seen.letters):
        return ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    labels = viterbi(model.word_scores(seen), found.first)
    text = found.text_of_word()
    many = len(model.langs)
    letters = np.bincount(text * many + labels, weights=seen.letters, minlength=n * many).reshape(n, many)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    share = letters[np.arange(n), best] / np.maximum(total, 1)
    edge = np.ones(len(labels), dtype=bool)
    edge[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(labels)) - 1
    spans: list[list] = [[] for _ in range(n)]
    for t, a, b, k in zip(text[at].tolist(), at.tolist(), end.tolist(), labels[at].tolist(), strict=True):
        if total[t]:
            spans[t].append({"first_word": a - int(found.first[t]), "last_word": b - int(found.first[t]),
                             "lang": model.langs[k]})
    names = [model.langs[k] if w else "und" for k, w in zip(best.tolist(), total.tolist(), strict=True)]
    return names, np.where(total > 0, share, 0.0).tolist(), spans


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, spans (first and last word, language)."""
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in words.chunks(batch.column(1), STEP_BYTES):
                names, scores, spans = _label(model, found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(spans, span)], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {SPANS}")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and label them: doc_id, held_out, lang_pred, score, n_spans."""
    return languages(docs, learn(docs)).select(
        "doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "lang_pred", "score",
        F.size("spans").alias("n_spans"))

"""Documents that contain or paraphrase benchmark items, found by latent semantic retrieval.

1. Benchmark items are cut into passages of ``PASSAGE`` words at steps of half of it, and taken in blocks of
   ``BLOCK`` passages, each of which is searched in all documents. A block and its index are all that is sent out,
   and both are bounded by ``BLOCK``.
2. One pass over the documents counts, for the block's words, the half passages they occur in. Words in more than
   ``COMMON`` of them weigh nothing, unless an item has few others.
3. A randomised singular value decomposition of the block's TF-IDF passages, its products computed and added up in
   Spark, gives the latent space: the ``RANK`` leading directions, and one more for each item passage that these hold
   less than ``HELD`` of. Weights are square roots of inverse document frequencies, so that a paraphrase that changes
   an item's rarest words still holds much of it.
4. A second pass projects every passage of every document and compares it with all items at once. Passages of a
   cosine of ``COSINE`` or more with an item, in the latent space, that hold ``SHARE`` of its length there are
   candidates. Words that no item has are not in the space.
5. A candidate is confirmed on words, beyond the passage by the item's length on both sides: the longest common
   subsequence covers ``COVER`` of the item, or ``PARAPHRASE`` of it and the item's answer, its last ``ANSWER``
   words, is there too. Items of fewer than ``SHORT`` words must be there word by word.

Words are compared without case and ASCII punctuation. Each document is judged whole within its batch, so nothing
but the pairs found leaves a task, and no pair of documents is ever formed.

Defined results: null and empty texts hold nothing, and such items are in nothing. Repeated rows are judged one by
one; a repeated item counts once. A missing ``doc_id`` or ``item_id`` is reported as null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.session import stage

PASSAGE = 64
HALF = PASSAGE // 2
BLOCK = 512
COMMON = 0.05
LEAST_WORDS = 4
RANK = 256
HELD = 0.5
COSINE = 0.15
SHARE = 0.25
#: Blocks that one pass of ``clean`` takes together.
TOGETHER = 2
COVER = 0.8
PARAPHRASE = 0.6
ANSWER = 5
SHORT = 8
_COLUMNS = 256

FOUND = "doc_id bigint, item_id bigint, cosine double, lcs double, answer boolean"


@dataclass(frozen=True)
class Item:
    item_id: int | None
    words: tuple[int, ...]


@dataclass(frozen=True)
class Index:
    """A block's words (ascending), their weights and latent rows, and its passages' latent directions and lengths."""

    items: list[Item]
    vocabulary: np.ndarray
    weights: np.ndarray
    latent: np.ndarray
    passages: np.ndarray
    sizes: np.ndarray
    item_of: np.ndarray


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, words.Words]]:
    return words.chunks(pc.utf8_lower(texts), gaps=words.NOT_ALPHANUMERIC)


def _passages(n: int) -> list[tuple[int, int]]:
    """Starts and ends of an item's passages."""
    return [(k, min(n, k + PASSAGE)) for k in range(0, max(1, n - HALF), HALF)] if n else []


def blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Distinct items with words, in blocks of at most ``BLOCK`` passages (a longer item is a block)."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        for _, _, found in _chunks(pa.array([row[1]])):
            own = tuple(found.hashes().tolist())
            n = len(_passages(len(own)))
            if n and held + n > BLOCK and block:
                yield block
                block, held = [], 0
            if n:
                block.append(Item(row[0], own))
                held += n
    if block:
        yield block


def _places(found: words.Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words of the vocabulary, and their columns."""
    own = found.hashes()
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == own)
    return hit, at[hit]


def _halves(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """The half passage of every word, counted over the chunk, and each text's first one."""
    counts = found.counts
    number = -(-counts // HALF)
    first = np.concatenate([[0], np.cumsum(number)])
    inside = np.arange(counts.sum()) - np.repeat(found.first[:-1], counts)
    return inside // HALF + np.repeat(first[:-1], counts), first


def _occurrences(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, halves = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, _, found in _chunks(batch.column(0)):
                half, first = _halves(found)
                hit, column = _places(found, vocabulary)
                pairs = np.unique(half[hit] * len(vocabulary) + column)
                total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                halves += first[-1]
        total[-1] = halves
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    return run


def _weights(docs: DataFrame, items: list[Item], vocabulary: np.ndarray) -> np.ndarray:
    """Square roots of inverse document frequencies over all half passages of all documents."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(
        _occurrences(vocabulary), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen, halves = np.zeros(len(vocabulary)), 0
    for r in counted:
        if r.place == len(vocabulary):
            halves = r.n
        else:
            seen[r.place] = r.n
    weights = np.sqrt(np.log((2.0 + halves) / (1.0 + seen)))
    rare = seen <= COMMON * halves
    for item in items:
        own = np.searchsorted(vocabulary, np.array(item.words, dtype=np.uint64))
        if len(set(own[rare[own]].tolist())) < LEAST_WORDS:
            rare[own] = True
    return np.where(rare, weights, 0.0)


def _gram(passages: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'AQ of the passages A and a basis Q; each task gives its part for blocks of columns, which Spark adds up."""
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            for columns, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.array(values)
                total[columns] += np.outer(values, values @ basis[columns])
        for k in range(0, len(total), _COLUMNS):
            part = total[k:k + _COLUMNS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], ["k", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x).reshape(-1, width) for x in group["part"])
        return pd.DataFrame({"k": group["k"].iloc[:1], "part": [total.tobytes()]})

    out = np.zeros_like(basis)
    schema = "k bigint, part binary"
    for r in passages.mapInArrow(run, schema).groupBy("k").applyInPandas(add, schema).collect():
        part = np.frombuffer(r.part).reshape(-1, width)
        out[r.k:r.k + len(part)] = part
    return out


def decomposition(passages: DataFrame, columns: int, rank: int) -> np.ndarray:
    """The leading right singular vectors of sparse rows (columns, values): random range, two power steps."""
    wide = min(columns, rank + 8)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((columns, wide)))[0]
    for _ in range(2):
        basis = np.linalg.qr(_gram(passages, basis))[0]
    small = basis.T @ _gram(passages, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    leading = np.argsort(values)[::-1][:rank]
    return basis @ vectors[:, leading[values[leading] > 1e-9 * max(values.max(), 1e-300)]]


def _holding(latent: np.ndarray, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    """``latent`` with directions of their own for the rows (columns, values) that it holds little of."""
    left = []
    for columns, values in rows:
        whole = np.zeros(len(latent))
        whole[columns] = values
        held = latent @ (latent.T @ whole)
        if np.linalg.norm(held) < HELD * np.linalg.norm(whole):
            left.append(whole - held)
    if not left:
        return latent
    more = np.linalg.qr(np.array(left).T)[0]
    return np.linalg.qr(np.concatenate([latent, more], axis=1))[0]


def index(docs: DataFrame, items: list[Item]) -> Index:
    """Weights, latent space and vectors of a block of items."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.array([w for item in items for w in item.words], dtype=np.uint64))
    weights = _weights(docs, items, vocabulary)
    rows, item_of = [], []
    for k, item in enumerate(items):
        own = np.searchsorted(vocabulary, np.array(item.words, dtype=np.uint64))
        for a, b in _passages(len(own)):
            column, times = np.unique(own[a:b], return_counts=True)
            value = weights[column] * times
            size = np.linalg.norm(value)
            if size:
                rows.append((column[value > 0].tolist(), value[value > 0].tolist()))
                item_of.append(k)
    if not rows:
        empty = np.zeros((len(vocabulary), 0))
        return Index(items, vocabulary, weights, empty, np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=np.int64))
    passages = spark.createDataFrame(rows, "columns array<int>, vals array<double>")
    latent = _holding(decomposition(passages, len(vocabulary), min(RANK, len(rows), len(vocabulary))), rows)
    vectors = np.array([np.array(v) @ latent[c] for c, v in rows])
    sizes = np.linalg.norm(vectors, axis=1)
    return Index(items, vocabulary, weights, (latent * weights[:, None]).astype(np.float32),
                 (vectors / sizes[:, None]).astype(np.float32), sizes.astype(np.float32), np.array(item_of))


def common_subsequence(item: tuple[int, ...], masks: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    full = (1 << len(item)) - 1
    state = full
    for word in text:
        mask = masks.get(word)
        if mask:
            kept = state & mask
            state = ((state + kept) | (state - kept)) & full
    return len(item) - state.bit_count()


def _masks(item: tuple[int, ...]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


def _candidates(known: Index, found: words.Words) -> dict[tuple[int, int], list]:
    """Per (text, item): best cosine, first and last word of the candidate passages."""
    half, first = _halves(found)
    hit, column = _places(found, known.vocabulary)
    weighted = known.weights[column] > 0
    hit, column = hit[weighted], column[weighted]
    out: dict[tuple[int, int], list] = {}
    if not len(hit):
        return out
    used, begin = np.unique(half[hit], return_index=True)
    vectors = np.add.reduceat(known.latent[column], begin, axis=0)
    text = np.searchsorted(first, used, side="right") - 1
    # a passage is a half and the next one of its text; the half before an unused one stands alone
    follows = np.zeros(len(used), dtype=bool)
    follows[:-1] = (used[1:] == used[:-1] + 1) & (text[1:] == text[:-1])
    after = np.flatnonzero(follows) + 1
    vectors = np.concatenate([vectors, np.zeros_like(vectors[:1])])
    pair = np.full(len(used), len(used))
    pair[after - 1] = after
    for lo in range(0, len(used), 8192):
        part = slice(lo, min(lo + 8192, len(used)))
        whole = vectors[part] + vectors[pair[part]]
        near = whole @ known.passages.T
        size = np.maximum(np.linalg.norm(whole, axis=1), 1e-30)
        rows, cols = np.nonzero((near >= COSINE * size[:, None]) & (near >= SHARE * known.sizes[None, :]))
        for row, col in zip(rows.tolist(), cols.tolist(), strict=True):
            k = lo + row
            t = int(text[k])
            a = int(found.first[t]) + int(used[k] - first[t]) * HALF
            b = min(a + PASSAGE, int(found.first[t + 1]))
            cosine = float(near[row, col] / size[row])
            seen = out.setdefault((t, int(known.item_of[col])), [0.0, []])
            seen[0] = max(seen[0], min(cosine, 1.0))
            seen[1].append((a, b))
    return out


def _joined(spans: list[tuple[int, int]], more: int, lowest: int, highest: int) -> Iterator[tuple[int, int]]:
    """Candidate passages that touch, as one span, widened by ``more`` words on both sides."""
    last = None
    for a, b in sorted(set(spans)):
        if last and a <= last[1]:
            last = (last[0], max(last[1], b))
        else:
            if last:
                yield max(lowest, last[0] - more), min(highest, last[1] + more)
            last = (a, b)
    if last:
        yield max(lowest, last[0] - more), min(highest, last[1] + more)


def leaks(known: Index, found: words.Words) -> Iterator[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, covered share, answer found) of the confirmed pairs of a chunk."""
    candidates = _candidates(known, found)
    if not candidates:
        return
    own = found.hashes()
    for (t, k), (cosine, spans) in sorted(candidates.items()):
        item = known.items[k].words
        n, masks, ending = len(item), _masks(item), item[-ANSWER:]
        best, answer, verbatim = 0, False, False
        for a, b in _joined(spans, n, int(found.first[t]), int(found.first[t + 1])):
            text = own[a:b].tolist()
            best = max(best, common_subsequence(item, masks, text))
            answer = answer or common_subsequence(ending, _masks(ending), text) >= COVER * len(ending)
            if n < SHORT:
                verbatim = verbatim or any(tuple(text[j:j + n]) == item for j in range(len(text) - n + 1))
        if verbatim if n < SHORT else best >= COVER * n or (best >= PARAPHRASE * n and answer):
            yield t, k, cosine, best / n, answer


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs found: doc_id, item_id, cosine, lcs (share of the item), answer."""
    made = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for items in blocks(benchmark):
        known = index(docs, items)

        def run(batches: Iterator[pa.RecordBatch], known: Index = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, found in _chunks(batch.column(1)):
                    rows = list(leaks(known, found))
                    ids = batch.column(0).take(pa.array([lo + r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([known.items[r[1]].item_id for r in rows], pa.int64()),
                        *(pa.array([r[j] for r in rows], kind) for j, kind in
                          ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_())))],
                        ["doc_id", "item_id", "cosine", "lcs", "answer"])

        pairs = made.mapInArrow(run, FOUND)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Words are counted over all rows given, so neither the order of blocks nor what they remove changes a verdict. A
    pass takes ``TOGETHER`` blocks; with more of them it is written before the next one reads it.
    """
    place, given, passes = docs.columns.index("text"), docs, 0
    todo = blocks(benchmark)
    while group := list(itertools.islice(todo, TOGETHER)):
        known = [index(given, items) for items in group]

        def run(batches: Iterator[pa.RecordBatch], known: list[Index] = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, found in _chunks(batch.column(place)):
                    keep = np.ones(hi - lo, dtype=bool)
                    for each in known:
                        keep[[r[0] for r in leaks(each, found)]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        docs = (stage(docs, "decontaminated") if passes else docs).mapInArrow(run, docs.schema)
        passes += 1
    return docs

"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r (or another set of ASCII bytes), so it is the same
run of characters in UTF-8. Every word gets a 64-bit hash of its bytes with A-Z lowered: a polynomial over random
byte codes, mixed at the end. Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (9, 10, 11, 12, 13, 32)
CHUNK_BYTES = 1 << 19

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_CODES = _RANDOM.integers(1, 2**63, 256, dtype=_U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
#: For passages: everything in ASCII but letters and digits ends a word.
NOT_ALPHANUMERIC = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
_LOWERED_CODES = _CODES[LOWER]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


class Recent(dict):
    """Values made when first asked for. Those asked for again outlive the rest: when ``most`` are held they become
    the older generation, from which they are taken over one by one, and the generation before is forgotten."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = made
        return made


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            kept = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base, dtype=_U)]))
        if size <= 4 * CHUNK_BYTES:  # those of one enormous text are not kept
            _POWERS[base] = kept
    return kept[:n]


@dataclass
class Words:
    """The words of some texts: their bytes, start and end of each word, each text's first word and first byte."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=_U)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, dtype=_U)
            np.cumsum(_LOWERED_CODES[self.data] * _powers(_STEP, len(self.data)), out=sums[1:])
            own = (sums[self.ends] - sums[self.starts]) * _powers(_BACK, len(self.data))[self.starts]
            return mix(own + (self.ends - self.starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets.astype(np.int64), raw


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, gaps: np.ndarray = IS_SPACE) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of whole texts of about ``limit`` bytes; one longer text is a run."""
    offsets, raw = buffers(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, split(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], gaps)
        lo = hi
    release()


def release() -> None:
    """Give freed memory back to the machine: workers stay alive between tasks and between operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def split(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = IS_SPACE) -> Words:
    """Words of consecutive texts; a text's end ends a word."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~gaps[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] |= inside[1:-1][cut]
    ends[cut - 1] |= inside[1:-1][cut - 1]
    begin = np.flatnonzero(starts)
    return Words(data, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds), bounds)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words of each text, ascending, and where each text's begin.

    A text with fewer words has one shingle, all its words; a text without words has none.
    """
    counts, first = words.counts, words.first
    own = words.hashes()
    with np.errstate(over="ignore"):
        runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        begin = np.concatenate([[0], np.cumsum(runs)])
        at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
        short = np.repeat(np.where(counts < size, counts, size), runs)
        out = np.zeros(len(at), dtype=_U)
        for k in range(size):
            live = short > k
            nxt = own[at[live] + k] if not live.all() else own[at + k]
            if live.all():
                out = mix(out * _U(0x9FB21C651E98DF25) + nxt)
            else:
                out[live] = mix(out[live] * _U(0x9FB21C651E98DF25) + nxt)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][runs > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[begin]

"""Fill-in-the-middle: two cuts a document, found in an indexable skip list over its units.

A unit is a run of A-Z and a-z, or any other single code point. The base lane of the list has a node for every unit; a
node is in each further lane with a chance of one in ``FAN``, told by a hash of its rank. Every node of every lane
carries the width to the lane's next node in units, in code points and in bytes. A search for a rank starts in the
sparsest lane and goes on while the widths passed do not exceed the rank, then one lane down: the widths passed add
up to the code points and bytes before the cut.

Draws come from the sha256 of a salt and the document's id, so they hold wherever and however often a row is
computed. A list is built of one text at a time, in blocks of ``BLOCK`` bytes, and takes up to some 12 bytes a byte
of that text where no two letters meet; nothing is held between texts.

Defined results: a null text is empty, and an empty text or one that holds a marker stays plain. A null id draws like
an empty one. Rows are never dropped; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mix

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
SALT = "1:"
#: Of 100 draws so many are left plain, and of the others so many put the suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
FAN = 16
BLOCK = 1 << 20
#: Texts of so many bytes go into one batch of results, or one longer text.
BATCH_BYTES = 1 << 22


def offsets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit begins in bytes and in code points, and the ends of the last one."""
    octets, points, seen, after_letter = [], [], 0, False
    for lo in range(0, len(data), BLOCK):
        part = data[lo:lo + BLOCK]
        letter = ((part | np.uint8(0x20)) - np.uint8(0x61)) < 26
        follows = np.concatenate([[after_letter], letter[:-1]])
        leads = (part & np.uint8(0xC0)) != 0x80
        at = np.flatnonzero(leads & ~(letter & follows))
        upto = np.cumsum(leads)
        octets.append((at + lo).astype(np.uint32))
        points.append((upto[at] - 1 + seen).astype(np.uint32))
        seen, after_letter = seen + int(upto[-1]), bool(letter[-1])
    return (np.concatenate([*octets, np.array([len(data)], np.uint32)]),
            np.concatenate([*points, np.array([seen], np.uint32)]))


def _promoted(ranks: np.ndarray, lane: int) -> np.ndarray:
    """Which nodes of the lane below are in this lane too: always the first, others by their ranks' hash."""
    with np.errstate(over="ignore"):
        hashes = mix(ranks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane))
    chosen = hashes % np.uint64(FAN) == 0
    chosen[0] = True
    return chosen


class SkipList:
    """The units of one text by rank."""

    def __init__(self, data: np.ndarray):
        octets_at, points_at = offsets(data)
        self.size, self.points, self.octets = len(octets_at) - 1, int(points_at[-1]), int(octets_at[-1])
        #: From the base up: widths of the lane's nodes in units, code points and bytes, and each node's place below.
        self.lanes = []
        ranks, below = np.arange(self.size + 1, dtype=np.uint32), np.zeros(0, np.uint32)
        while self.size:
            self.lanes.append((np.diff(ranks), np.diff(points_at[ranks]), np.diff(octets_at[ranks]), below))
            if len(ranks) - 1 <= FAN:
                break
            below = np.flatnonzero(_promoted(ranks[:-1], len(self.lanes))).astype(np.uint32)
            ranks = np.append(ranks[below], ranks[-1])

    def before(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit of this rank; ``size`` is a rank too, past the last unit."""
        node = passed = points = octets = 0
        for units, widths, sizes, below in reversed(self.lanes):
            while passed < rank and passed + (step := int(units[node])) <= rank:
                passed, points, octets = passed + step, points + int(widths[node]), octets + int(sizes[node])
                node += 1
            if passed == rank:
                break
            node = int(below[node])
        return points, octets


def draws(doc_id) -> list[int]:
    """The first four 32-bit numbers of the id's digest."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id, raw: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output, of one text in UTF-8."""
    units = SkipList(np.frombuffer(raw, np.uint8))
    h1, h2, h3, h4 = draws(doc_id)
    if not raw or h3 % 100 >= PLAIN_FROM or any(m in raw for m in MARKERS):
        return units.size, "plain", None, None, raw
    (points_a, a), (points_b, b) = map(units.before, sorted((h1 % (units.size + 1), h2 % (units.size + 1))))
    prefix, suffix, middle = MARKERS
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        form, output = "spm", b"".join((suffix, raw[b:], prefix, raw[:a], middle, raw[a:b]))
    else:
        form, output = "psm", b"".join((prefix, raw[:a], suffix, raw[b:], middle, raw[a:b]))
    return units.size, form, points_a, points_b - points_a, output


def transformed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def made(typed: pa.DataType, ids: list, rows: list) -> pa.RecordBatch:
        n, form, prefix, middle, output = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, typed), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
            pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = [], [], 0
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                rows.append(transform(ids[-1], raw.as_py() or b""))
                held += len(rows[-1][-1])
                if held >= BATCH_BYTES:
                    yield made(batch.column(0).type, ids, rows)
                    ids, rows, held = [], [], 0
            if rows:
                yield made(batch.column(0).type, ids, rows)

    given = docs.select("doc_id", docs["text"].cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                 "output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its three parts, cut at the markers, in their first order."""
    def upto(whole: Column, marker: str) -> Column:
        return F.substring_index(whole, marker, 1)

    def after(whole: Column, part: Column) -> Column:
        return F.substring(whole, F.length(part) + len(MIDDLE) + 1, F.length(whole))

    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    first = F.when(form == "spm", upto(body, PREFIX)).otherwise(upto(body, SUFFIX))
    rest = after(body, first)
    second = upto(rest, MIDDLE)
    third = after(rest, second)
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, third, first)).otherwise(
        F.concat(first, third, second))


def digests(made: DataFrame) -> DataFrame:
    """``transformed`` rows with sha256 digests of the output and of the text restored from it, in place of the output."""
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(text, 256).alias("restored_sha256"))

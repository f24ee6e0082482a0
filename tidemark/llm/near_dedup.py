"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

1. One pass over the texts gives the number of each document's distinct shingles, a 128-bit fingerprint of their set,
   and a signature that keeps the smallest and the largest value under each permutation: two values for one hash
   evaluation per shingle. Bands of four values (both ends of two permutations) give the bucket keys. There are as many
   bands as a pair at the smallest similarity needs to share a bucket but for a chance of ``MISSED``. The sets
   themselves are not kept.
2. Documents of the same set are one class, named by its smallest id; only classes go on.
3. A bucket's classes are paired with its smallest one, the centre. All classes that meet a centre in any bucket
   form its group, so every pair that shares a bucket is in some group, and is in it once, not once a band.
4. A group is cut into blocks of bounded shingles and members. Each block with the centre is one task's work: all
   similarities by matrix products over whole sets, inside numpy. Out come at most as many links as the block has
   members, a spanning forest of all links found, so no link between different texts is lost and no pair is listed.
   Members now linked to the centre are one already; each block is compared with the blocks of the others only.
   Sets are made anew for the texts that this needs. A bitmap of their ids, of ``BITS`` bits an id, keeps the others
   out; past ``FILTER_BITS`` it holds fewer bits an id and lets through more texts, which a join then leaves out.
5. Connected components by alternating smallest-neighbour steps, each written to the shared folder.

Defined results: null, empty and blank texts have no shingles and are linked with nothing. Rows that share a
``doc_id`` are one node, whose links are those of all its texts. A row without ``doc_id`` is linked with nothing,
its component is null and it is kept. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.operators import skew
from tidemark.session import stage

BAND = 4
#: The chance that a pair at the smallest similarity shares no bucket.
MISSED = 5e-7
#: The most permutations that signatures may have.
PERMUTATIONS = 128
#: Shingles of one block of a group (8 bytes each).
BLOCK_SHINGLES = 1_000_000
#: Members of one block of a group; a task holds two blocks and a byte for each pair of their members.
BLOCK_MEMBERS = 2000
#: Cells of the arrays that similarities are computed in.
CELLS = 1 << 21
#: Bits an id of the filter that keeps texts out whose sets are not needed, and its most bits: a broadcast of at most a
#: million words of 64 bits.
BITS, FILTER_BITS = 16, 1 << 26

_U = np.uint64
_DRAW = np.random.default_rng(7)
_TIMES = (_DRAW.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))
_PLUS = _DRAW.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)

BANDED = "doc_id bigint, n_shingles bigint, fp_a bigint, fp_b bigint, bands array<bigint>"
WHOLE = "doc_id bigint, n_shingles bigint, fp_a bigint, fp_b bigint, shingles binary"


def bands_for(percent: int) -> int:
    """Bands that miss a pair of this similarity with a chance of ``MISSED`` at most. Each of a band's values agrees
    with a chance that is the similarity."""
    same = (percent / 100) ** BAND
    return max(1, min(2 * PERMUTATIONS // BAND, math.ceil(math.log(MISSED) / math.log1p(-same)) if same < 1 else 1))


def signatures(values: np.ndarray, begin: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest value under each permutation, for each non-empty run of ``values``."""
    folded = (values ^ (values >> _U(32))).astype(np.uint32)
    at = begin[:-1]
    out = np.empty((len(at), 2 * permutations), dtype=np.uint32)
    for p in range(permutations):
        seen = folded * _TIMES[p] + _PLUS[p]
        seen ^= seen >> np.uint32(15)
        out[:, 2 * p] = np.minimum.reduceat(seen, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(seen, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    n, values = signature.shape
    bands = values // BAND
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (n, bands))
    parts = signature.reshape(n, bands, BAND).astype(_U)
    for k in range(BAND):
        key = words.mix(key * _U(0x9FB21C651E98DF25) + parts[:, :, k])
    return key


def _sets(size: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``BANDED``, or without bands of ``WHOLE``."""
    names = ["doc_id", "n_shingles", "fp_a", "fp_b", "bands" if bands else "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in words.chunks(batch.column(1)):
                values, begin = words.shingles(found, size)
                n = np.diff(begin)
                full = n > 0
                print_a, print_b = np.zeros(hi - lo, dtype=_U), np.zeros(hi - lo, dtype=_U)
                keys = np.zeros((0, bands), dtype=_U)
                if full.any():
                    at = np.append(begin[:-1][full], begin[-1])
                    print_a[full] = np.add.reduceat(words.mix(values + _U(0x632BE59BD9B4E019)), at[:-1])
                    print_b[full] = np.add.reduceat(words.mix(values ^ _U(0xA0761D6478BD642F)), at[:-1])
                    if bands:
                        keys = band_keys(signatures(values, at, bands * BAND // 2))
                if bands:
                    ends = np.concatenate([[0], np.cumsum(full) * bands]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                else:
                    last = pa.Array.from_buffers(pa.binary(), hi - lo, [
                        None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                    pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)), last], names)

    return run


def links_of(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between distinct sets, as positions in ``sets``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * shared >= percent * (sizes.sum() - shared):
            yield 0, 1
        return
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    both = times[column] > 1
    row, column = row[both], column[both]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    linked = np.zeros((m, m), dtype=bool)
    height, width = max(1, CELLS // m), max(256, 2 * CELLS // m)
    cuts = np.searchsorted(column, range(0, columns + width, width))
    for top in range(0, m, height):
        end = min(top + height, m)
        shared = np.zeros((end - top, m - top), dtype=np.float32)
        for k, lo in enumerate(range(0, columns, width)):
            r, c = row[cuts[k]:cuts[k + 1]], column[cuts[k]:cuts[k + 1]]
            part = np.zeros((m - top, min(width, columns - lo)), dtype=np.float32)
            here = r >= top
            part[r[here] - top, c[here] - lo] = 1
            shared += part[:end - top] @ part.T
        # float32 counts are exact below 2**24 shared shingles
        shared = shared.astype(np.float64)
        near = 100.0 * shared >= percent * (sizes[top:end, None] + sizes[None, top:] - shared)
        linked[top:end, top:] = near
        linked[top:, top:end] = near.T
    np.fill_diagonal(linked, False)
    seen = np.zeros(m, dtype=bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            near = np.flatnonzero(linked[front.pop()] & ~seen)
            seen[near] = True
            front.extend(near.tolist())
            for x in near.tolist():
                yield root, x


def _blocks(members: DataFrame, weight: DataFrame) -> DataFrame:
    """centre, blocks: the blocks that the members (centre, cid) of each centre are cut into, where one is too few."""
    return members.join(weight, "cid").groupBy("centre").agg(F.greatest(
        F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS))).cast("int").alias(
        "blocks")).where("blocks > 1")


def group_links(paired: DataFrame, weight: DataFrame, whole: Callable[[DataFrame], DataFrame],
                percent: int) -> DataFrame:
    """u, v: links that join all members (centre, cid) of a centre's group that have a chain of links inside it."""
    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")

    def numbers(blocks: str) -> Column:
        return F.sequence(F.lit(0), F.col(blocks) - 1)

    def confirmed(members: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
        return members.join(whole(ids.select("cid").distinct()), "cid").groupBy(*keys).applyInPandas(_confirm(percent), "u bigint, v bigint")

    large = stage(_blocks(paired, weight), "large-groups")
    dealt = paired.join(large, "centre", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    once = confirmed(dealt.select("centre", "cid", F.explode(
        F.when(F.col("cid") == F.col("centre"), numbers("blocks")).otherwise(F.array(own("blocks")))).alias("block")),
        paired, "centre", "block")
    if large.isEmpty():
        return once
    once = stage(once, "links-in-blocks")
    members = stage(paired.join(large, "centre"), "members")
    # a link's smaller end is the centre for those it is already one with
    apart = stage(members.where("cid <> centre").join(once.select(F.col("u").alias("centre"), F.col("v").alias("cid")),
                                                      ["centre", "cid"], "left_anti"), "apart")
    if apart.isEmpty():
        return once
    cut = apart.groupBy("centre").agg(F.count("*").alias("n")).join(
        _blocks(apart.select("centre", "cid"), weight).withColumnRenamed("blocks", "cuts"), "centre", "left").select(
        "centre", F.coalesce("cuts", F.lit(1)).alias("cuts"))
    cut = stage(cut, "apart-blocks")
    left = members.join(cut, "centre").select(
        "centre", "cid", own("blocks").alias("block"), F.explode(numbers("cuts")).alias("cut"))
    right = apart.join(cut, "centre").select(
        "centre", "cid", F.explode(numbers("blocks")).alias("block"), own("cuts").alias("cut"))
    return once.unionByName(confirmed(
        left.unionByName(right).distinct(), members.join(cut, "centre", "left_semi"), "centre", "block", "cut"))


def _confirm(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")  # the centre has the smallest id, and links lead from the first
        ids = group["cid"].to_numpy()
        sets = [np.frombuffer(x, dtype=_U) for x in group["shingles"]]
        found = [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in links_of(sets, percent) if ids[a] != ids[b]]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node``, ``component`` for every node of ``links`` (u, v): its smallest reachable node.

    Turns of linking a node's larger neighbours, then its smaller ones, to its smallest neighbour, until nothing
    changes; the number of turns grows with the logarithm of the longest path. Only aggregations and joins on a
    node are used, so a node with many neighbours is never gathered.
    """
    now = stage(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
                label)
    mark = None
    while True:
        facts = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts[0] == 0 or tuple(facts) == mark:
            return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        mark = tuple(facts)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # every edge now leads from a smaller u to a larger v: link the v's and their other u's to the smallest u
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(
            F.explode(F.array(F.struct("m", "v"), F.struct("m", F.col("u").alias("v")))).alias("e")).select(
            F.col("e.m").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct()
        now = stage(small, label)


def filtered(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, text) whose id may be among the distinct ``ids`` (cid), none of those missing."""
    count = ids.count()
    size = min(FILTER_BITS, max(64, 1 << (BITS * max(1, count) - 1).bit_length()))

    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(size))

    marks = ids.select(bit("cid").alias("bit")).select(
        F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS int))").alias("mark")).groupBy(
        "word").agg(F.bit_or("mark").alias("marks"))
    placed = texts.withColumn("bit", bit("doc_id"))
    kept = placed.join(F.broadcast(marks), F.floor(placed["bit"] / 64).cast("int") == marks["word"])
    return kept.where("(shiftright(marks, cast(bit % 64 AS int)) & 1) = 1").select("doc_id", "text")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links sets of ``size``-word shingles with 100 * intersection >= ``percent`` * union.
    """
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(made.mapInArrow(_sets(size, bands_for(percent)), BANDED), "bands")
    rows = sets.select("doc_id", "n_shingles", "fp_a", "fp_b")
    prints = ["fp_a", "fp_b"]
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*prints).agg(
        F.min("doc_id").alias("cid"), F.count("*").alias("_rows"))
    named = skew.salted_lookup(rows, classes.drop("_rows"), prints, classes.drop("cid"))
    member = stage(named.select("doc_id", "n_shingles", *prints, F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("cid")).alias("cid")), "classes")

    # Classes and their buckets; a class is represented by one row of its smallest id.
    first = member.where("doc_id = cid").groupBy("cid", *prints).agg(F.first("n_shingles").alias("n"))
    buckets = sets.select(F.col("doc_id").alias("cid"), *prints, "bands").join(
        first, ["cid", *prints], "left_semi").select("cid", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("cid").alias("centre"), F.max("cid").alias("other")).where(
        "centre < other").select("bucket", "centre")
    paired = stage(buckets.join(shared, "bucket").select("centre", "cid").distinct(), "groups")

    def whole(ids: DataFrame) -> DataFrame:
        """Whole sets of some classes."""
        wanted = stage(first.join(ids, "cid", "left_semi").select("cid", *prints), "wanted-sets")
        texts = filtered(made, wanted.select("cid").distinct())
        found = texts.mapInArrow(_sets(size, 0), WHOLE).withColumnRenamed("doc_id", "cid")
        return found.join(wanted, ["cid", *prints], "left_semi").groupBy("cid", *prints).agg(F.first("shingles").alias("shingles"))

    links = group_links(paired, first.groupBy("cid").agg(F.sum("n").alias("n")), whole, percent)

    # An id that names several texts is one node: its classes are linked through it.
    several = member.where("cid IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where(
        "a < b").select("doc_id")
    through = member.where("cid IS NOT NULL").join(several, "doc_id", "left_semi").select(
        F.col("doc_id").alias("u"), F.col("cid").alias("v"))
    labels = components(links.unionByName(through), "components")

    return member.join(labels, member["cid"] == labels["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "cid", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component, one of each, with all their columns.

    The ids that go are staged, so the planner broadcasts them only while their files are small. Rows whose id is used
    again are told apart by their texts: a text stays unless a near copy of it does, and of rows that share id and
    text one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        found = near_duplicates(docs, size, percent)
        gone = stage(found.where("NOT kept").select("doc_id").distinct(), "dropped")
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("row"), "doc_id", text.alias("text")).join(
        again.select(F.col("doc_id").alias("again")), F.col("doc_id") == F.col("again"), "left")
    # Ids of their own, below all others, for the texts of an id that is used again.
    own = F.when(F.col("again").isNull(), F.col("doc_id").cast("bigint")).otherwise(
        F.lit(-2**62) - F.abs(F.shiftright(F.xxhash64("doc_id", "text"), 2)))
    rows = rows.withColumn("node", own)
    found = near_duplicates(rows.select(F.col("node").alias("doc_id"), "text"), size, percent)
    gone = stage(found.where("NOT kept").select(F.col("doc_id").alias("node")).distinct(), "dropped")
    rest = rows.join(gone, "node", "left_anti")
    one = rest.where("again IS NOT NULL").groupBy("node").agg(F.first("row").alias("row"))
    return rest.where("again IS NULL").select("row.*").unionByName(one.select("row.*"))

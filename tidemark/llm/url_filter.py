"""URL rules looked up in a sorted array of 64-bit digests that every worker maps into memory.

A rule is a host and the beginning of a path. It fits a URL whose host is the rule's or a subdomain of it and whose path
begins with the rule's. So the rules that may fit a URL are named by its host's endings, times its path's beginnings of
the lengths that rules have; each name's xxhash64 is looked for.

The index is one file: digests, ascending, where each rule's text begins, its path's length, its verdict, then the
texts. Spark's file distribution brings it from the shared folder to every executor, also to one that replaces a lost
one, and the workers of a machine map the same pages of it, read only. Spark computes the digests of a batch of
URLs, one vectorised binary search finds those the array holds, and the stored text of every hit is compared, so two
texts with one digest are told apart. Of the rules that fit the longest decides, of equally long ones that with
the longer host; a URL that none fits has the default verdict.

A rule table is measured before it is indexed: up to ``INDEX_BYTES`` it goes through the driver into the file; a larger
one is never collected, its rules are joined to the URLs' names instead, with the same results.

Defined results: a null URL or one without ``://`` has an empty host and path. Ports and user names are part of the
host, as written. A URL without path has an empty one, which no path but an empty one begins. Rules without host are
left out; a null path is empty; hosts are lower-cased in A-Z; of repeated rules a block goes before an allow.
Repeated pages give repeated results; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir, stage

ALLOW, BLOCK = "allow", "block"
#: Of an index file; also what the driver holds while it is written.
INDEX_BYTES = 64 << 20
#: A rule's digest, offset, path length and verdict.
RULE_BYTES = 8 + 8 + 4 + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path as they stand between ``://`` and the query or fragment."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def cleaned(rules: DataFrame) -> DataFrame:
    """Distinct (key, host, path, verdict) of a rule table with these columns; ``key`` is the digest."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    named = rules.select(host.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                         F.col("verdict").cast("string").alias("verdict")).where("host <> ''")
    known = F.when(F.col("verdict").isin(ALLOW, BLOCK), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("Unknown verdict: "), F.coalesce("verdict", F.lit("null")))).cast("string"))
    return named.withColumn("verdict", known).groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.xxhash64(F.concat("host", "path")).alias("key"), "host", "path", "verdict")


def host_endings(host: Column) -> Column:
    """The host and what follows each of its dots, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def names(host: Column, path: Column, lengths: list[int]) -> Column:
    """Digests of every host ending (outer) with every path beginning of the given lengths (inner).

    Beginnings that the path is too short for and names without host are null, so that a place in the array tells
    which ending and which beginning it is.
    """
    return F.flatten(F.transform(host_endings(host), lambda ending: F.array(*[
        F.when((F.length(path) >= n) & (ending != ""), F.xxhash64(F.concat(ending, F.substring(path, 1, n))))
        for n in lengths])))


@dataclass
class DigestArray:
    """Rules by ascending digest: keys, text ends, path lengths, verdicts, and the texts one after the other."""

    keys: np.ndarray
    ends: np.ndarray
    path_chars: np.ndarray
    blocks: np.ndarray
    texts: np.ndarray

    @classmethod
    def of(cls, rules: list) -> DigestArray:
        """From rows of key, host, path, verdict."""
        rules = sorted(rules, key=lambda r: (r.key, r.host, r.path))
        texts = [(r.host + r.path).encode() for r in rules]
        return cls(np.array([r.key for r in rules], "<i8"), np.cumsum([len(t) for t in texts], dtype="<i8"),
                   np.array([len(r.path) for r in rules], "<i4"), np.array([r.verdict == BLOCK for r in rules], "u1"),
                   np.frombuffer(b"".join(texts), "u1"))

    def to_bytes(self) -> bytes:
        parts = (self.keys, self.ends, self.path_chars, self.blocks, self.texts)
        return np.int64(len(self.keys)).astype("<i8").tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        """The file's arrays, mapped into memory; pages are read when a search first touches them."""
        whole = np.memmap(path, np.uint8, "r")
        n, at, parts = int(whole[:8].view("<i8")[0]), 8, []
        for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("u1", 1)):
            parts.append(whole[at:at + n * width].view(kind))
            at += n * width
        return cls(*parts, whole[at:])

    def text(self, rule: int) -> str:
        return bytes(self.texts[int(self.ends[rule - 1]) if rule else 0:int(self.ends[rule])]).decode()

    def hits(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``digests`` and rules whose digest is there, all rules of one digest included."""
        low = np.searchsorted(self.keys, digests, "left")
        found = np.searchsorted(self.keys, digests, "right") - low
        at = np.repeat(np.arange(len(digests)), found)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)


def write_index(spark: SparkSession, rules: DataFrame) -> str:
    """Write the index of a bounded rule table to the shared folder and hand it to the executors; its file name."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(DigestArray.of(rules.collect()).to_bytes()))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def _longest(index: DigestArray, host: str, path: str, lengths: list[int], hits: list[tuple[int, int]]) -> tuple[str, bool] | None:
    """Text and verdict of the longest rule among (place, rule) hits whose stored text is the name at the place."""
    best = None
    for place, rule in hits:
        cut, beginning = divmod(place, len(lengths))
        ending = host.split(".", cut)[-1]
        text = ending + path[:lengths[beginning]]
        if index.path_chars[rule] == lengths[beginning] and index.text(rule) == text:
            best = max(best or (-1,), (len(text), len(ending), text, bool(index.blocks[rule])))
    return best and best[2:]


def _probed(urls: DataFrame, file: str, lengths: list[int], default: str) -> DataFrame:
    kind = urls.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray.mapped(SparkFiles.get(file))
        for batch in batches:
            lists = batch.column(3)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            given = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            at, rules = index.hits(flat.drop_null().to_numpy())
            at = given[at]
            rule, verdict = [None] * batch.num_rows, [default] * batch.num_rows
            of_row = np.searchsorted(bounds, at, "right") - 1
            by_row: dict[int, list] = {}
            for row, place, hit in zip(of_row.tolist(), at.tolist(), rules.tolist(), strict=True):
                by_row.setdefault(row, []).append((place - int(bounds[row]), hit))
            for row, hits in by_row.items():
                best = _longest(index, batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), lengths, hits)
                if best:
                    rule[row], verdict[row] = best[0], BLOCK if best[1] else ALLOW
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    named = urls.withColumn("names", names(F.col("host"), F.col("path"), lengths))
    return named.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, rules: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The same by a join, for rule tables beyond the bound: each distinct host and path is looked up once."""
    distinct = urls.select("host", "path").distinct()
    pairs = [F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("start")) for n in lengths]
    named = distinct.withColumn("ending", F.explode(host_endings(F.col("host")))).withColumn(
        "p", F.explode(F.filter(F.array(*pairs), lambda p: F.length(p["start"]) == p["n"])))
    found = named.select("host", "path", "ending", F.col("p.start").alias("start")).join(
        rules.select(F.col("host").alias("ending"), F.col("path").alias("start"), "verdict"), ["ending", "start"])
    text = F.concat("ending", "start")
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        F.length(text), F.length("ending"), text.alias("rule"), F.col("verdict"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, default: str = ALLOW, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (its host and path; null if none fits), verdict.

    ``rules`` has the columns host, path and verdict (allow or block). A rule table whose index takes up to
    ``most_bytes`` is mapped, a larger one joined.
    """
    spark = pages.sparkSession
    host, path = host_and_path(pages["url"].cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = stage(cleaned(rules), "url-rules")
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("path") + RULE_BYTES)).first()[0] or 0
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if size > most_bytes:
        return _joined(urls, known, lengths, default)
    return _probed(urls, write_index(spark, known), lengths, default)

"""Folders of quarterly archives as a Spark data source.

    archive_source.read(spark, folder)                                   # filing_period, member, line_no, cells
    archive_source.read(spark, folder, "ACCESSION_NUMBER string, TRANS_CODE string")
    spark.read.format("quarter_archives").option("member", "DERIV_TRANS").option("periods", "2023-Q1,2023-Q2").load(folder)

A task takes one member of one archive. The format's options name the member and the quarters that are opened at all; its
schema names the columns that are made. ``read`` is the union of one such scan a member, whose ``member`` is a constant
to the planner: a filter on it removes the other members' scans from the plan, so that they are never opened. Filters
are not taken by the source itself: Spark keeps what a Python source was given with the frame, so that two uses of one
frame in a plan would get each other's filters.

Rows without accession number are dropped; a column that a member's header lacks is null. The period is the archive's
file name in upper case, as in the inventory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, MapType, StringType, StructType

from tidemark.sources import archives

NAME = "quarter_archives"
ACCESSION = "ACCESSION_NUMBER"
PERIOD, MEMBER, LINE, CELLS = "filing_period", "member", "line_no", "cells"


def listed(folder: str) -> list[tuple[str, str]]:
    """(period, path) of every archive below a folder."""
    if folder.startswith("/") or re.match(r"^file:/", folder):
        system, root = pafs.LocalFileSystem(), "/" + re.sub(r"^file:", "", folder).lstrip("/")
        prefix = ""
    else:
        system, root = pafs.FileSystem.from_uri(folder)
        prefix = folder[:len(folder) - len(root.rstrip("/"))] if folder.rstrip("/").endswith(root.rstrip("/")) else ""
    found = system.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.base_name[:-4].upper(), prefix + f.path) for f in found if f.is_file and f.path.endswith(".zip"))


@dataclass
class Member(InputPartition):
    """One member of one archive."""

    period: str
    path: str
    member: str


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, member: str | None, periods: set[str]):
        self.folder, self.schema, self.periods = folder, schema, periods
        self.members = [m for m in archives.MEMBERS if member is None or m == member.upper()]
        if not self.members:
            raise ValueError(f"Archives have no member {member}.")
        for field in schema:
            want = {LINE: LongType(), CELLS: MapType(StringType(), StringType())}.get(field.name, StringType())
            if field.dataType.simpleString() != want.simpleString():
                raise ValueError(f"Column {field.name} of archives is {want.simpleString()}.")

    def partitions(self) -> list[Member]:
        return [Member(period, path, member) for period, path in listed(self.folder)
                if not self.periods or period in self.periods for member in self.members]

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions
            return
        own, names = {PERIOD: partition.period, MEMBER: partition.member}, [f.name for f in self.schema]
        for read in archives.member_lines(partition.path, partition.member):
            lines = read.having(ACCESSION)
            size = len(lines.rows)
            if not size:
                continue

            def column(name: str) -> pa.Array:
                if name == LINE:
                    return pa.array(lines.numbers, pa.int64())
                if name == CELLS:
                    return lines.cells()
                given = [own[name]] * size if name in own else lines.column(name)
                return pa.nulls(size, pa.string()) if given is None else pa.array(given, pa.string())

            yield pa.RecordBatch.from_arrays([column(n) for n in names], names=names)


class QuarterArchives(DataSource):
    """Options: ``path``, a folder below which archives are found; ``member``; ``periods``, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return archives.SECTION_DDL

    def reader(self, schema: StructType) -> ArchiveReader:
        if "path" not in self.options:
            raise ValueError("A folder of archives is needed.")
        periods = {p.strip().upper() for p in self.options.get("periods", "").split(",") if p.strip()}
        return ArchiveReader(self.options["path"], schema, self.options.get("member"), periods)


def read(spark: SparkSession, folder: str, columns: str | None = None, periods: tuple[str, ...] = ()) -> DataFrame:
    """The archives of a folder, or of some quarters: ``filing_period, member, line_no`` and the cells, or with
    ``columns``, a schema, those columns of text."""
    spark.dataSource.register(QuarterArchives)
    schema = f"{PERIOD} string, {LINE} bigint, {columns or CELLS + ' map<string,string>'}"

    def scan(member: str) -> DataFrame:
        rows = spark.read.format(NAME).schema(schema).option("member", member).option("periods", ",".join(periods)).load(folder)
        return rows.select(PERIOD, F.lit(member).alias(MEMBER), *[c for c in rows.columns if c != PERIOD])

    return reduce(DataFrame.unionByName, [scan(m) for m in archives.MEMBERS])

"""Stored tables: columns, natural keys, partitioning."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from tidemark.functions import hashing


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    hash_column: str | None = None
    partition_by: tuple[str, ...] = ()
    #: Partition columns whose value follows from the key, so rows of one key are in one partition.
    key_partitions: tuple[str, ...] = ()
    #: SQL of the column ``key_range``, which follows from the key: writes and lookups read the ranges of their keys.
    ranges: str | None = None
    #: Columns with a Parquet Bloom filter: a lookup skips the row groups that do not hold its value.
    bloom: tuple[str, ...] = ()
    #: Other columns that mostly hold fingerprints.
    prints: tuple[str, ...] = ()

    #: A range is a slice of the key's hash and nothing else.
    sliced: bool = False

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


#: The key of a stored row to one of 16 slices. A value once chosen holds for the life of a table.
SLICES = 16


def _slice(*columns: str) -> str:
    return f"lpad(cast(pmod(xxhash64({', '.join(columns)}), {SLICES}) as string), 2, '0')"


def _year(column: str, pattern: str) -> str:
    return f"coalesce(nullif(regexp_extract({column}, '{pattern}', 1), ''), 'none')"


INSIDER_TRANSACTIONS = Table(
    "insider_transactions",
    """source string, accession_number string, issuer_cik string, issuer_name string, ticker string,
    insider_name string, insider_cik string, transaction_date date, filing_date date, form_type string,
    transaction_code string, security_title string, shares double, price double, transaction_type string,
    acquired_disposed string, ownership_type string, ownership_nature string, source_url string,
    is_amendment boolean, date_of_orig_submission date, raw_payload string, record_hash string,
    created_at timestamp, filing_period string, key_range string""",
    ("source", "accession_number", "record_hash"), "record_hash", ("filing_period", "key_range"), ("key_range",),
    # The year of a filing is part of its accession number, so a quarter's batch reads the ranges of its own year.
    f"concat({_year('accession_number', '-([0-9][0-9])-')}, '-', {_slice('source', 'accession_number', 'record_hash')})")

FILING_DETAILS = Table(
    "filing_details",
    """filing_period string, accession_number string, member string, line_no bigint, cells string, record_hash string,
    created_at timestamp""",
    ("filing_period", "accession_number", "member", "line_no"), "record_hash", ("filing_period",), ("filing_period",))

INGESTION_STATE = Table(
    "ingestion_state",
    """period string, status string, records_parsed bigint, records_inserted bigint, duplicates_count bigint,
    invalid_count bigint, failures_count bigint, completed_at timestamp""", ("period",))

QUARTER_PROFILES = Table(
    "quarter_profiles",
    """period string, rows bigint, earliest_transaction date, latest_transaction date, distinct_accessions bigint,
    distinct_hashes bigint, profiled_at timestamp""", ("period",))

MARKET_PRICES = Table(
    "market_prices",
    """symbol string, price_date date, open double, high double, low double, close double, adjusted_close double,
    volume double, source string, record_hash string, created_at timestamp, price_year int""",
    ("symbol", "price_date", "source"), "record_hash", ("price_year",), ("price_year",))

CORPORATE_ACTIONS = Table(
    "corporate_actions",
    """symbol string, action_type string, action_date string, ratio string, cash_amount double, source string,
    record_hash string, created_at timestamp, key_range string""",
    ("symbol", "action_type", "action_date", "source"), "record_hash", ("key_range",), ("key_range",),
    _year("action_date", "^([0-9]{4})"))

RESEARCH_EVENTS = Table(
    "research_events",
    """event_key string, event_type string, symbol string, event_date date, methodology_version string,
    result_payload variant, created_at timestamp, key_range string""", ("event_key",), None, ("event_type", "key_range"),
    ("key_range",), _slice("event_key"), ("event_key",), sliced=True)

SIGNALS = Table(
    "signals",
    """signal_key string, symbol string, signal_date string, signal_type string, score double, rationale string,
    methodology_version string, created_at timestamp, key_range string""", ("signal_key",), None, ("key_range",), ("key_range",),
    _slice("signal_key"), ("signal_key",), sliced=True)

TRADE_RUNS = Table(
    "trade_runs",
    """run_id string, mode string, status string, started_at timestamp, completed_at timestamp, details string""",
    ("run_id",))

PROVENANCE = Table(
    "provenance",
    """record_type string, record_id string, source string, source_reference string, retrieved_at timestamp,
    checksum string, validation_status string, key_range string""", ("record_type", "record_id", "source"), None, ("key_range",),
    ("key_range",), _slice("record_type", "record_id", "source"), prints=("record_id", "checksum"))

TABLES = {t.name: t for t in (
    INSIDER_TRANSACTIONS, FILING_DETAILS, INGESTION_STATE, QUARTER_PROFILES, MARKET_PRICES, CORPORATE_ACTIONS, RESEARCH_EVENTS, SIGNALS, TRADE_RUNS,
    PROVENANCE)}


def read(spark: SparkSession, table: Table, path: str) -> DataFrame:
    """The stored rows; an absent path is an empty table."""
    try:
        return spark.read.schema(table.schema).parquet(path).select(*table.columns)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
        return spark.range(1).select(*none).where(F.lit(False))  # a frame of no Python rows starts no worker


def conform(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in order and type; columns the table does not have are refused."""
    unknown = sorted(set(df.columns) - set(table.columns))
    if unknown:
        raise ValueError(f"Unknown columns for {table.name}: {', '.join(unknown)}.")
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema
    ])


def ranged(df: DataFrame, table: Table) -> DataFrame:
    """With the ranges of the rows' keys."""
    return df.withColumn("key_range", F.expr(table.ranges)) if table.ranges else df


def with_key(rows: DataFrame, table: Table, *values: str) -> DataFrame:
    """The stored rows of one key. Its range is a constant to the planner, which reads that range only."""
    wanted = [F.col(c) == F.lit(v) for c, v in zip(table.key, values, strict=True)]
    if table.ranges:
        wanted.append(F.col("key_range") == F.expr(table.ranges))
    return rows.where(functools.reduce(operator.and_, wanted))


def append(df: DataFrame, table: Table, path: str, even: bool = True) -> None:
    """Append conforming rows. ``even`` evens out file sizes, large partitions included, by a shuffle; rows that come
    together by partition already do without."""
    rows = conform(ranged(df, table), table)
    if even:
        prints = (table.hash_column, *table.prints)
        packed = hashing.packed(rows, *prints).hint("rebalance", *[F.col(c) for c in table.partition_by])
        rows = hashing.unpacked(packed, *prints).select(*table.columns)
    # A filter follows the number of values, or it would be a megabyte for every file.
    writer = rows.write.mode("append").option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true").options(
        **{f"parquet.bloom.filter.enabled#{c}": "true" for c in table.bloom})
    (writer.partitionBy(*table.partition_by) if table.partition_by else writer).parquet(path)

"""Idempotent writes with an outcome for every row.

A batch is parsed once into a work folder, classified against the stored rows of its own keys, and its
outcomes (keys, fingerprint, index, no payload) are written beside it before new rows are appended. A
repeated delivery changes nothing, and a delivery that is run again after a failure keeps the outcomes it
has. Parquet has no unique constraint: each table has one writing job at a time, and the audits recheck
the keys. Work folders belong to the caller and may go once the delivery's outcomes are no longer wanted; a
delivery without one cannot be run again, and its staged batch goes as soon as its rows are appended.
"""

from __future__ import annotations

import datetime
import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates, hashing, text
from tidemark.schemas import Table
from tidemark.session import discard, freed_shuffles, fresh_dir, settings, written

INSERTED, DUPLICATE, CONFLICT, REJECTED = "INSERTED", "DUPLICATE", "CONFLICT", "REJECTED"
#: Columns a batch may carry beside the table's own.
BOOKKEEPING = frozenset(("index", "outcome", "reason", "errors"))
#: A batch of no more rows is broadcast to choose the stored rows of its keys.
FEW = 100_000
#: A join by deal and place takes both sides as they lie, by their deal.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: Groups of keys a bucket gets where a group lies in one slice; many, so that buckets are of a size.
GROUPS = 8


def _print(table: Table) -> Column:
    return F.col(table.hash_column) if table.hash_column else F.lit(1)


def _outcome(same_key: WindowSpec, keyed: Column, fingerprint: str, index: str) -> Column:
    """Of rows ``_kind`` 0 (stored) and 1 (batch); ``keyed`` says that no part of the key is null."""
    ordered = same_key.orderBy("_kind", F.when(F.col("_kind") == 0, F.col(fingerprint)), index)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col(fingerprint) == F.first(fingerprint).over(so_far)
    return F.when(keyed & (F.row_number().over(ordered) == 1), INSERTED).when(keyed & same, DUPLICATE).otherwise(CONFLICT)


def classify(batch: DataFrame, stored: DataFrame, key: list[str], fingerprint: str, index: str,
             few: bool = True) -> DataFrame:
    """Adds ``outcome``. Of a new key the row with the smallest index is INSERTED; all others compare
    with it, or with the stored row when the key exists: same fingerprint DUPLICATE, else CONFLICT.
    The index must be unique, or two rows of a key could both be first. A key with a null part is never stored.

    Rows meet in one shuffle, none if the batch comes dealt by a part of ``key``. A batch of ``few`` rows is compared
    with the stored rows of its own keys; one of many takes all that it is given.
    """
    known = stored.where(F.col(fingerprint).isNotNull())
    if few:
        known = known.join(batch.select(*key).distinct(), key, "left_semi")
    both = batch.withColumn("_kind", F.lit(1)).unionByName(
        known.select(*key, fingerprint).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    keyed = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in key])
    outcome = _outcome(Window.partitionBy(*key), keyed, fingerprint, index)
    return both.withColumn("outcome", outcome).where(F.col("_kind") == 1).drop("_kind")


def stored_for(spark: SparkSession, batch: DataFrame, table: Table, path: str) -> DataFrame:
    """The stored rows that can share a key with the batch: those of its partitions, where the key tells them.

    The list of partition values is as long as the batch has partitions (years, slices of years).
    """
    stored = schemas.read(spark, table, path)
    for column in table.key_partitions:
        values = [r[0] for r in batch.select(column).distinct().collect()]
        given = F.col(column).isin([v for v in values if v is not None])
        stored = stored.where(given | F.col(column).isNull() if None in values else given)
    return stored


def _deal(table: Table, buckets: int) -> Column:
    """What rows are dealt to buckets by: the key's hash, or some of its values in each slice of the table's ranges, where
    a range is a slice. A bucket then holds few ranges, and its rows go to their files as they are."""
    key = F.xxhash64(*table.key)
    if not table.sliced:
        return key
    parts = -(-GROUPS * buckets // schemas.SLICES)
    return F.pmod(key, F.lit(schemas.SLICES)) * parts + F.pmod(F.shiftrightunsigned(key, 8), F.lit(parts))


def _slim(batch: DataFrame, known: list[str]) -> DataFrame:
    """Rows that arrive decided never reach the table: of them only what their outcome tells is carried on."""
    undecided = F.col("outcome").isNull()
    return batch.withColumns({c: F.when(undecided, F.col(c)) for c in batch.columns if c not in (*known, "outcome")})


def _held(stored: DataFrame, table: Table, buckets: int) -> DataFrame:
    """Keys and fingerprints of stored rows with their deal."""
    return stored.select(*dict.fromkeys([*table.key, *filter(None, [table.hash_column])]), _deal(table, buckets).alias("_deal"))


def _stage_dealt(batch: DataFrame, table: Table, index: str, path: str, buckets: int) -> str:
    """Write the batch once, in buckets by key; returns the table's name. Fingerprints travel as bytes.

    Rows that arrive decided, or with a part of the key missing, have nobody to meet and are dealt by their index.
    """
    key = list(table.key)
    alone = functools.reduce(operator.or_, [F.col(c).isNull() for c in key])
    if "outcome" in batch.columns:
        alone = alone | F.col("outcome").isNotNull()
    dealt = batch.withColumn("_dealt", F.when(alone, F.xxhash64(index)).otherwise(_deal(table, buckets)))
    name = f"batch_{uuid.uuid4().hex}"
    hashing.unpacked(hashing.packed(dealt, table.hash_column).repartition(buckets, "_dealt"), table.hash_column).write.mode(
        "overwrite").option("path", path).option("compression", "zstd").bucketBy(buckets, "_dealt").saveAsTable(name)
    return name


def _placed(rows: DataFrame) -> DataFrame:
    """Rows may share an index; their place in the work folder's files tells them apart, on every reading."""
    placed = rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    # A union and a join keep the layout of a renamed column only.
    return placed.withColumnRenamed("_dealt", "_deal")


def _same_place(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows at the chosen places. Both sides lie in buckets by the deal, so that neither is dealt again."""
    return rows.join(chosen.select("_deal", "_file", "_row"), ["_deal", "_file", "_row"], "left_semi")


def store(spark: SparkSession, batch: DataFrame, table: Table, path: str, index: str,
          created_at: datetime.datetime, work: str | None = None, outcome_path: str | None = None) -> DataFrame:
    """Classify and append; returns index, key, fingerprint, partition, reason, errors and ``outcome`` of every row.

    A row that arrives with an ``outcome`` already (a rejection) passes through. Columns that neither the table nor
    the bookkeeping knows are refused. ``work`` names the delivery's folder: run again with the same one, a step that
    was completed is not repeated, the outcomes stay, and only rows that did not reach the table are appended.

    A row is shuffled once: the batch is staged in buckets by key, as many as there are shuffle partitions. Ruling and
    choosing the new rows read the buckets as they are; of the target, keys and fingerprints are dealt to them.
    """
    folder = work or fresh_dir(spark, f"work-{table.name}")
    try:
        with freed_shuffles(spark):
            return _store(spark, batch, table, path, index, created_at, folder, outcome_path or f"{folder}/outcomes")
    finally:
        if not work:
            discard(spark, f"{folder}/batch")


def _store(spark: SparkSession, batch: DataFrame, table: Table, path: str, index: str, created_at: datetime.datetime, work: str,
           outcome_path: str) -> DataFrame:
    unknown = sorted(set(batch.columns) - set(table.columns) - BOOKKEEPING - {index})
    if unknown:
        raise ValueError(f"Unknown columns for {table.name}: {', '.join(unknown)}.")
    parsed, buckets, names = f"{work}/batch", int(spark.conf.get("spark.sql.shuffle.partitions")), []
    batch, key = schemas.ranged(batch, table), list(table.key)
    known = [c for c in dict.fromkeys([index, *key, *filter(None, [table.hash_column]), *table.partition_by, "reason",
                                       "errors"]) if c in batch.columns]
    if "outcome" in batch.columns:
        batch = _slim(batch, known)
    try:
        if written(spark, parsed):
            dealt = spark.read.parquet(parsed)
        else:
            names.append(_stage_dealt(batch, table, index, parsed, buckets))
            dealt = spark.table(names[0])
        decided = "outcome" in batch.columns
        rows, few = _placed(dealt.where("outcome IS NULL") if decided else dealt), True
        resumed = written(spark, outcome_path)
        if not resumed:
            names.append(f"outcomes_{uuid.uuid4().hex}")
            candidates = rows.select(*known, "_deal", "_file", "_row", _print(table).alias("_print")).withColumn(
                "_order", F.struct(index, "_file", "_row"))
            held, few = _held(stored_for(spark, rows, table, path), table, buckets), dealt.count() <= FEW
            if few:
                held = held.join(F.broadcast(candidates.select(*key).distinct()), key, "left_semi")
            met = hashing.unpacked(hashing.packed(held, table.hash_column).repartition(buckets, "_deal"), table.hash_column)
            done = classify(candidates, met.withColumn("_print", _print(table)), ["_deal", *key], "_print", "_order", False)
            done = done.withColumnRenamed("_deal", "_dealt").select(*known, "outcome", "_dealt", "_file", "_row")
            if decided:
                # Decided rows meet nobody and are never looked for: they pass by, those of a task in one bucket.
                done = done.unionByName(dealt.where("outcome IS NOT NULL").select(
                    *known, "outcome", F.spark_partition_id().cast("bigint").alias("_dealt"),
                    F.lit(None).cast("string").alias("_file"), F.lit(None).cast("bigint").alias("_row")))
            done.write.mode("overwrite").option("path", outcome_path).option("compression", "zstd").bucketBy(
                buckets, "_dealt").saveAsTable(names[-1])
        outcomes = spark.read.parquet(outcome_path)
        ruled = spark.table(names[-1]) if not resumed else outcomes
        chosen = ruled.where(F.col("outcome") == INSERTED).withColumnRenamed("_dealt", "_deal")
        fresh = _same_place(rows, chosen)
        if resumed:
            fresh = fresh.join(stored_for(spark, fresh, table, path).select(*key), key, "left_anti")
        fresh = fresh.select(*[c for c in fresh.columns if c in table.columns])
        if "created_at" in table.columns:
            fresh = fresh.withColumn("created_at", F.lit(created_at))
        with settings(spark, **IN_PLACE):
            # Buckets of many rows that hold few ranges are written as they are; small ones are brought together by range.
            schemas.append(fresh, table, path, few or not table.sliced)
    finally:
        for name in names:  # the files stay
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return outcomes.drop("_dealt", "_file", "_row")


def outcome_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "outcome").agg(F.count(F.lit(1)).alias("rows"))


def payload_identity(payload: Column) -> Column:
    """Identity of a row that brought no hash of its own: its payload's fingerprint."""
    return hashing.sha256(payload)


def stored_transactions(normalized: DataFrame, store_payload: bool = False) -> DataFrame:
    """Normalized filing rows in the stored layout; lean unless the payload is wanted.

    ``filing_period`` is kept when the input has it (an archive's own quarter), else it is the quarter
    of the filing date. A row with neither hash nor payload has no identity and stops the job.
    """
    payload = F.col("raw_payload") if "raw_payload" in normalized.columns else F.lit(None).cast("string")
    record = F.coalesce(
        F.col("record_hash"), payload_identity(payload),
        F.raise_error(F.lit("Transaction record identity cannot be established: both record_hash and raw_payload "
                            "are missing.")).cast("string"))
    filed = dates.lenient_iso_date(F.col("filing_date").cast("string"))
    period = dates.period_of(filed)
    if "filing_period" in normalized.columns:
        period = F.coalesce(F.col("filing_period"), period)
    out = normalized.withColumnsRenamed({
        "reporting_owner_name": "insider_name", "reporting_owner_cik": "insider_cik", "price_per_share": "price"})
    return out.withColumns({
        "raw_payload": payload if store_payload else F.lit(None).cast("string"),
        "record_hash": record,
        "form_type": F.coalesce(F.nullif("form_type", F.lit("")), F.lit("4")),
        "transaction_date": dates.lenient_iso_date(F.col("transaction_date").cast("string")),
        "filing_date": filed,
        "date_of_orig_submission": dates.lenient_iso_date(F.col("date_of_orig_submission").cast("string")),
        "is_amendment": F.coalesce(F.col("is_amendment"), F.lit(False)),
        "filing_period": period,
    })


def single_transactions(normalized: DataFrame, payload: str) -> DataFrame:
    """Rows of the one-by-one path: identity is the payload's fingerprint, never an amendment."""
    return normalized.withColumns({
        "record_hash": payload_identity(F.col(payload)), "raw_payload": F.col(payload),
        "is_amendment": F.lit(False), "acquired_disposed": F.lit(None).cast("string"),
        "date_of_orig_submission": F.lit(None).cast("date"),
        "transaction_date": dates.lenient_iso_date(F.col("transaction_date")),
        "filing_date": dates.lenient_iso_date(F.col("filing_date")),
        "filing_period": dates.period_of(dates.lenient_iso_date(F.col("filing_date"))),
    })


def retained(rows: DataFrame, reference_period: str, retention_years: int = 3) -> DataFrame:
    """The rows that belong in the operational table; the archive keeps everything."""
    reference = dates.normalize_period(F.lit(reference_period))
    return rows.where(dates.within_retention(F.col("filing_period"), reference, retention_years))


def latest(rows: DataFrame, key: list[str], order_by: list[str]) -> DataFrame:
    """Of every key the row that is last in ``order_by``."""
    others = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*others), F.struct(*order_by))
    return rows.groupBy(*key).agg(newest.alias("_row")).select(*key, "_row.*").select(*rows.columns)


def provenance_rows(rows: DataFrame, retrieved_at: datetime.datetime) -> DataFrame:
    """Provenance with its four mandatory texts checked; a blank one stops the job."""
    def needed(name: str) -> Column:
        message = F.lit(f"{name} cannot be empty.")
        return F.when(text.clean(F.col(name)).isNotNull(), F.col(name)).otherwise(
            F.raise_error(message).cast("string"))

    return rows.select(
        *[needed(c).alias(c) for c in ("record_type", "record_id", "source")], "source_reference",
        F.lit(retrieved_at).alias("retrieved_at"), "checksum", needed("validation_status").alias("validation_status"))


def _result(df: DataFrame, key: Column, kind: str, symbol: Column, day: Column, methodology: str,
            payload: Column) -> DataFrame:
    if not methodology.strip():
        raise ValueError("methodology_version cannot be empty.")
    return df.select(
        key.alias("event_key"), F.lit(kind).alias("event_type"), symbol.cast("string").alias("symbol"),
        day.cast("date").alias("event_date"), F.lit(methodology.strip()).alias("methodology_version"),
        F.to_variant_object(payload).alias("result_payload"))


def event_return_results(returns: DataFrame, methodology: str) -> DataFrame:
    fields = ("event_key", "symbol", "event_date", "horizon_days", "event_price", "future_price", "return_pct")
    return _result(returns, F.col("event_key"), "event_return", F.col("symbol"), F.col("event_date"), methodology,
                   F.struct(F.struct(*fields).alias("event_return")))


def study_summary_results(summaries: DataFrame, key: Column, methodology: str) -> DataFrame:
    fields = ("event_count", "horizon_days", "mean_return_pct", "median_return_pct", "positive_event_count",
              "negative_event_count", "zero_return_event_count", "positive_event_rate_pct")
    symbol = F.col("symbol") if "symbol" in summaries.columns else F.lit(None)
    return _result(summaries, key, "event_study_summary", symbol, F.lit(None), methodology, F.struct(*fields))


def outcome_results(outcomes: DataFrame, methodology: str) -> DataFrame:
    fields = ("signal_key", "symbol", "signal_date", "outcome_date", "signal_price", "outcome_price", "return_pct",
              "evaluation_periods")
    key = F.concat_ws(":", F.lit("signal-outcome"), F.col("signal_key"), F.col("evaluation_periods").cast("string"))
    return _result(outcomes, key, "signal_outcome", F.col("symbol"), F.col("signal_date"), methodology,
                   F.struct(*fields))


def backtest_results(run_id: str, trades: DataFrame, summary: DataFrame, methodology: str) -> DataFrame:
    """A run's summary, and one row per trade: a run may hold more trades than fit one JSON value."""
    if not run_id.strip():
        raise ValueError("run_id cannot be empty.")
    run = F.lit(run_id.strip())
    head = _result(summary, F.concat(F.lit("backtest:"), run), "backtest", F.lit(None), F.lit(None), methodology,
                   F.struct(run.alias("run_id"), F.struct("*").alias("summary")))
    rows = _result(trades, F.concat(F.lit("backtest:"), run, F.lit(":"), F.col("signal_key")), "backtest_trade",
                   F.col("symbol"), F.col("entry_date"), methodology, F.struct("*"))
    return head.unionByName(rows)


class CleanupRefused(ValueError):
    """The safety audit does not allow the clean-up."""


def cleanup_provenance(spark: SparkSession, provenance: DataFrame, safety: DataFrame, out_path: str | None,
                       execute: bool = False) -> DataFrame:
    """Counts of what a clean-up of per-transaction provenance removes and keeps.

    Without ``execute`` nothing is written. With it ``safety``, the row of ``audit.provenance_safety``, must say
    that the clean-up is safe; the kept rows, dataset provenance included, go to ``out_path``.
    """
    per_transaction = F.col("record_type") == "insider_transaction"
    counts = provenance.agg(
        F.count_if(per_transaction).alias("removed"), F.count_if(~per_transaction).alias("kept"),
        F.count_if(F.col("record_type") == "dataset_period").alias("protected"))
    if execute:
        if not safety.select("can_cleanup").first()[0]:
            raise CleanupRefused("Safety audit failed: clean-up refused.")
        if not out_path:
            raise ValueError("out_path is required to execute.")
        provenance.where(~per_transaction).write.parquet(out_path)
    return counts.withColumn("executed", F.lit(execute))

"""Counts of what was received, stored, refused and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates

OUTCOMES = ("INSERTED", "DUPLICATE", "REJECTED", "CONFLICT", "FAILED")
UNMAPPED = "UNMAPPED"


def by_symbol(outcomes: DataFrame, requested: DataFrame) -> DataFrame:
    """Records per requested symbol and outcome, and one UNMAPPED row for all others.

    ``outcomes`` has ``symbol`` and ``outcome``; whatever arrives for a symbol that was not requested
    counts as rejected. ``balanced`` states the invariant received = sum of outcomes.
    """
    counted = outcomes.groupBy("symbol", "outcome").agg(F.count(F.lit(1)).alias("_n"))
    wanted = requested.select("symbol").distinct()
    known = counted.join(wanted.withColumn("_known", F.lit(True)), "symbol", "left")
    mapped = F.col("_known").isNotNull()
    routed = known.select(
        F.when(mapped, F.col("symbol")).otherwise(UNMAPPED).alias("symbol"),
        F.when(mapped, F.col("outcome")).otherwise("REJECTED").alias("outcome"), "_n", mapped.alias("requested"))
    silent = wanted.select("symbol", F.lit(None).cast("string").alias("outcome"), F.lit(0).cast("bigint").alias("_n"),
                           F.lit(True).alias("requested"))

    def total(name: str):
        return F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("_n"))), F.lit(0)).alias(name.lower())

    out = routed.unionByName(silent).groupBy("symbol", "requested").agg(
        F.sum("_n").alias("received"), *[total(o) for o in OUTCOMES])
    return out.withColumn("balanced", F.col("received") == sum((F.col(o.lower()) for o in OUTCOMES), F.lit(0)))


def price_status(counts: DataFrame) -> DataFrame:
    """Rejections do not demote a symbol; conflicts, failures and request errors do."""
    troubled = (F.col("failed") > 0) | (F.col("conflict") > 0) | (F.col("provider_failures") > 0)
    return counts.withColumn(
        "status",
        F.when(~F.col("requested"), "FAILED").when((F.col("received") > 0) & ~troubled, "SUCCESS")
        .when((F.col("inserted") > 0) | (F.col("duplicate") > 0), "PARTIAL").otherwise("FAILED"))


def action_status(counts: DataFrame) -> DataFrame:
    """Rejections demote; nothing received and no error is a success."""
    troubled = (F.col("rejected") > 0) | (F.col("failed") > 0) | (F.col("conflict") > 0) | (
        F.col("provider_failures") > 0)
    return counts.withColumn(
        "status",
        F.when(~troubled, "SUCCESS").when((F.col("inserted") > 0) | (F.col("duplicate") > 0), "PARTIAL").otherwise(
            "FAILED"))


def totals(statuses: DataFrame) -> DataFrame:
    """Run totals over symbols."""
    return statuses.agg(
        F.count_if(F.col("requested")).alias("requested_symbols"),
        F.count_if(F.col("requested") & (F.col("status") == "SUCCESS")).alias("successful_symbols"),
        F.count_if(F.col("requested") & (F.col("status") != "SUCCESS")).alias("failed_symbols"),
        F.sum("received").alias("received"), *[F.sum(o.lower()).alias(o.lower()) for o in OUTCOMES],
        F.bool_and("balanced").alias("balanced"))


def quarter_stats(rows: DataFrame) -> DataFrame:
    """Counters per quarter of rows with ``filing_period``, ``errors`` and ``outcome`` (null: not stored)."""
    valid = F.size("errors") == 0
    return rows.groupBy(F.col("filing_period").alias("period")).agg(
        F.count(F.lit(1)).alias("records_parsed"), F.count_if(F.col("outcome") == "INSERTED").alias("records_inserted"),
        F.count_if(F.col("outcome") == "DUPLICATE").alias("duplicates_count"),
        F.count_if(~valid).alias("invalid_count"), F.lit(0).cast("bigint").alias("failures_count"))


def run_totals(stats: DataFrame) -> DataFrame:
    names = ("records_parsed", "records_inserted", "duplicates_count", "invalid_count", "failures_count")
    return stats.agg(F.count(F.lit(1)).alias("periods"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def period_profile(transactions: DataFrame) -> DataFrame:
    """Rows, trade-date range, distinct accessions and hashes per quarter of the filing date."""
    return transactions.where(F.col("filing_date").isNotNull()).groupBy(
        dates.period_of(F.col("filing_date")).alias("period")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.min("transaction_date").alias("earliest_transaction"),
        F.max("transaction_date").alias("latest_transaction"),
        F.countDistinct("accession_number").alias("distinct_accessions"),
        F.countDistinct("record_hash").alias("distinct_hashes"))


def range_rollup(periods: DataFrame, state: DataFrame, provenance: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row about all requested quarters: completed, failed, counters, provenance, trade dates."""
    joined = periods.select("period").join(state, "period", "left")
    done = F.col("status") == "COMPLETED"
    counters = ("records_parsed", "records_inserted", "duplicates_count", "invalid_count")
    head = joined.agg(
        F.count(F.lit(1)).alias("periods_requested"), F.count_if(done).alias("periods_completed"),
        F.count_if(~F.coalesce(done, F.lit(False))).alias("periods_failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters], F.count("status").alias("ingestion_states"))
    datasets = provenance.where((F.col("record_type") == "dataset_period") & (F.col("source") == "SEC")).join(
        periods.select(F.col("period").alias("record_id")), "record_id", "left_semi")
    bounds = periods.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    first = bounds.select(dates.period_first_day(F.col("a")).alias("d")).scalar()
    last = bounds.select(dates.period_last_day(F.col("b")).alias("d")).scalar()
    traded = transactions.where(F.col("filing_date").between(first, last))
    return head.withColumns({
        "provenance_records": datasets.agg(F.count(F.lit(1))).scalar(),
        "earliest_transaction": traded.agg(F.min("transaction_date")).scalar(),
        "latest_transaction": traded.agg(F.max("transaction_date")).scalar(),
    }).withColumn("passed", (F.col("periods_failed") == 0) & (F.col("periods_completed") == F.col("periods_requested")))


def provenance_by_type(provenance: DataFrame) -> DataFrame:
    return provenance.groupBy("record_type").agg(F.count(F.lit(1)).alias("rows"))


def transaction_provenance_by_source(provenance: DataFrame) -> DataFrame:
    return provenance.where(F.col("record_type") == "insider_transaction").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"))


def payload_footprint(transactions: DataFrame, column: str = "raw_payload") -> DataFrame:
    """Rows with and without payload, and its characters in sum and mean."""
    body = F.nullif(F.col(column), F.lit(""))
    return transactions.agg(
        F.count(body).alias("payload_rows"), F.coalesce(F.sum(F.length(body)), F.lit(0)).alias("payload_chars"),
        F.coalesce(F.avg(F.length(body)), F.lit(0.0)).alias("payload_mean_chars"),
        F.count_if(F.col(column).isNull()).alias("null_rows"))


def growth(transactions: DataFrame, state: DataFrame, spans: list[int], bytes_per_row: float) -> DataFrame:
    """Rows per completed quarter and what spans of that many quarters would hold."""
    rows = transactions.agg(F.count(F.lit(1)).alias("rows"))
    quarters = state.where(F.col("status") == "COMPLETED").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    rate = F.col("rows") / F.nullif(quarters, F.lit(0))
    return rows.select(rate.alias("rows_per_quarter"), F.explode(F.array(*[F.lit(s) for s in spans])).alias("quarters")
                       ).withColumn("projected_rows", F.floor(F.col("quarters") * F.col("rows_per_quarter"))).withColumn(
        "projected_bytes", F.col("projected_rows") * F.lit(float(bytes_per_row)))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Rows and file bytes of a stored table, from file metadata."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.max("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("record_count")).where(F.col("record_count") > 1)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table name with its number of rows."""
    counted = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
               for n, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out

"""Data-quality audits. Checks yield ``(check_name, severity, message)`` rows; none means passed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text
from tidemark.operators.accounting import duplicates

# The tables an installation must have.
CORE_TABLES = ("insider_transactions", "market_prices", "corporate_actions", "research_events", "signals",
               "trade_runs", "provenance")

_UNROLL = 1000

PRICE_FIELDS = ("open", "high", "low", "close", "adjusted_close", "volume")


def _issues(df: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), message.alias("message"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def required_tables(spark: SparkSession, present: Iterable[str]) -> DataFrame:
    """Core tables that are not among the present ones."""
    have = list(present)
    names = spark.createDataFrame([(t,) for t in CORE_TABLES], "name string")
    gone = names.where(~F.col("name").isin(have)) if have else names
    return _issues(gone, "required_tables", "critical",
                   F.concat(F.lit("Required table '"), F.col("name"), F.lit("' does not exist.")))


def negative_market_values(prices: DataFrame) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(f) < 0, F.lit(False)) for f in PRICE_FIELDS])
    return _issues(prices.where(bad), "negative_market_values", "error", F.concat(
        F.lit("Market-price record for "), _text("symbol"), F.lit(" on "), _text("price_date"), F.lit(" of "),
        _text("source"), F.lit(" contains a negative numeric value.")))


def duplicate_market_prices(prices: DataFrame) -> DataFrame:
    return _issues(duplicates(prices, ["symbol", "price_date", "source"]), "duplicate_market_prices", "error", F.concat(
        F.lit("Duplicate market-price identity detected: "), _text("symbol"), F.lit(" / "), _text("price_date"),
        F.lit(" / "), _text("source"), F.lit(" ("), _text("record_count"), F.lit(" records).")))


def duplicate_signals(signals: DataFrame) -> DataFrame:
    return _issues(duplicates(signals, ["signal_key"]), "duplicate_signals", "error", F.concat(
        F.lit("Signal key '"), _text("signal_key"), F.lit("' appears "), _text("record_count"), F.lit(" times.")))


def trade_modes(runs: DataFrame) -> DataFrame:
    return _issues(runs.where(~F.col("mode").isin("paper", "live")), "trade_modes", "critical", F.concat(
        F.lit("Trade run '"), _text("run_id"), F.lit("' has invalid mode '"), _text("mode"), F.lit("'.")))


def provenance_status(provenance: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("validation_status", F.lit(""))) == ""
    return _issues(provenance.where(blank), "provenance_status", "error", F.concat(
        F.lit("Provenance record for "), _text("record_type"), F.lit(":"), _text("record_id"),
        F.lit(" has no validation status.")))


def orphans(provenance: DataFrame, record_type: str, records: DataFrame) -> DataFrame:
    """Provenance of one type whose record hash is not stored."""
    known = records.select(F.col("record_hash").alias("record_id")).where(F.col("record_id").isNotNull())
    return provenance.where(F.col("record_type") == record_type).join(known, "record_id", "left_anti")


def orphaned_provenance(provenance: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Orphans of every record type; ``records`` maps the type to its stored table."""
    parts = [orphans(provenance, kind, rows).select("record_type", "record_id") for kind, rows in records.items()]
    gone = reduce(DataFrame.unionByName, parts)
    return _issues(gone, "orphaned_provenance", "error", F.concat(
        F.lit("Provenance record references missing "), F.col("record_type"), F.lit(" record '"), _text("record_id"),
        F.lit("'.")))


def _known(records: dict[str, DataFrame]) -> DataFrame:
    """Distinct (record_type, record_id) of the stored records."""
    parts = [rows.select(F.lit(kind).alias("record_type"), F.col("record_hash").alias("record_id")) for kind, rows in records.items()]
    return reduce(DataFrame.unionByName, parts).where(F.col("record_id").isNotNull()).distinct()


def _issue(when: Column, check: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), message.alias("message")))


def market_price_issues(prices: DataFrame) -> DataFrame:
    """Negative values and repeated identities from one pass, by counts per identity."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(f) < 0, F.lit(False)) for f in PRICE_FIELDS])
    identities = prices.groupBy("symbol", "price_date", "source").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if(bad).alias("bad"))
    symbol, day, source = _text("symbol"), _text("price_date"), _text("source")
    repeated = _issue(F.col("record_count") > 1, "duplicate_market_prices", "error", F.concat(
        F.lit("Duplicate market-price identity detected: "), symbol, F.lit(" / "), day, F.lit(" / "), source, F.lit(" ("),
        _text("record_count"), F.lit(" records).")))
    negative = _issue(F.col("bad") > 0, "negative_market_values", "error", F.concat(
        F.lit("Market-price record for "), symbol, F.lit(" on "), day, F.lit(" of "), source,
        F.lit(" contains a negative numeric value.")))
    # An issue a record: its number is unrolled in two steps, so that no array grows with an identity's records.
    blocks = identities.where((F.col("record_count") > 1) | (F.col("bad") > 0)).withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("bad") - 1, F.lit(0)) / _UNROLL))))
    times = F.least(F.lit(_UNROLL), F.col("bad") - F.col("block") * _UNROLL).cast("int")
    issues = F.concat(F.array(F.when(F.col("block") == 0, repeated)), F.array_repeat(negative, times))
    return blocks.select(F.explode(F.array_compact(issues)).alias("i")).select("i.*")


def provenance_issues(provenance: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Blank statuses and orphans of every record type in ``records`` from one pass over the provenance."""
    stored = _known(records).withColumn("_stored", F.lit(True))
    joined = provenance.select("record_type", "record_id", "validation_status").join(stored, ["record_type", "record_id"], "left")
    issues = F.array(
        _issue(F.trim(F.coalesce("validation_status", F.lit(""))) == "", "provenance_status", "error", F.concat(
            F.lit("Provenance record for "), _text("record_type"), F.lit(":"), _text("record_id"), F.lit(" has no validation status."))),
        _issue(F.col("record_type").isin(*records) & F.col("_stored").isNull(), "orphaned_provenance", "error", F.concat(
            F.lit("Provenance record references missing "), F.col("record_type"), F.lit(" record '"), _text("record_id"), F.lit("'."))))
    return joined.select(F.explode(F.array_compact(issues)).alias("i")).select("i.*")


#: Checks that one pass over a table answers together, in the order of the report.
PASSES = (("required_tables",), ("negative_market_values", "duplicate_market_prices"), ("duplicate_signals",), ("trade_modes",),
          ("provenance_status", "orphaned_provenance"))
STANDARD_CHECKS = tuple(name for names in PASSES for name in names)


def audit_tables(spark: SparkSession, tables: dict[str, DataFrame], selected: Iterable[str] | None = None) -> DataFrame:
    """Issues of the standard checks, or of those chosen by name, with one pass a table; an unknown name is refused.

    ``tables`` has the stored tables by name. Every record type that provenance can be of is checked for orphans.
    """
    names = list(STANDARD_CHECKS) if selected is None else [str(s).strip() for s in selected]
    unknown = [n for n in names if n not in STANDARD_CHECKS]
    if unknown:
        raise ValueError(f"Unsupported integrity check: {unknown[0]}")
    made = dict(zip(PASSES, (
        lambda: required_tables(spark, tables), lambda: market_price_issues(tables["market_prices"]),
        lambda: duplicate_signals(tables["signals"]), lambda: trade_modes(tables["trade_runs"]),
        lambda: provenance_issues(tables["provenance"], {
            "insider_transaction": tables["insider_transactions"], "market_price": tables["market_prices"],
            "corporate_action": tables["corporate_actions"]})), strict=True))
    return reduce(DataFrame.unionByName, [
        make().where(F.col("check_name").isin(*chosen)) for group, make in made.items() if (chosen := [n for n in group if n in names])])


def tables_at(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The stored tables that exist below a folder, by name."""
    found = {}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, table in schemas.TABLES.items():
        path = fs_path(f"{root}/{name}")
        if path.getFileSystem(conf).exists(path):
            found[name] = schemas.read(spark, table, f"{root}/{name}")
    return found


def missing_dataset_provenance(state: DataFrame, provenance: DataFrame) -> DataFrame:
    """Completed quarters without a dataset provenance row."""
    datasets = provenance.where(F.col("record_type") == "dataset_period").select(F.col("record_id").alias("period"))
    return state.where(F.col("status") == "COMPLETED").select("period").join(datasets, "period", "left_anti")


def provenance_safety(provenance: DataFrame, state: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: may per-transaction provenance be removed?"""
    kind = F.col("record_type")
    counts = provenance.agg(
        F.count(F.lit(1)).alias("total_provenance_rows"),
        F.count_if(kind == "insider_transaction").alias("transaction_level_provenance_rows"),
        F.count_if(kind == "dataset_period").alias("dataset_level_provenance_rows"))
    one = F.count(F.lit(1))
    return counts.withColumns({
        "completed_periods_count": state.where(F.col("status") == "COMPLETED").agg(one).scalar(),
        "missing_dataset_provenance_count": missing_dataset_provenance(state, provenance).agg(one).scalar(),
        "orphan_provenance_count": orphans(provenance, "insider_transaction", transactions).agg(one).scalar(),
    }).withColumn("can_cleanup", (F.col("transaction_level_provenance_rows") > 0) & (
        F.col("missing_dataset_provenance_count") == 0))


def verify_hashes(records: DataFrame, actual: Column, expected: str) -> DataFrame:
    """Adds the recomputed hash and whether it equals the expected one; a blank expectation is invalid."""
    wanted = text.clean(F.col(expected))
    return records.withColumn("actual_hash", actual).withColumn(
        "valid", F.coalesce(wanted == F.col("actual_hash"), F.lit(False)))


def verify_periods(periods: DataFrame, profile: DataFrame, provenance: DataFrame, state: DataFrame,
                   missing_fields: DataFrame) -> DataFrame:
    """One row per requested quarter with every assertion of a first import and their conjunction.

    ``missing_fields`` has ``(period, bad_rows)``: rows without accession, CIK, hash or right source.
    """
    dataset = provenance.where((F.col("record_type") == "dataset_period") & (F.col("source") == "SEC")).select(
        F.col("record_id").alias("period"), "source_reference", "checksum", "validation_status",
        F.lit(True).alias("_present"))
    joined = (
        periods.select("period").join(profile, "period", "left").join(dataset, "period", "left")
        .join(state, "period", "left").join(missing_fields, "period", "left")
    )
    file_name = F.concat(F.lower(F.regexp_replace("period", "-", "")), F.lit("_form345.zip"))

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    tests = {
        "has_rows": sure(F.col("rows") > 0), "has_provenance": sure(F.col("_present")),
        "reference_matches": sure(F.contains(F.lower("source_reference"), file_name)),
        "has_checksum": sure(F.col("checksum") != ""), "is_validated": sure(F.col("validation_status") == "validated"),
        "is_completed": sure(F.col("status") == "COMPLETED"), "no_failures": sure(F.col("failures_count") == 0),
        "has_inserts": sure(F.col("records_inserted") > 0), "fields_complete": F.coalesce("bad_rows", F.lit(0)) == 0,
    }
    out = joined.select("period", *[c.alias(n) for n, c in tests.items()])
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(n) for n in tests]))


def multi_owner_rule(transactions: DataFrame, owner_counts: DataFrame) -> DataFrame:
    """PASS, FAIL or NOT TESTABLE per quarter: a filing with several owners must not name one.

    ``owner_counts`` is ``(record_hash, owners)`` from the payload or the archive, one row per hash.
    """
    joined = transactions.join(owner_counts, "record_hash", "left")
    several = F.col("owners") > 1
    named = F.col("insider_name").isNotNull() | F.col("insider_cik").isNotNull()
    return joined.groupBy(F.col("filing_period").alias("period")).agg(
        F.count_if(several).alias("multi_owner_rows"), F.count_if(several & named).alias("violations"),
    ).withColumn("result", F.when(F.col("multi_owner_rows") == 0, "NOT TESTABLE").when(
        F.col("violations") == 0, "PASS").otherwise("FAIL"))


def amendment_preservation(transactions: DataFrame) -> DataFrame:
    """PASS per quarter when some amendment's own accession also has an original row of another hash;
    FAIL when an amendment lacks accession or hash; else NOT TESTABLE."""
    amended = F.col("is_amendment") | F.coalesce(F.col("form_type").endswith("/A"), F.lit(False)) | F.col(
        "date_of_orig_submission").isNotNull()
    marked = transactions.select("filing_period", "accession_number", "record_hash", amended.alias("_a"))
    broken = F.col("_a") & (F.col("accession_number").isNull() | F.col("record_hash").isNull())
    # An original with another hash exists exactly when both kinds are there and not all hashes agree.
    per_filing = marked.groupBy("filing_period", "accession_number").agg(
        F.count_if("_a").alias("amendments"), F.count_if(broken).alias("_broken"),
        F.min(F.when(~F.col("_a"), F.col("record_hash"))).alias("_o_min"),
        F.max(F.when(~F.col("_a"), F.col("record_hash"))).alias("_o_max"),
        F.min(F.when(F.col("_a"), F.col("record_hash"))).alias("_a_min"),
        F.max(F.when(F.col("_a"), F.col("record_hash"))).alias("_a_max"))
    same = (F.col("_o_min") == F.col("_o_max")) & (F.col("_a_min") == F.col("_a_max")) & (
        F.col("_o_min") == F.col("_a_min"))
    proven = F.col("_o_min").isNotNull() & F.col("_a_min").isNotNull() & ~same
    return per_filing.groupBy(F.col("filing_period").alias("period")).agg(
        F.sum("amendments").alias("amendment_rows"), F.sum("_broken").alias("_b"),
        F.count_if(F.coalesce(proven, F.lit(False))).alias("proven_filings"),
    ).withColumn("result", F.when(F.col("_b") > 0, "FAIL").when(F.col("proven_filings") > 0, "PASS").otherwise(
        "NOT TESTABLE")).drop("_b")


def idempotency(first: DataFrame, second: DataFrame) -> DataFrame:
    """Errors of a repeated import, per quarter, from the metrics of both runs.

    Metrics: ``period, records_parsed, records_inserted, duplicates_count, failures_count, status,
    total_rows, period_rows, provenance_rows``.
    """
    counts = ("total_rows", "period_rows", "provenance_rows")
    before = first.select("period", *[F.col(c).alias(f"_{c}") for c in counts])
    joined = second.join(before, "period", "left")
    changed = [
        F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.concat(
            F.lit(f"{c} changed from "), _text(f"_{c}"), F.lit(" to "), _text(c))) for c in counts]
    errors = text.errors(
        F.when(F.col("records_parsed") == 0, F.lit("records_parsed is 0")),
        F.when((F.col("duplicates_count") == 0) & (F.col("records_parsed") > 0), F.lit("duplicates_count is 0")),
        F.when(F.col("records_inserted") > 0, F.lit("records_inserted is above 0")),
        *changed,
        F.when(~F.col("status").eqNullSafe(F.lit("COMPLETED")), F.lit("status is not COMPLETED")),
        F.when(F.col("failures_count") != 0, F.lit("failures_count is above 0")))
    return joined.select("period", errors.alias("errors")).withColumn("passed", F.size("errors") == 0)


def lean_storage(transactions: DataFrame, provenance: DataFrame, period: str) -> DataFrame:
    """One row: payload dropped, identity complete and unique, provenance at dataset level only."""
    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    required = reduce(lambda a, b: a | b, [blank(c) for c in ("accession_number", "issuer_cik", "source", "created_at")])
    # Count per identity first, then sum up: uniqueness costs one shuffle and no second scan.
    per_key = transactions.groupBy("source", "accession_number", "record_hash").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~blank("raw_payload")).alias("_payload"),
        F.count_if(blank("record_hash")).alias("_no_hash"), F.count_if(required).alias("_incomplete"))
    head = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_payload"), F.lit(0)).alias("payload_rows"),
        F.coalesce(F.sum("_no_hash"), F.lit(0)).alias("missing_hash_rows"),
        F.coalesce(F.sum("_incomplete"), F.lit(0)).alias("incomplete_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_identities"))
    of_period = (F.col("record_type") == "dataset_period") & (F.col("record_id") == period) & (F.col("source") == "SEC")
    counts = provenance.agg(F.count_if(of_period).alias("d"),
                            F.count_if(F.col("record_type") == "insider_transaction").alias("t"))
    out = head.withColumns({
        "dataset_provenance_rows": counts.select("d").scalar(),
        "transaction_provenance_rows": counts.select("t").scalar()})
    zero = [F.col(c) == 0 for c in ("payload_rows", "missing_hash_rows", "incomplete_rows", "duplicate_identities",
                                    "transaction_provenance_rows")]
    return out.withColumn("passed", reduce(lambda a, b: a & b, zero, (F.col("rows") > 0) & (
        F.col("dataset_provenance_rows") > 0)))


def after_maintenance(provenance: DataFrame, state: DataFrame) -> DataFrame:
    """Provenance rows by type, and completed quarters."""
    kinds = provenance.groupBy(F.col("record_type").alias("item")).agg(F.count(F.lit(1)).alias("rows"))
    done = state.where(F.col("status") == "COMPLETED").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("completed_periods").alias("item"), "rows")
    return kinds.unionByName(done)

"""The given tables read as filings, prices, companies, provenance and state.

Each view exists twice: as a DataFrame and as the SQL of one common table expression, so that a
registered query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, hashing
from tidemark.functions import text as text_fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their unit price and dates."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("ship_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
    )


LINES = """lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship_date, l_extendedprice / l_quantity AS px
  FROM lineitem)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the head of a filing."""
    status = F.col("o_orderstatus")
    amended = F.col("o_orderpriority") == "5-LOW"
    form = F.when(status == "F", "4").when(status == "O", "3").otherwise("5")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.concat(_pad(F.col("o_custkey"), 10), F.lit("-"), F.date_format(day, "yy"), F.lit("-"),
                 F.col("o_orderkey").cast("string")).alias("accession_number"),
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", day.alias("filing_date"),
        F.concat(form, F.when(amended, "/A").otherwise("")).alias("form_type"),
        amended.alias("is_amendment"),
        F.when(amended, F.date_sub(day, 30)).alias("date_of_orig_submission"),
        dates.period_of(day).alias("filing_period"),
    )


SUBMISSIONS = """submissions AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-'
           || CAST(o_orderkey AS VARCHAR) AS accession_number,
         o_orderkey, o_custkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS filing_date,
         CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN '3' ELSE '5' END
           || CASE WHEN o_orderpriority = '5-LOW' THEN '/A' ELSE '' END AS form_type,
         o_orderpriority = '5-LOW' AS is_amendment,
         CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS DATE) - 30 END AS date_of_orig_submission,
         CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS filing_period
  FROM orders)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: an insider transaction of its order's filing."""
    flag = F.col("l_returnflag")
    key = F.concat_ws(
        "-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.date_format("ship_date", "yyyyMMdd"),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )
    kind = F.when(F.col("l_linestatus") == "F", "non_derivative").otherwise("derivative")
    joined = lines(spark, sf_dir).join(submissions(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.lit("SEC").alias("source"), "accession_number", _pad(F.col("l_suppkey"), 10).alias("issuer_cik"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("ticker"),
        F.concat(F.lit("Customer#"), _pad(F.col("o_custkey"), 9)).alias("insider_name"),
        _pad(F.col("o_custkey"), 10).alias("insider_cik"),
        F.col("ship_date").alias("transaction_date"), "filing_date", "form_type",
        F.when(flag == "A", "P").when(flag == "N", "S").otherwise(flag).alias("transaction_code"),
        F.col("l_quantity").alias("shares"), F.col("px").alias("price"), kind.alias("transaction_type"),
        F.when(F.col("l_linestatus") == "F", "D").otherwise("A").alias("acquired_disposed"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "I").otherwise("D").alias("ownership_type"),
        "is_amendment", "date_of_orig_submission", "filing_period", key.alias("transaction_key"),
        hashing.transaction_identity(
            F.col("accession_number"), kind, key, F.col("form_type"), F.col("is_amendment")).alias("record_hash"),
        "l_tax", "l_discount", "o_orderkey", "o_custkey",
    )


FILINGS = f"""{LINES}, {SUBMISSIONS}, filing_rows AS (
  SELECT 'SEC' AS source, accession_number, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS issuer_cik,
         CASE WHEN l_linenumber <> 7 THEN 'P' || CAST(l_partkey AS VARCHAR) END AS ticker,
         'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS insider_name,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS insider_cik,
         ship_date AS transaction_date, filing_date, form_type,
         CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'S' ELSE l_returnflag END AS transaction_code,
         l_quantity AS shares, px AS price,
         CASE WHEN l_linestatus = 'F' THEN 'non_derivative' ELSE 'derivative' END AS transaction_type,
         CASE WHEN l_linestatus = 'F' THEN 'D' ELSE 'A' END AS acquired_disposed,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'I' ELSE 'D' END AS ownership_type,
         is_amendment, date_of_orig_submission, filing_period,
         concat_ws('-', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   strftime(ship_date, '%Y%m%d'), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS transaction_key,
         l_tax, l_discount, o_orderkey, o_custkey
  FROM lines JOIN submissions ON l_orderkey = o_orderkey),
filings AS (
  SELECT *, sha256(concat_ws('|', accession_number, upper(transaction_type), transaction_key, form_type,
                             CASE WHEN is_amendment THEN '1' ELSE '0' END)) AS record_hash
  FROM filing_rows)"""


def feed_prices(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    """Daily bars: a part is a symbol, a ship date a day; the line status can name the source."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    source = F.concat(F.lit("feed-"), F.lower("l_linestatus")) if by_source else F.lit("EOD")
    bars = lines(spark, sf_dir).groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("ship_date").alias("price_date"), source.alias("source"),
    ).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", at).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return bars.withColumn("adjusted_close", F.when(F.col("volume") >= 25, F.col("close") * 0.98))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_prices(spark, sf_dir)


def _prices_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN volume >= 25 THEN close * 0.98 END AS adjusted_close FROM (
    SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, ship_date AS price_date, {source} AS source,
           arg_min(px, l_orderkey * 8 + l_linenumber) AS open, max(px) AS high, min(px) AS low,
           arg_max(px, l_orderkey * 8 + l_linenumber) AS close, sum(l_quantity) AS volume
    FROM lines GROUP BY ALL))"""


PRICES = _prices_sql("prices", "'EOD'")
FEED_PRICES = _prices_sql("feed_prices", "'feed-' || lower(l_linestatus)")

SERIES = f"""{PRICES}, series AS MATERIALIZED (
  SELECT symbol, price_date, close AS px,
         row_number() OVER (PARTITION BY symbol ORDER BY price_date) AS rn,
         count(*) OVER (PARTITION BY symbol) AS n,
         min(close) OVER (PARTITION BY symbol) AS min_px
  FROM prices), placed AS MATERIALIZED (SELECT symbol || '#' || rn AS place, price_date, px FROM series)"""

# Filings with the ordinal of their entry observation: the first one strictly after the filing date.
ENTRIES = f"""{FILINGS}, {SERIES}, entries AS MATERIALIZED (
  SELECT f.*, s.rn AS entry_rn, s.n, s.min_px, s.price_date AS entry_date, s.px AS entry_px
  FROM filings f ASOF LEFT JOIN series s ON f.ticker = s.symbol AND f.filing_date < s.price_date)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        _pad(F.col("s_suppkey"), 10).alias("cik"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.col("s_name").alias("title"),
    )


COMPANIES = """companies AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, 'P' || CAST(s_suppkey AS VARCHAR) AS ticker,
         s_name AS title
  FROM supplier)"""


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and counters per filing quarter; the quarter's first order decides the status."""
    first = F.min_by("o_orderstatus", "o_orderkey")
    rows = filings(spark, sf_dir).groupBy("filing_period").agg(
        F.count(F.lit(1)).alias("records_parsed"), F.countDistinct("record_hash").alias("records_inserted"),
    )
    heads = submissions(spark, sf_dir).groupBy("filing_period").agg(first.alias("_first"))
    return heads.join(rows, "filing_period").select(
        F.col("filing_period").alias("period"),
        F.when(F.col("_first") == "F", "COMPLETED").when(F.col("_first") == "O", "PARTIAL").otherwise("FAILED").alias(
            "status"),
        "records_parsed", "records_inserted",
        (F.col("records_parsed") - F.col("records_inserted")).alias("duplicates_count"),
        F.lit(0).cast("bigint").alias("invalid_count"),
        F.when(F.col("_first") == "P", F.lit(1)).otherwise(0).cast("bigint").alias("failures_count"),
    )


STATE = """state AS (
  SELECT h.filing_period AS period,
         CASE first_status WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS status,
         records_parsed, records_inserted, records_parsed - records_inserted AS duplicates_count,
         CAST(0 AS BIGINT) AS invalid_count,
         CAST(CASE WHEN first_status = 'P' THEN 1 ELSE 0 END AS BIGINT) AS failures_count
  FROM (SELECT filing_period, arg_min(o_orderstatus, o_orderkey) AS first_status FROM submissions GROUP BY ALL) h
  JOIN (SELECT filing_period, count(*) AS records_parsed, count(DISTINCT record_hash) AS records_inserted
        FROM filings GROUP BY ALL) r ON r.filing_period = h.filing_period)"""


def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters with a complete archive: those whose last order is not pending."""
    return submissions(spark, sf_dir).groupBy(F.col("filing_period").alias("period")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("_last")
    ).where(F.col("_last") != "P").select("period")


ARCHIVES = """archives AS (
  SELECT filing_period AS period FROM submissions GROUP BY ALL
  HAVING arg_max(o_orderstatus, o_orderkey) <> 'P')"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows per archived quarter, and rows for returned lines; the taxed ones are orphans."""
    stamp = F.when(F.col("l_discount") > 0, "validated").otherwise("")
    rows = filings(spark, sf_dir)
    orphan = F.col("l_tax") >= 0.08
    transactions = rows.where(F.col("transaction_code") == "R").select(
        F.lit("insider_transaction").alias("record_type"),
        F.when(orphan, F.sha2(F.col("record_hash"), 256)).otherwise(F.col("record_hash")).alias("record_id"),
        F.concat(F.lit("feed-"), F.lower("acquired_disposed")).alias("source"),
        F.lit(None).cast("string").alias("source_reference"), F.col("record_hash").alias("checksum"),
        stamp.alias("validation_status"),
    )
    datasets = archive_inventory(spark, sf_dir).select(
        F.lit("dataset_period").alias("record_type"), F.col("period").alias("record_id"), F.lit("SEC").alias("source"),
        text_fn.dataset_url(F.col("period")).alias("source_reference"),
        F.sha2(F.col("period"), 256).alias("checksum"), F.lit("validated").alias("validation_status"),
    )
    bars = prices(spark, sf_dir).withColumn("record_hash", hashing.price_hash())
    market = bars.where(F.col("adjusted_close").isNotNull()).select(
        F.lit("market_price").alias("record_type"), F.col("record_hash").alias("record_id"), "source",
        F.lit(None).cast("string").alias("source_reference"), F.col("record_hash").alias("checksum"),
        F.lit("validated").alias("validation_status"),
    )
    return transactions.unionByName(datasets).unionByName(market)


PRICE_HASH = """sha256('{"adjusted_close":' || coalesce(CAST(adjusted_close AS VARCHAR), 'null') || ',"close":'
  || coalesce(CAST(close AS VARCHAR), 'null') || ',"high":' || coalesce(CAST(high AS VARCHAR), 'null') || ',"low":'
  || coalesce(CAST(low AS VARCHAR), 'null') || ',"open":' || coalesce(CAST(open AS VARCHAR), 'null')
  || ',"price_date":"' || CAST(price_date AS VARCHAR) || '","source":"' || source || '","symbol":"' || symbol
  || '","volume":' || coalesce(CAST(volume AS VARCHAR), 'null') || '}')"""

PROVENANCE = f"""provenance AS (
  SELECT 'insider_transaction' AS record_type,
         CASE WHEN l_tax >= 0.08 THEN sha256(record_hash) ELSE record_hash END AS record_id,
         'feed-' || lower(acquired_disposed) AS source, CAST(NULL AS VARCHAR) AS source_reference,
         record_hash AS checksum, CASE WHEN l_discount > 0 THEN 'validated' ELSE '' END AS validation_status
  FROM filings WHERE transaction_code = 'R'
  UNION ALL
  SELECT 'dataset_period', period, 'SEC',
         'https://www.sec.gov/files/structureddata/data/insider-transactions-data-sets/'
           || lower(replace(period, '-', '')) || '_form345.zip',
         sha256(period), 'validated'
  FROM archives
  UNION ALL
  SELECT 'market_price', {PRICE_HASH}, source, NULL, {PRICE_HASH}, 'validated'
  FROM prices WHERE adjusted_close IS NOT NULL)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per order, keyed by customer and quarter, so that keys repeat."""
    return submissions(spark, sf_dir).select(
        F.concat_ws("|", F.col("o_custkey").cast("string"), "filing_period").alias("signal_key"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("filing_date").alias("signal_date"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.lower("o_orderstatus")).alias("signal_type"),
        F.lit("1.0").alias("methodology_version"), F.col("o_orderkey").alias("input_index"),
    )


SIGNALS = """signals AS (
  SELECT CAST(o_custkey AS VARCHAR) || '|' || filing_period AS signal_key, 'C' || CAST(o_custkey AS VARCHAR) AS symbol,
         filing_date AS signal_date, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE lower(o_orderstatus) END AS signal_type,
         '1.0' AS methodology_version, o_orderkey AS input_index
  FROM submissions)"""


def trade_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as trading runs; the market segment gives a mode that may be invalid."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("run_id"),
        F.when(segment == "HOUSEHOLD", "live").when(segment == "MACHINERY", "backfill").otherwise("paper").alias("mode"),
        F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_acctbal") < 5000, "running").otherwise("completed").alias(
            "status"),
        F.make_date(F.lit(2000) + F.col("c_nationkey"), F.lit(1), F.lit(1)).alias("started_at"),
    )


TRADE_RUNS = """trade_runs AS (
  SELECT c_name AS run_id,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'live' WHEN 'MACHINERY' THEN 'backfill' ELSE 'paper' END AS mode,
         CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 5000 THEN 'running' ELSE 'completed' END AS status,
         make_date(CAST(2000 + c_nationkey AS BIGINT), 1, 1) AS started_at
  FROM customer)"""

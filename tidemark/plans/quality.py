"""Registered queries: audits, reconciliation, counts, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import hashing
from tidemark.operators import accounting, audit, filings, reconcile, risk
from tidemark.plans import landing, views
from tidemark.plans.registry import query
from tidemark.plans.study import rounded
from tidemark.session import fresh_dir, stage

ALL = f"{views.FILINGS}, {views.STATE}, {views.ARCHIVES}, {views.PRICES}, {views.PROVENANCE}"


def raw_prices(spark, d):
    """Every line item as a price row: identities repeat, and discounted-away rows are negative."""
    sign = F.when(F.col("l_tax") == 0, -1).otherwise(1)
    return views.lines(spark, d).select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("ship_date").alias("price_date"),
        F.lit("EOD").alias("source"), F.col("px").alias("open"), F.col("px").alias("high"), F.col("px").alias("low"),
        (F.col("px") * sign).alias("close"), F.lit(None).cast("double").alias("adjusted_close"),
        F.col("l_quantity").alias("volume"))


RAW_PRICES = f"""{views.LINES}, raw_prices AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, ship_date AS price_date,
  'EOD' AS source, px * CASE WHEN l_tax = 0 THEN -1 ELSE 1 END AS close FROM lines)"""

NEGATIVE = """SELECT 'negative_market_values' AS check_name, 'error' AS severity, 'Market-price record for ' || symbol
  || ' on ' || CAST(price_date AS VARCHAR) || ' of EOD contains a negative numeric value.' AS message
  FROM raw_prices WHERE close < 0"""
REPEATED = """SELECT 'duplicate_market_prices' AS check_name, 'error' AS severity,
  'Duplicate market-price identity detected: ' || symbol || ' / ' || CAST(price_date AS VARCHAR) || ' / EOD ('
  || count(*) || ' records).' AS message FROM raw_prices GROUP BY symbol, price_date HAVING count(*) > 1"""
SIGNAL_REPEATS = """SELECT 'duplicate_signals' AS check_name, 'error' AS severity, 'Signal key ''' || signal_key
  || ''' appears ' || count(*) || ' times.' AS message FROM signals GROUP BY signal_key HAVING count(*) > 1"""
MODES = """SELECT 'trade_modes' AS check_name, 'critical' AS severity, 'Trade run ''' || run_id
  || ''' has invalid mode ''' || mode || '''.' AS message FROM trade_runs WHERE mode NOT IN ('paper', 'live')"""
STATUS = """SELECT 'provenance_status' AS check_name, 'error' AS severity, 'Provenance record for ' || record_type || ':'
  || record_id || ' has no validation status.' AS message FROM provenance WHERE trim(validation_status) = ''"""
ORPHANS = f"""SELECT 'orphaned_provenance' AS check_name, 'error' AS severity,
  'Provenance record references missing ' || record_type || ' record ''' || record_id || '''.' AS message
  FROM provenance WHERE (record_type = 'insider_transaction' AND record_id NOT IN (SELECT record_hash FROM filings))
    OR (record_type = 'market_price' AND record_id NOT IN (SELECT {views.PRICE_HASH} FROM prices WHERE volume < 40))"""


@query("negative_market_values", "DQ-2", f"WITH {RAW_PRICES} {NEGATIVE}")
def negative_market_values(spark, d):
    return audit.negative_market_values(raw_prices(spark, d))


@query("duplicate_market_prices", "DQ-3 AGG-19", f"WITH {RAW_PRICES} {REPEATED}")
def duplicate_market_prices(spark, d):
    return audit.duplicate_market_prices(raw_prices(spark, d))


@query("duplicate_signals", "DQ-4 AGG-19", f"WITH {views.SUBMISSIONS}, {views.SIGNALS} {SIGNAL_REPEATS}")
def duplicate_signals(spark, d):
    return audit.duplicate_signals(views.signals(spark, d))


@query("invalid_trade_modes", "DQ-5", f"WITH {views.TRADE_RUNS} {MODES}")
def invalid_trade_modes(spark, d):
    return audit.trade_modes(views.trade_runs(spark, d))


@query("blank_provenance_status", "DQ-6", f"WITH {ALL} {STATUS}")
def blank_provenance_status(spark, d):
    return audit.provenance_status(views.provenance(spark, d))


def _stored_prices(spark, d):
    return views.prices(spark, d).where(F.col("volume") < 40).withColumn("record_hash", hashing.price_hash())


@query("orphaned_provenance", "DQ-7 JN-10", f"WITH {ALL} {ORPHANS}")
def orphaned_provenance(spark, d):
    return audit.orphaned_provenance(views.provenance(spark, d), {
        "insider_transaction": views.filings(spark, d), "market_price": _stored_prices(spark, d)})


AUDITED = f"""WITH {ALL}, {RAW_PRICES.replace(views.LINES + ', ', '')}, {views.SIGNALS}, {views.TRADE_RUNS}, mixed AS (
             SELECT record_type, record_id, validation_status FROM provenance WHERE record_type <> 'market_price'
             UNION ALL SELECT 'corporate_action', s_name, 'validated' FROM supplier
             UNION ALL SELECT 'market_price', 'P' || o_custkey || '|' || CAST(filing_date AS VARCHAR), 'validated' FROM submissions),
           orphans AS (
             SELECT record_type, record_id FROM mixed WHERE record_type = 'insider_transaction'
               AND record_id NOT IN (SELECT record_hash FROM filings)
             UNION ALL SELECT record_type, record_id FROM mixed WHERE record_type = 'market_price'
               AND record_id NOT IN (SELECT symbol || '|' || CAST(price_date AS VARCHAR) FROM raw_prices)
             UNION ALL SELECT record_type, record_id FROM mixed WHERE record_type = 'corporate_action'
               AND record_id NOT IN (SELECT s_name FROM supplier WHERE s_acctbal >= 0)),
           audited AS (
             SELECT 'required_tables' AS check_name, 'critical' AS severity,
               'Required table ''research_events'' does not exist.' AS message
             UNION ALL {NEGATIVE} UNION ALL {REPEATED} UNION ALL {SIGNAL_REPEATS} UNION ALL {MODES}
             UNION ALL {STATUS.replace('FROM provenance', 'FROM mixed')}
             UNION ALL SELECT 'orphaned_provenance', 'error', 'Provenance record references missing ' || record_type || ' record '''
               || record_id || '''.' FROM orphans)"""


def _audited_tables(spark, d):
    rows, suppliers, heads = views.filings(spark, d), views.table(spark, d, "supplier"), views.submissions(spark, d)

    def validated(kind, record):
        return [F.lit(kind).alias("record_type"), record.alias("record_id"), F.lit("validated").alias("validation_status")]

    # Provenance of every supplier's action, of which some are stored, and of prices on filing days, of which few are.
    day = F.concat_ws("|", F.concat(F.lit("P"), F.col("o_custkey").cast("string")), F.col("filing_date").cast("string"))
    mixed = views.provenance(spark, d).where("record_type <> 'market_price'").select(
        "record_type", "record_id", "validation_status").unionByName(
        suppliers.select(*validated("corporate_action", F.col("s_name")))).unionByName(heads.select(*validated("market_price", day)))
    prices = raw_prices(spark, d).withColumn("record_hash", F.concat_ws("|", "symbol", F.col("price_date").cast("string")))
    return {"insider_transactions": rows, "market_prices": prices, "signals": views.signals(spark, d), "provenance": mixed,
            "corporate_actions": suppliers.where("s_acctbal >= 0").select(F.col("s_name").alias("record_hash")),
            "trade_runs": views.trade_runs(spark, d)}


@query("integrity_audit", "DQ-8 DQ-1 DQ-2 DQ-3 DQ-4 DQ-5 DQ-6 DQ-7", f"{AUDITED} SELECT * FROM audited")
def integrity_audit(spark, d):
    """All checks, one pass a table, orphans of all three record types."""
    return audit.audit_tables(spark, _audited_tables(spark, d))


@query("chosen_checks", "DQ-8",
       f"{AUDITED} SELECT * FROM audited WHERE check_name IN ('negative_market_values', 'orphaned_provenance')")
def chosen_checks(spark, d):
    return audit.audit_tables(spark, _audited_tables(spark, d), ["orphaned_provenance", " negative_market_values"])


@query("orphan_transactions", "JN-9",
       f"""WITH {ALL} SELECT source, count(*) AS orphans FROM provenance WHERE record_type = 'insider_transaction'
           AND record_id NOT IN (SELECT record_hash FROM filings) GROUP BY ALL""")
def orphan_transactions(spark, d):
    gone = audit.orphans(views.provenance(spark, d), "insider_transaction", views.filings(spark, d))
    return gone.groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))


@query("missing_dataset_provenance", "JN-11",
       f"""WITH {ALL} SELECT period FROM state WHERE status = 'COMPLETED'
           AND period NOT IN (SELECT record_id FROM provenance WHERE record_type = 'dataset_period')""")
def missing_dataset_provenance(spark, d):
    return audit.missing_dataset_provenance(views.state(spark, d), views.provenance(spark, d))


@query("provenance_safety", "DQ-9 SNK-10",
       f"""WITH {ALL}, c AS (SELECT count(*) AS total_provenance_rows,
             count(*) FILTER (record_type = 'insider_transaction') AS transaction_level_provenance_rows,
             count(*) FILTER (record_type = 'dataset_period') AS dataset_level_provenance_rows FROM provenance),
           s AS (SELECT count(*) AS completed_periods_count, count(*) FILTER (period NOT IN (SELECT record_id
             FROM provenance WHERE record_type = 'dataset_period')) AS missing_dataset_provenance_count
             FROM state WHERE status = 'COMPLETED'),
           o AS (SELECT count(*) AS orphan_provenance_count FROM provenance WHERE record_type = 'insider_transaction'
             AND record_id NOT IN (SELECT record_hash FROM filings))
           SELECT c.*, s.*, o.*, transaction_level_provenance_rows > 0 AND missing_dataset_provenance_count = 0
             AS can_cleanup FROM c, s, o""")
def provenance_safety(spark, d):
    return audit.provenance_safety(views.provenance(spark, d), views.state(spark, d), views.filings(spark, d))


@query("provenance_by_type", "AGG-16",
       f"WITH {ALL} SELECT record_type, count(*) AS rows FROM provenance GROUP BY ALL")
def provenance_by_type(spark, d):
    return accounting.provenance_by_type(views.provenance(spark, d))


@query("provenance_by_source", "AGG-16",
       f"""WITH {ALL} SELECT source, count(*) AS rows FROM provenance WHERE record_type = 'insider_transaction'
           GROUP BY ALL""")
def provenance_by_source(spark, d):
    return accounting.transaction_provenance_by_source(views.provenance(spark, d))


@query("after_maintenance", "DQ-16",
       f"""WITH {ALL} SELECT record_type AS item, count(*) AS rows FROM provenance GROUP BY ALL
           UNION ALL SELECT 'completed_periods', count(*) FROM state WHERE status = 'COMPLETED'""")
def after_maintenance(spark, d):
    return audit.after_maintenance(views.provenance(spark, d), views.state(spark, d))


PROFILE = """SELECT filing_period AS period, count(*) AS rows, min(transaction_date) AS earliest_transaction,
  max(transaction_date) AS latest_transaction, count(DISTINCT accession_number) AS distinct_accessions,
  count(DISTINCT record_hash) AS distinct_hashes FROM filings GROUP BY ALL"""


@query("period_profile", "AGG-14", f"WITH {views.FILINGS} {PROFILE}")
def period_profile(spark, d):
    return accounting.period_profile(views.filings(spark, d))


SPINE = """spine AS (SELECT CAST(i // 4 AS VARCHAR) || '-Q' || CAST(i % 4 + 1 AS VARCHAR) AS period
  FROM (SELECT unnest(range(1995 * 4, 2002 * 4 + 1)) AS i))"""


def _spine(spark):
    from tidemark.operators import access

    return access.quarters(spark, "1995-Q1", "2002-Q1")


@query("range_rollup", "AGG-15",
       f"""WITH {ALL}, {SPINE}, j AS (SELECT p.period AS asked, s.* FROM spine p LEFT JOIN state s ON s.period = p.period)
       SELECT count(*) AS periods_requested, count(*) FILTER (status = 'COMPLETED') AS periods_completed,
         count(*) FILTER (coalesce(status, '') <> 'COMPLETED') AS periods_failed,
         CAST(sum(records_parsed) AS BIGINT) AS records_parsed, CAST(sum(records_inserted) AS BIGINT) AS records_inserted,
         CAST(sum(duplicates_count) AS BIGINT) AS duplicates_count, CAST(sum(invalid_count) AS BIGINT) AS invalid_count,
         count(status) AS ingestion_states, (SELECT count(*) FROM provenance WHERE record_type = 'dataset_period'
           AND record_id IN (SELECT period FROM spine)) AS provenance_records,
         (SELECT min(transaction_date) FROM filings) AS earliest_transaction,
         (SELECT max(transaction_date) FROM filings) AS latest_transaction, false AS passed FROM j""")
def range_rollup(spark, d):
    return accounting.range_rollup(_spine(spark), views.state(spark, d), views.provenance(spark, d),
                                   views.filings(spark, d))


@query("period_verification", "DQ-11",
       f"""WITH {ALL}, {SPINE}, profile AS ({PROFILE}), j AS (
         SELECT p.period, coalesce(f.rows > 0, false) AS has_rows, v.record_id IS NOT NULL AS has_provenance,
           coalesce(contains(v.source_reference, lower(replace(p.period, '-', '')) || '_form345.zip'), false)
             AS reference_matches, coalesce(v.checksum <> '', false) AS has_checksum,
           coalesce(v.validation_status = 'validated', false) AS is_validated,
           coalesce(s.status = 'COMPLETED', false) AS is_completed, coalesce(s.failures_count = 0, false) AS no_failures,
           coalesce(s.records_inserted > 0, false) AS has_inserts, true AS fields_complete
         FROM spine p LEFT JOIN profile f ON f.period = p.period
         LEFT JOIN provenance v ON v.record_type = 'dataset_period' AND v.record_id = p.period
         LEFT JOIN state s ON s.period = p.period)
       SELECT *, has_rows AND has_provenance AND reference_matches AND has_checksum AND is_validated AND is_completed
         AND no_failures AND has_inserts AS passed FROM j""")
def period_verification(spark, d):
    rows = views.filings(spark, d)
    bad = rows.where((F.col("accession_number") == "") | F.col("issuer_cik").isNull() | F.col("record_hash").isNull() | (
        F.col("source") != "SEC")).groupBy(F.col("filing_period").alias("period")).agg(F.count(F.lit(1)).alias("bad_rows"))
    return audit.verify_periods(_spine(spark), accounting.period_profile(rows), views.provenance(spark, d),
                                views.state(spark, d), bad)


@query("multi_owner_rule", "DQ-12 JN-12",
       f"""WITH {views.FILINGS}, marked AS (SELECT filing_period AS period, l_tax >= 0.05 AS several,
             l_tax < 0.08 AND (l_tax < 0.05 OR filing_period >= '1998-Q1') AS named FROM filings),
       c AS (SELECT period, count(*) FILTER (several) AS multi_owner_rows,
             count(*) FILTER (several AND named) AS violations FROM marked GROUP BY ALL)
       SELECT *, CASE WHEN multi_owner_rows = 0 THEN 'NOT TESTABLE' WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END
         AS result FROM c""")
def multi_owner_rule(spark, d):
    rows = views.filings(spark, d)
    named = (F.col("l_tax") < 0.08) & ((F.col("l_tax") < 0.05) | (F.col("filing_period") >= "1998-Q1"))
    stored = rows.withColumns({c: F.when(named, F.col(c)) for c in ("insider_name", "insider_cik")})
    owners = rows.select("record_hash", F.when(F.col("l_tax") >= 0.05, 2).otherwise(1).alias("owners")).groupBy(
        "record_hash").agg(F.max("owners").alias("owners"))
    return audit.multi_owner_rule(stored, owners)


@query("amendment_preservation", "DQ-13",
       f"""WITH {views.FILINGS}, x AS (SELECT filing_period AS period, accession_number, record_hash,
             is_amendment AND transaction_code <> 'R' AS a FROM filings),
       p AS (SELECT DISTINCT m.period, m.accession_number FROM x m JOIN x o ON o.accession_number = m.accession_number
             AND m.a AND NOT o.a AND m.record_hash <> o.record_hash),
       n AS (SELECT period, count(*) FILTER (a) AS amendment_rows FROM x GROUP BY ALL)
       SELECT n.period, n.amendment_rows, count(p.period) AS proven_filings,
         CASE WHEN count(p.period) > 0 THEN 'PASS' ELSE 'NOT TESTABLE' END AS result
       FROM n LEFT JOIN p ON p.period = n.period GROUP BY ALL""")
def amendment_preservation(spark, d):
    amended = F.col("is_amendment") & (F.col("transaction_code") != "R")
    rows = views.filings(spark, d).select(
        "filing_period", "accession_number", "record_hash", amended.alias("is_amendment"),
        F.when(amended, F.col("form_type")).otherwise("4").alias("form_type"),
        F.when(amended, F.col("date_of_orig_submission")).alias("date_of_orig_submission"))
    return audit.amendment_preservation(rows)


@query("idempotency", "DQ-14 AGG-13 SNK-1",
       f"""WITH {views.FILINGS}, v AS (SELECT filing_period AS period, record_hash, filing_period >= '1999-Q1'
             AND transaction_date - filing_date <= 365 AND transaction_code <> 'R' AS good,
             filing_period <> '2000-Q3' OR o_orderkey % 2 = 0 AS first_run FROM filings),
           c AS (SELECT period, count(*) FILTER (good) AS good, count(DISTINCT record_hash) FILTER (good AND first_run) AS before,
             count(DISTINCT record_hash) FILTER (good) AS after FROM v GROUP BY period)
           SELECT period, concat_ws('; ', CASE WHEN good - (after - before) = 0 THEN 'duplicates_count is 0' END,
             CASE WHEN after > before THEN 'records_inserted is above 0' END,
             CASE WHEN after > before THEN 'period_rows changed from ' || before || ' to ' || after END,
             CASE WHEN after > before THEN 'provenance_rows changed from ' || before || ' to ' || after END) AS errors,
             after = before AND good > 0 AS passed FROM c""")
def idempotency(spark, d):
    """Two imports into one table, the second with rows that the first had not seen in one quarter."""
    path, landed, runs = fresh_dir(spark, "insider_transactions"), landing.sections(spark, d), []
    order = F.substring_index(F.element_at("cells", "ACCESSION_NUMBER"), "-", -1).cast("bigint")
    for seen in (landed.where((F.col("filing_period") != "2000-Q3") | (order % 2 == 0)), landed):
        done = filings.load_quarters(spark, seen, path, landing.STAMP, "2001-Q4", 3)
        stored = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, path).groupBy(F.col("filing_period").alias("period")).agg(
            F.count(F.lit(1)).alias("period_rows"), F.countDistinct("record_hash").alias("provenance_rows"))
        runs.append(stage(accounting.quarter_stats(done).join(stored, "period", "left").withColumns({
            "status": F.lit("COMPLETED"), "total_rows": F.lit(None).cast("bigint")}), "run-metrics"))
    return audit.idempotency(*runs).withColumn("errors", F.array_join("errors", "; "))


@query("lean_storage", "DQ-15 AGG-19",
       f"""WITH {ALL} SELECT CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (l_tax = 0) AS payload_rows,
             CAST(0 AS BIGINT) AS missing_hash_rows, CAST(0 AS BIGINT) AS incomplete_rows,
             (SELECT count(*) FROM (SELECT 1 FROM filings GROUP BY accession_number, record_hash HAVING count(*) > 1))
               AS duplicate_identities,
             (SELECT count(*) FROM provenance WHERE record_type = 'dataset_period' AND record_id = '1998-Q1')
               AS dataset_provenance_rows,
             (SELECT count(*) FROM provenance WHERE record_type = 'insider_transaction') AS transaction_provenance_rows,
             false AS passed FROM filings""")
def lean_storage(spark, d):
    rows = views.filings(spark, d).withColumns({
        "raw_payload": F.when(F.col("l_tax") == 0, F.lit("{}")), "created_at": F.col("filing_date")})
    return audit.lean_storage(rows, views.provenance(spark, d), "1998-Q1")


@query("payload_footprint", "AGG-17",
       """SELECT count(nullif(text, '')) AS payload_rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS payload_chars,
            round(avg(length(nullif(text, ''))), 6) AS payload_mean_chars, count(*) - count(text) AS null_rows
          FROM documents""")
def payload_footprint(spark, d):
    return rounded(accounting.payload_footprint(views.table(spark, d, "documents"), "text"), "payload_mean_chars")


@query("storage_growth", "AGG-18",
       f"""WITH {views.FILINGS}, {views.STATE}, r AS (SELECT count(*) / (SELECT count(*) FROM state
             WHERE status = 'COMPLETED') AS rows_per_quarter FROM filings), s AS (SELECT unnest([20, 60, 82]) AS quarters)
           SELECT round(rows_per_quarter, 6) AS rows_per_quarter, quarters,
             CAST(floor(quarters * rows_per_quarter) AS BIGINT) AS projected_rows,
             floor(quarters * rows_per_quarter) * 2630.0 AS projected_bytes FROM r, s""")
def storage_growth(spark, d):
    out = accounting.growth(views.filings(spark, d), views.state(spark, d), [20, 60, 82], 2630.0)
    return rounded(out, "rows_per_quarter")


@query("table_row_counts", "AGG-22",
       f"""WITH {ALL}, {views.SIGNALS} SELECT 'insider_transactions' AS table_name, count(*) AS rows FROM filings
           UNION ALL SELECT 'signals', count(*) FROM signals UNION ALL SELECT 'provenance', count(*) FROM provenance""")
def table_row_counts(spark, d):
    return accounting.row_counts({"insider_transactions": views.filings(spark, d), "signals": views.signals(spark, d),
                                  "provenance": views.provenance(spark, d)})


IDS = f"""{views.LINES}, ids AS (
  SELECT coalesce(e.id, a.id) AS record_id, coalesce(e.n, 0) AS expected_count, coalesce(a.n, 0) AS accepted_count
  FROM (SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lines WHERE l_returnflag <> 'R' GROUP BY ALL) e
  FULL JOIN (SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lines WHERE l_linestatus = 'O'
             GROUP BY ALL) a ON a.id = e.id)"""


def _ids(spark, d):
    rows = views.lines(spark, d).withColumn("record_id", F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return reconcile.reconcile_ids(rows.where(F.col("l_returnflag") != "R"), rows.where(F.col("l_linestatus") == "O"))


@query("reconciled_ids", "SET-1 JN-13",
       f"""WITH {IDS} SELECT record_id, CAST(expected_count AS BIGINT) AS expected_count,
             CAST(accepted_count AS BIGINT) AS accepted_count, CASE WHEN accepted_count = 0 THEN 'MISSING'
               WHEN expected_count = 0 THEN 'UNEXPECTED' ELSE 'MATCHED' END AS status,
             accepted_count > 1 AS is_duplicate FROM ids""")
def reconciled_ids(spark, d):
    return _ids(spark, d)


@query("reconciliation_summary", "SET-1",
       f"""WITH {IDS} SELECT CAST(sum(expected_count) AS BIGINT) AS expected_count,
             CAST(sum(accepted_count) AS BIGINT) AS accepted_count,
             count(*) FILTER (accepted_count > 0 AND expected_count > 0) AS matched_count,
             count(*) FILTER (accepted_count = 0) AS missing_count, count(*) FILTER (expected_count = 0) AS unexpected_count,
             count(*) FILTER (accepted_count > 1) AS duplicate_count, CAST(0 AS BIGINT) AS blank_count, false AS complete
           FROM ids""")
def reconciliation_summary(spark, d):
    return reconcile.reconciliation_summary(_ids(spark, d))


def _positions(spark, d):
    """Open lines as positions: several rows may share a symbol."""
    return views.lines(spark, d).where(F.col("l_linestatus") == "O").select(
        F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_quantity").alias("quantity"),
        F.col("px").alias("reference_price"))


@query("total_exposure", "AGG-20",
       f"""WITH {views.LINES} SELECT round(sum(l_quantity * px), 2) AS total_exposure, count(*) AS open_positions
           FROM lines WHERE l_linestatus = 'O'""")
def total_exposure(spark, d):
    return rounded(risk.exposure(_positions(spark, d)), "total_exposure", places=2)


@query("order_risk", "RK-1 JN-14",
       f"""WITH {views.LINES}, held AS (SELECT l_partkey, sum(l_quantity * px) AS v FROM lines WHERE l_linestatus = 'O'
             GROUP BY ALL), t AS (SELECT sum(l_quantity * px) AS total, count(*) AS n FROM lines WHERE l_linestatus = 'O'),
       o AS (SELECT l_orderkey, l_linenumber, l_partkey, ship_date, l_quantity * px AS value FROM lines
             WHERE l_linestatus = 'F'),
       j AS (SELECT o.*, coalesce(held.v, 0) AS v, total, n + CASE WHEN held.v IS NULL THEN 1 ELSE 0 END AS opens
             FROM o LEFT JOIN held ON held.l_partkey = o.l_partkey, t)
       SELECT l_orderkey, l_linenumber, 'P' || CAST(l_partkey AS VARCHAR) AS symbol, ship_date,
         round(value, 2) AS order_value, concat_ws('; ',
           CASE WHEN value > 50000 THEN 'Order value exceeds the maximum order-value limit.' END,
           CASE WHEN v + value > 600000 THEN 'Projected position value exceeds the maximum position-value limit.' END,
           CASE WHEN total + value > 1e12 THEN 'Projected total exposure exceeds the maximum total-exposure limit.' END,
           CASE WHEN opens > 1000000000 THEN 'Projected open-position count exceeds the configured limit.' END) AS reasons,
         value <= 50000 AND v + value <= 600000 AND total + value <= 1e12 AND opens <= 1000000000 AS approved FROM j""")
def order_risk(spark, d):
    orders = views.lines(spark, d).where(F.col("l_linestatus") == "F").select(
        "l_orderkey", "l_linenumber", "ship_date", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_quantity").alias("quantity"), F.col("px").alias("reference_price"))
    out = risk.check_orders(orders, _positions(spark, d), risk.Limits(600_000, 1e12, 50_000, 1_000_000_000))
    return rounded(out.select("l_orderkey", "l_linenumber", "symbol", "ship_date", "order_value",
                              F.array_join("reasons", "; ").alias("reasons"), "approved"), "order_value", places=2)

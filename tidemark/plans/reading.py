"""Registered queries: filters, order, tiers, coverage, lookups, stored results."""

from __future__ import annotations

import re

import datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates
from tidemark.operators import access, asof, loads, research, sinks
from tidemark.plans import study, views
from tidemark.plans.registry import query
from tidemark.plans.study import rounded
from tidemark.session import freed_shuffles, fresh_dir, settings, stage

STAMP = datetime.datetime(2002, 1, 2)

ID = ["accession_number", "transaction_key"]

FILTER = dict(start_date="1996-01-01", end_date="2000-12-31", filing_start_date="1996-01-01",
              filing_end_date="2000-06-30", transaction_codes=["p", "S"], acquired_disposed=" d ", ownership_types="D",
              source="SEC")
FILTER_SQL = """transaction_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND filing_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30' AND transaction_code IN ('P', 'S')
  AND acquired_disposed = 'D' AND ownership_type = 'D' AND source = 'SEC'"""


@query("transaction_filter", "FLT-1 ORD-1 SRC-17",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key, transaction_date, filing_date, shares
           FROM filings WHERE {FILTER_SQL}""")
def transaction_filter(spark, d):
    return access.query_transactions(views.filings(spark, d), **FILTER).select(
        *ID, "transaction_date", "filing_date", "shares")


@query("transaction_filter_by_name", "FLT-1 FLT-3",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key, ticker, issuer_cik FROM filings
           WHERE ticker IN ('P10', 'P11', 'P12') OR issuer_cik = '0000000007'""")
def transaction_filter_by_name(spark, d):
    rows = views.filings(spark, d)
    by_ticker = access.query_transactions(rows, tickers=["p10", "P11", "p12"], ordered=False)
    by_cik = access.query_transactions(rows, issuer_ciks="7", ordered=False).where(
        ~F.coalesce(F.col("ticker").isin("P10", "P11", "P12"), F.lit(False)))
    return by_ticker.unionByName(by_cik).select(*ID, "ticker", "issuer_cik")


@query("oldest_transactions", "ORD-1",
       f"""WITH {views.FILINGS}, ranked AS (SELECT transaction_date, filing_date FROM filings
             ORDER BY transaction_date NULLS FIRST, filing_date NULLS FIRST LIMIT 50)
           SELECT transaction_date, filing_date, count(*) AS rows FROM ranked GROUP BY ALL""")
def oldest_transactions(spark, d):
    first = access.query_transactions(views.filings(spark, d), limit=50)
    return first.groupBy("transaction_date", "filing_date").agg(F.count(F.lit(1)).alias("rows"))


@query("raw_price_range", "FLT-2",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol, price_date, source, close AS px FROM prices
           WHERE price_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def raw_price_range(spark, d):
    return access.price_range(views.prices(spark, d), start_date="1997-01-01", end_date="1999-12-31")


@query("adjusted_price_range", "FLT-2",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol, price_date, source, adjusted_close AS px FROM prices
           WHERE adjusted_close IS NOT NULL""")
def adjusted_price_range(spark, d):
    return access.price_range(views.prices(spark, d), adjusted=True)


@query("quarter_spine", "SRC-2 AGG-13",
       f"""WITH {views.LINES}, {views.SUBMISSIONS}, b AS (SELECT min(year(filing_date) * 4 + quarter(filing_date) - 1) AS a,
             max(year(filing_date) * 4 + quarter(filing_date) - 1) AS z FROM submissions),
           spine AS (SELECT unnest(range(a, z + 3)) AS i FROM b), named AS (
             SELECT i // 4 AS year, i % 4 + 1 AS quarter,
                    CAST(i // 4 AS VARCHAR) || '-Q' || CAST(i % 4 + 1 AS VARCHAR) AS period FROM spine)
           SELECT n.year, n.quarter, n.period, count(s.o_orderkey) AS filings
           FROM named n LEFT JOIN submissions s ON s.filing_period = n.period GROUP BY ALL""")
def quarter_spine(spark, d):
    heads = views.submissions(spark, d)
    index = dates.period_index(F.col("filing_period"))
    spine = access.quarters_between(heads.agg(F.min(index).alias("a"), (F.max(index) + 2).alias("b")))
    filed = heads.groupBy(F.col("filing_period").alias("period")).agg(F.count(F.lit(1)).alias("filings"))
    return spine.join(filed, "period", "left").withColumn("filings", F.coalesce("filings", F.lit(0)))


TIERS = f"""{views.FILINGS}, {views.STATE}, {views.ARCHIVES}, spine AS (
  SELECT CAST(i // 4 AS VARCHAR) || '-Q' || CAST(i % 4 + 1 AS VARCHAR) AS period, i
  FROM (SELECT unnest(range(1995 * 4, 2002 * 4 + 1)) AS i)),
tiers AS (SELECT p.period, CASE WHEN s.period IS NOT NULL AND 2001 * 4 + 1 - i BETWEEN 0 AND 19 THEN 'HOT'
    WHEN a.period IS NOT NULL THEN 'ARCHIVE' ELSE 'MISSING' END AS tier
  FROM spine p LEFT JOIN state s ON s.period = p.period AND s.status = 'COMPLETED'
  LEFT JOIN archives a ON a.period = p.period)"""


def _tiers(spark, d):
    return access.resolve_tiers(access.quarters(spark, "1995Q1", "2002-Q1"), views.state(spark, d),
                                views.archive_inventory(spark, d), "2001-Q2", 5)


@query("storage_tiers", "OP-10 SC-13", f"WITH {TIERS} SELECT period, tier FROM tiers")
def storage_tiers(spark, d):
    return _tiers(spark, d).select("period", "tier")


@query("missing_quarters", "SET-5", f"WITH {TIERS} SELECT period FROM tiers WHERE tier = 'MISSING'")
def missing_quarters(spark, d):
    return access.missing_periods(_tiers(spark, d))


@query("historical_read", "OP-11 SET-2 FLT-3 ORD-2",
       f"""WITH {TIERS} SELECT f.accession_number, f.transaction_key, f.transaction_date, f.filing_date, t.tier AS read_from
           FROM filings f JOIN tiers t ON t.period = f.filing_period
           WHERE t.tier <> 'MISSING' AND f.transaction_code = 'P' AND f.acquired_disposed = 'A'""")
def historical_read(spark, d):
    """Both tiers hold all quarters; every row names the tier it was read from."""
    hot, archived = (views.filings(spark, d).withColumn("read_from", F.lit(tier)) for tier in (access.HOT, access.ARCHIVE))
    out = access.historical_transactions(hot, archived, _tiers(spark, d), strict=False, transaction_codes="P",
                                         acquired_disposed="A")
    return out.select(*ID, "transaction_date", "filing_date", "read_from")


@query("historical_read_refused", "OP-11 SET-5",
       f"""WITH {TIERS} SELECT 'all quarters' AS asked, 'Requested period(s) missing from every tier: '
             || string_agg(period, ', ' ORDER BY period) || '.' AS refusal, CAST(NULL AS BIGINT) AS rows
           FROM tiers WHERE tier = 'MISSING'
           UNION ALL SELECT 'known quarters', NULL, count(*) FROM filings f JOIN tiers t ON t.period = f.filing_period
           WHERE t.tier <> 'MISSING'""")
def historical_read_refused(spark, d):
    """A strict read fails while a quarter is in no tier, before it gives a row; without that quarter it succeeds."""
    rows, tiers, found = views.filings(spark, d), _tiers(spark, d), []
    for asked, wanted in (("all quarters", tiers), ("known quarters", tiers.where(F.col("tier") != access.MISSING))):
        try:
            found.append((asked, None, access.historical_transactions(rows, rows, wanted).count()))
        except Exception as exc:  # both tiers may refuse at the same time, which wraps the error
            found.append((asked, re.search(r"Requested period\(s\) missing[^.]*\.", str(exc))[0], None))
    return spark.createDataFrame(found, "asked string, refusal string, rows bigint")


@query("historical_read_strict", "OP-11 ORD-2",
       f"""WITH {TIERS}, kept AS (SELECT f.* FROM filings f JOIN tiers t ON t.period = f.filing_period
             WHERE t.tier <> 'MISSING'
             ORDER BY transaction_date NULLS FIRST, f.filing_date NULLS FIRST, accession_number LIMIT 1000)
           SELECT accession_number, transaction_date, filing_date, count(*) AS rows FROM kept GROUP BY ALL""")
def historical_read_strict(spark, d):
    rows = views.filings(spark, d)
    tiers = _tiers(spark, d).where(F.col("tier") != access.MISSING)
    out = access.historical_transactions(rows, rows, tiers, limit=1000)
    return out.groupBy("accession_number", "transaction_date", "filing_date").agg(F.count(F.lit(1)).alias("rows"))


COVERAGE = """WITH {lines}, {prices}, asked AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol FROM part
    UNION SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier),
  found AS (SELECT symbol, min(price_date) AS first_day, max(price_date) AS last_day, count(adjusted_close) AS n,
      count(*) - count(adjusted_close) AS gaps, count(adjusted_close) FILTER (price_date > DATE '1996-01-01') AS future
    FROM prices WHERE price_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY ALL),
  joined AS (SELECT a.symbol, first_day, last_day, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps,
      coalesce(future, 0) AS future, coalesce(first_day > DATE '1996-01-01', true) AS b,
      coalesce(last_day < DATE '2001-06-30', true) AS e FROM asked a LEFT JOIN found f ON f.symbol = a.symbol)
  SELECT symbol, first_day AS first_available_date, last_day AS last_available_date, n AS observation_count,
    gaps AS missing_requested_price_field_count, b AS starts_before_available, e AS ends_after_available,
    b OR e OR gaps > 0 AS missing_requested_range,
    first_day IS NOT NULL AND NOT b AND NOT e AND n > 0 AS is_range_covered_boundary_level,
    first_day IS NOT NULL AND future >= 10 AS has_sufficient_future_observations FROM joined"""


@query("price_coverage", "AGG-9", COVERAGE.format(lines=views.LINES, prices=views.PRICES))
def price_coverage(spark, d):
    parts = views.table(spark, d, "part").select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("symbol"))
    others = views.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return access.coverage(parts.unionByName(others), views.prices(spark, d), start_date="1996-01-01",
                           end_date="2001-06-30", required_observations=10, adjusted=True)


def _spaced(spark, d):
    """Filings whose tickers are lower case, padded or white space."""
    t = F.col("ticker")
    messy = F.when(t.isNull(), F.lit("  ")).when(
        F.col("acquired_disposed") == "A", F.concat(F.lit(" "), F.lower(t))).otherwise(t)
    return views.filings(spark, d).withColumn("ticker", messy)


@query("ticker_universe", "AGG-8 FLT-4",
       f"""WITH {views.FILINGS} SELECT DISTINCT ticker FROM filings WHERE ticker IS NOT NULL
           AND (filing_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'
             OR transaction_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30')""")
def ticker_universe(spark, d):
    return access.ticker_universe(_spaced(spark, d), "1998-01-01", "1998-06-30")


@query("universe_source_count", "AGG-8",
       f"""WITH {views.FILINGS} SELECT count(*) AS source_transaction_count, count(DISTINCT ticker) AS unique_ticker_count
           FROM filings""")
def universe_source_count(spark, d):
    rows = _spaced(spark, d)
    tickers = access.ticker_universe(rows).agg(F.count(F.lit(1)))
    return access.universe_rows(rows).agg(F.count(F.lit(1)).alias("source_transaction_count")).withColumn(
        "unique_ticker_count", tickers.scalar())


@query("universe_prefix", "ORD-4",
       f"""WITH {views.FILINGS} SELECT DISTINCT ticker FROM filings WHERE ticker IS NOT NULL
           ORDER BY ticker LIMIT 25""")
def universe_prefix(spark, d):
    return access.first_symbols(access.ticker_universe(_spaced(spark, d)), 25)


@query("newest_signals", "ORD-3 FLT-6",
       f"""WITH {views.SUBMISSIONS}, {views.SIGNALS} SELECT signal_key, signal_date, input_index FROM signals
           WHERE signal_type = 'f' ORDER BY signal_date DESC, input_index LIMIT 100""")
def newest_signals(spark, d):
    return access.newest(views.signals(spark, d), ["signal_date"], "input_index", signal_type="f").select(
        "signal_key", "signal_date", "input_index")


SYMBOL = "C7"


@query("signals_of_symbol", "FLT-6",
       f"""WITH {views.SUBMISSIONS}, {views.SIGNALS} SELECT signal_key, symbol, signal_type, signal_date, input_index FROM signals
           WHERE symbol = '{SYMBOL}' ORDER BY signal_date DESC, input_index LIMIT 100""")
def signals_of_symbol(spark, d):
    return access.newest(views.signals(spark, d), ["signal_date"], "input_index", symbol=SYMBOL).select(
        "signal_key", "symbol", "signal_type", "signal_date", "input_index")


@query("trade_runs_by_mode", "FLT-8 ORD-3",
       f"""WITH {views.TRADE_RUNS} SELECT run_id, mode, status, started_at FROM trade_runs
           WHERE mode = 'live' AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 100""")
def trade_runs_by_mode(spark, d):
    runs = access.trade_runs(views.trade_runs(spark, d), mode=" Live", status="completed")
    return access.newest(runs, ["started_at"], "run_id")


@query("companies_of_filings", "JN-8 SRC-12",
       f"""WITH {views.FILINGS}, {views.COMPANIES} SELECT f.accession_number, f.transaction_key, c.title AS by_cik,
             t.title AS by_ticker FROM filings f LEFT JOIN companies c ON c.cik = f.issuer_cik
           LEFT JOIN companies t ON t.ticker = f.ticker""")
def companies_of_filings(spark, d):
    known = views.companies(spark, d)
    by_cik = access.companies_by(views.filings(spark, d).select(*ID, "ticker", F.col("issuer_cik").alias("cik")), known,
                                 "cik").select(*ID, "ticker", F.col("company_title").alias("by_cik"))
    return access.companies_by(by_cik, known, "ticker").select(*ID, "by_cik", F.col("company_title").alias("by_ticker"))


@query("pending_quarters", "FLT-9 SET-4",
       f"""WITH {TIERS} SELECT period FROM spine WHERE period NOT IN (SELECT period FROM state WHERE status = 'COMPLETED')""")
def pending_quarters(spark, d):
    return access.pending_periods(access.quarters(spark, "1995-Q1", "2002-Q1"), views.state(spark, d)).select("period")


@query("latest_quarter", "AGG-21",
       f"""WITH {TIERS} SELECT max(period) AS period FROM (
             SELECT period FROM state WHERE status = 'COMPLETED' UNION ALL SELECT period FROM archives)""")
def latest_quarter(spark, d):
    return access.latest_period(views.state(spark, d), views.archive_inventory(spark, d))


@query("requested_symbols", "SET-4",
       f"""WITH {views.LINES} SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, min(l_orderkey) AS first_index
           FROM lines GROUP BY ALL""")
def requested_symbols(spark, d):
    asked = views.lines(spark, d).select(
        F.concat(F.when(F.col("l_linestatus") == "F", " p").otherwise("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_orderkey").alias("index"))
    return loads.requested_symbols(asked).select("symbol", F.col("index").alias("first_index"))


@query("read_defaults", "SC-28 SC-22",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key, acquired_disposed,
             CASE WHEN transaction_code = 'S' THEN '4' ELSE form_type END AS form_type,
             CASE WHEN transaction_code = 'P' THEN contains(form_type, '/A') ELSE is_amendment END AS is_amendment
           FROM filings""")
def read_defaults(spark, d):
    code = F.col("transaction_code")
    payload = F.to_json(F.struct(F.struct(F.col("acquired_disposed").alias("TRANS_ACQUIRED_DISP_CD")).alias("transaction")))
    stored = views.filings(spark, d).withColumn("raw_payload", payload).withColumns({
        "acquired_disposed": F.when(code == "P", F.col("acquired_disposed")),
        "form_type": F.when(code != "S", F.col("form_type")),
        "is_amendment": F.when(code != "P", F.col("is_amendment"))})
    return access.read_defaults(stored).select(*ID, "acquired_disposed", "form_type", "is_amendment")


def _indexed(events):
    """Rows of one key are alike here: a running number orders them as well as the long key, and is half as long as its hash."""
    return events.withColumn("index", F.monotonically_increasing_id())


def _store_results(spark, events, path):
    """Lookups take the bars' buckets by symbol as they lie."""
    with settings(spark, **asof.IN_BUCKETS):
        return sinks.store(spark, _indexed(events), schemas.RESEARCH_EVENTS, path, "index", STAMP)


def _read_back(spark, events, label):
    """Results that were stored, as they are read from the store."""
    path = fresh_dir(spark, label)
    _store_results(spark, events, path)
    return schemas.read(spark, schemas.RESEARCH_EVENTS, path)


def _bars(spark, d):
    """Daily bars in buckets by symbol, dealt once for all lookups, and the number of buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bars = views.prices(spark, d).select("symbol", "price_date", "source", "close")
    return asof.store_bucketed(bars, "bars", buckets), buckets


def _returns(spark, rows, series, buckets):
    """Returns of all events after the holding time: staged, as results and trades are both made of them."""
    made = research.event_returns(rows, series, [study.HOLDING], buckets).select(
        "event_key", "symbol", "event_date", "horizon_days", "event_price", "future_date", "future_price", "return_pct")
    with settings(spark, **asof.IN_BUCKETS), freed_shuffles(spark):
        return stage(made, "returns")


def _backtest(returns):
    trades = research.trades_of(returns)
    return sinks.backtest_results("run-1", trades, research.summarize_trades(trades), "1.0")


@query("stored_outcomes", "FLT-5 FLT-7 SNK-7",
       f"""WITH {study.OUTCOMES} SELECT 'signal-outcome:' || signal_key || ':' || evaluation_periods AS event_key, symbol,
             signal_date AS event_date, outcome_date, round(return_pct, 6) AS return_pct, evaluation_periods
           FROM outcomes WHERE outcome_date IS NOT NULL""")
def stored_outcomes(spark, d):
    bars, buckets = _bars(spark, d)
    made = research.evaluate_signals(study._price_signals(spark, d, bars), asof.price_series(bars), [1, 3], buckets)
    stored = _read_back(spark, sinks.outcome_results(made.where(F.col("reason").isNull()), "1.0"), "outcomes")
    back = access.decode_results(stored, "signal_outcome", "outcome_date date, return_pct double, evaluation_periods int")
    return rounded(back.select("event_key", "symbol", "event_date", "result.outcome_date", "result.return_pct",
                               "result.evaluation_periods"), "return_pct")


@query("stored_backtest", "FLT-7 SNK-7",
       f"""WITH {study.TRADES} SELECT 'backtest:run-1' AS event_key, 'backtest' AS event_type, count(*) AS trade_count,
             CAST(NULL AS DOUBLE) AS return_pct FROM trades
           UNION ALL SELECT DISTINCT 'backtest:run-1:' || signal_key, 'backtest_trade', NULL, round(return_pct, 6) FROM trades""")
def stored_backtest(spark, d):
    bars, buckets = _bars(spark, d)
    returns = _returns(spark, views.filings(spark, d), asof.price_series(bars), buckets)
    stored = _read_back(spark, _backtest(returns), "backtest")
    runs = access.decode_results(stored, "backtest", "run_id string, summary struct<trade_count bigint>").select(
        "event_key", "event_type", "result.summary.trade_count", F.lit(None).cast("double").alias("return_pct"))
    rows = access.decode_results(stored, "backtest_trade", "return_pct double").select(
        "event_key", "event_type", F.lit(None).cast("bigint").alias("trade_count"), "result.return_pct")
    return rounded(runs.unionByName(rows), "return_pct")


@query("signal_by_key", "FLT-6 SNK-8",
       f"""WITH {views.SUBMISSIONS}, {views.SIGNALS}, k AS (SELECT min(signal_key) AS signal_key FROM signals)
           SELECT s.signal_key, any_value(s.symbol) AS symbol, arg_min(s.signal_type, s.input_index) AS signal_type
           FROM signals s JOIN k ON k.signal_key = s.signal_key GROUP BY s.signal_key""")
def signal_by_key(spark, d):
    """One stored signal, read from its range of the store."""
    path, rows = fresh_dir(spark, "signals"), views.signals(spark, d)
    sinks.store(spark, rows, schemas.SIGNALS, path, "input_index", STAMP)
    key = rows.agg(F.min("signal_key")).first()[0]
    return access.signal_by_key(schemas.read(spark, schemas.SIGNALS, path), key).select("signal_key", "symbol", "signal_type")


def _research_events(spark, d):
    """All kinds of results, made from the given tables."""
    rows, (bars, buckets) = views.filings(spark, d), _bars(spark, d)
    series = asof.price_series(bars)
    summaries = research.event_study(rows, series, study.HORIZONS, ["transaction_code"], buckets)
    key = F.concat_ws(":", F.lit("event-study"), "transaction_code", F.col("horizon_days").cast("string"))
    made = research.evaluate_signals(study._price_signals(spark, d, bars), series, [1, 3], buckets).where(F.col("reason").isNull())
    returns = _returns(spark, rows, series, buckets)
    return sinks.event_return_results(returns, "1.0").unionByName(
        sinks.study_summary_results(summaries, key, "1.0")).unionByName(sinks.outcome_results(made, "1.0")).unionByName(
        _backtest(returns))


def _stored_events(spark, d, runs):
    path = fresh_dir(spark, "research_events")
    made = _research_events(spark, d)
    if len(runs) > 1:
        with settings(spark, **asof.IN_BUCKETS), freed_shuffles(spark):
            made = stage(made, "results")
    return path, [_store_results(spark, made, path).withColumn("run", F.lit(run)) for run in runs]


STORED = f"""{study.TRADES}, {study.OUTCOMES.removeprefix(f'{views.LINES}, {views.SERIES}, ')},
  e AS (SELECT 'event_return' AS event_type, ticker || '|' || CAST(filing_date AS VARCHAR) || '|' || accession_number || '|'
          || record_hash AS event_key, ticker AS symbol, entry_date AS event_date FROM returns WHERE horizon_days = 5
    UNION ALL SELECT DISTINCT 'event_study_summary', 'event-study:' || transaction_code || ':' || horizon_days, NULL, NULL FROM returns
    UNION ALL SELECT 'signal_outcome', 'signal-outcome:' || signal_key || ':' || evaluation_periods, symbol, signal_date
      FROM outcomes WHERE outcome_date IS NOT NULL
    UNION ALL SELECT 'backtest', 'backtest:run-1', NULL, NULL
    UNION ALL SELECT 'backtest_trade', 'backtest:run-1:' || signal_key, symbol, entry_date FROM trades),
  k AS (SELECT event_type, count(*) AS a, count(DISTINCT event_key) AS n FROM e GROUP BY ALL)"""


@query("research_event_store", "SNK-7 FLT-7",
       f"""WITH {STORED} SELECT 1 AS run, event_type, 'INSERTED' AS outcome, n AS rows FROM k
           UNION ALL SELECT 1, event_type, 'DUPLICATE', a - n FROM k WHERE a > n
           UNION ALL SELECT 2, event_type, 'DUPLICATE', a FROM k""")
def research_event_store(spark, d):
    _, (first, second) = _stored_events(spark, d, (1, 2))
    return sinks.outcome_counts(first.unionByName(second), ["run", "event_type"])


@query("research_event_lookup", "FLT-5 FLT-6 FLT-7 ORD-3",
       f"""WITH {STORED}, s AS (SELECT DISTINCT * FROM e)
           SELECT 'of symbol' AS lookup, event_key, event_type, symbol, event_date FROM s
             WHERE event_type = 'signal_outcome' AND symbol = 'P5'
           UNION ALL SELECT 'by key', event_key, event_type, symbol, event_date FROM s WHERE event_key = 'backtest:run-1'
           UNION ALL (SELECT 'newest', event_key, event_type, symbol, event_date FROM s WHERE event_type = 'event_return'
             ORDER BY event_date DESC NULLS LAST, event_key LIMIT 50)""")
def research_event_lookup(spark, d):
    path, _ = _stored_events(spark, d, (1,))
    stored = schemas.read(spark, schemas.RESEARCH_EVENTS, path)
    found = {
        "of symbol": access.decode_results(stored, "signal_outcome", "return_pct double", " p5 "),
        "by key": access.result_by_key(stored, "backtest:run-1"),
        "newest": access.newest(stored, ["event_date"], "event_key", 50, event_type="event_return"),
    }
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("lookup"), "event_key", "event_type", "symbol", "event_date")
        out = part if out is None else out.unionByName(part)
    return out


@query("series_by_source_name", "WN-6 FLT-2",
       f"WITH {views.LINES}, {views.PRICES} SELECT symbol, price_date, close AS px FROM prices")
def series_by_source_name(spark, d):
    """Two sources a day with different prices and no priority: that of the first by name counts."""
    bars = views.prices(spark, d)
    both = bars.withColumns({"source": F.lit("beta"), "close": F.col("close") + 1}).unionByName(bars.withColumn("source", F.lit("alpha")))
    return asof.price_series(both)

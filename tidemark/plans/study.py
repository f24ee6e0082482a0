"""Registered queries: point-in-time research."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, research, signals
from tidemark.plans import views
from tidemark.plans.registry import query

HORIZONS = [1, 5, 10]

# Which rule a filing fails first; the horizon is filled in.
REASONS = """CASE WHEN is_amendment OR contains(form_type, '/A') OR date_of_orig_submission IS NOT NULL
       THEN 'REJECTED_AMENDMENT_UNRESOLVED_ORIGINAL'
     WHEN ticker IS NULL THEN 'REJECTED_MISSING_TICKER'
     WHEN filing_date IS NULL THEN 'REJECTED_MISSING_DATE'
     WHEN entry_rn IS NULL THEN 'REJECTED_MISSING_PRICE'
     WHEN min_px <= 0 THEN 'REJECTED_INVALID_PRICE'
     WHEN n - entry_rn < {h} THEN 'REJECTED_INSUFFICIENT_OBSERVATIONS' END"""

RETURNS = f"""{views.ENTRIES}, asked AS MATERIALIZED (
  SELECT *, ticker || '#' || (entry_rn + horizon_days) AS place FROM (SELECT *, unnest([1, 5, 10]) AS horizon_days FROM entries
    WHERE NOT is_amendment AND ticker IS NOT NULL AND min_px > 0 AND entry_rn IS NOT NULL)),
returns AS MATERIALIZED (
  SELECT a.*, x.price_date AS future_date, x.px AS future_px, (x.px / a.entry_px - 1) * 100 AS return_pct
  FROM asked a JOIN placed x ON x.place = a.place)"""

SUMMARY = """count(*) AS event_count, round(avg(return_pct), 6) AS mean_return_pct,
  round(median(return_pct), 6) AS median_return_pct,
  count(*) FILTER (return_pct > 0) AS positive_event_count, count(*) FILTER (return_pct < 0) AS negative_event_count,
  count(*) FILTER (return_pct = 0) AS zero_return_event_count,
  round(count(*) FILTER (return_pct > 0) / count(*) * 100, 6) AS positive_event_rate_pct"""


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def _series(spark, d):
    return asof.price_series(views.prices(spark, d))


def study(spark, d, by):
    out = research.event_study(views.filings(spark, d), _series(spark, d), HORIZONS, by)
    return rounded(out, "mean_return_pct", "median_return_pct", "positive_event_rate_pct")


@query("event_study_by_code", "JN-6 JN-7 SC-14 AGG-1 OP-4",
       f"WITH {RETURNS} SELECT transaction_code, horizon_days, {SUMMARY} FROM returns GROUP BY ALL")
def event_study_by_code(spark, d):
    return study(spark, d, ["transaction_code"])


@query("event_study_overall", "AGG-1",
       f"WITH {RETURNS} SELECT horizon_days, {SUMMARY} FROM returns GROUP BY ALL")
def event_study_overall(spark, d):
    return study(spark, d, [])


@query("event_study_by_symbol", "AGG-1",
       f"WITH {RETURNS} SELECT ticker AS symbol, horizon_days, {SUMMARY} FROM returns GROUP BY ALL")
def event_study_by_symbol(spark, d):
    weighted = research.weighted_returns(views.filings(spark, d), _series(spark, d), HORIZONS)
    out = research.summarize_event_returns(weighted, ["symbol"], small_groups=True)
    return rounded(out, "mean_return_pct", "median_return_pct", "positive_event_rate_pct")


@query("event_returns", "JN-6 JN-7 JN-15 SC-24 WN-2",
       f"""WITH {RETURNS} SELECT ticker || '|' || CAST(filing_date AS VARCHAR) || '|' || accession_number || '|'
             || record_hash AS event_key, ticker AS symbol, entry_date AS event_date, horizon_days,
             entry_px AS event_price, future_px AS future_price,
             round(return_pct, 6) AS return_pct FROM returns""")
def event_returns(spark, d):
    out = research.event_returns(views.filings(spark, d), _series(spark, d), HORIZONS).select(
        "event_key", "symbol", "event_date", "horizon_days", "event_price", "future_price", "return_pct")
    return rounded(out, "return_pct")


@query("bucketed_event_returns", "JN-6 JN-7 WN-2 SRC-17",
       f"""WITH {RETURNS} SELECT accession_number, record_hash, horizon_days, entry_date AS event_date, future_date,
             round(return_pct, 6) AS return_pct FROM returns""")
def bucketed_event_returns(spark, d):
    """The same lookup over prices that are stored in buckets by symbol: only the filings are shuffled."""
    # A bucket is one task's, so there are as many as the session deals a shuffle of these tables to.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = asof.store_bucketed(views.prices(spark, d).select("symbol", "price_date", "source", "close"), "prices", buckets)
    out = research.event_returns(views.filings(spark, d), asof.price_series(stored), HORIZONS, buckets=buckets)
    return rounded(out.select("accession_number", "record_hash", "horizon_days", "event_date", "future_date", "return_pct"), "return_pct")


@query("event_preparation", "JN-6 OP-2 OP-3",
       f"""WITH {views.ENTRIES}, reasoned AS (SELECT *, {REASONS.format(h=5)} AS reason FROM entries)
       SELECT accession_number, record_hash, reason, CASE WHEN reason IS NULL THEN entry_date END AS event_date,
              CASE WHEN reason IS NULL THEN entry_px END AS event_price FROM reasoned""")
def event_preparation(spark, d):
    out = research.prepare_events(views.filings(spark, d), _series(spark, d), 5).select(
        "accession_number", "record_hash", "reason", "event_date", "event_price")
    return out


@query("event_rejection_counts", "OP-3",
       f"""WITH {views.ENTRIES}, reasoned AS (SELECT *, {REASONS.format(h=5)} AS reason FROM entries)
       SELECT coalesce(reason, 'VALID') AS reason, filing_period, count(*) AS filings FROM reasoned GROUP BY ALL""")
def event_rejection_counts(spark, d):
    out = research.prepare_events(views.filings(spark, d), _series(spark, d), 5)
    return out.groupBy(F.coalesce("reason", F.lit("VALID")).alias("reason"), "filing_period").agg(
        F.count(F.lit(1)).alias("filings"))


@query("entry_observation", "JN-6",
       f"""WITH {views.FILINGS}, {views.SERIES}, probes AS (SELECT DISTINCT ticker, filing_date FROM filings
             WHERE ticker IS NOT NULL)
       SELECT p.ticker AS symbol, p.filing_date AS probe_date, s.price_date AS entry_date,
              s.px AS entry_price, coalesce(s.n - s.rn + 1, 0) AS later
       FROM probes p ASOF LEFT JOIN series s ON p.ticker = s.symbol AND p.filing_date < s.price_date""")
def entry_observation(spark, d):
    probes = views.filings(spark, d).where(F.col("ticker").isNotNull()).select(
        F.col("ticker").alias("symbol"), F.col("filing_date").alias("probe_date")).distinct()
    return asof.observations_after(_series(spark, d), probes, [1]).select(
        "symbol", "probe_date", F.col("obs_1.date").alias("entry_date"),
        F.col("obs_1.px").alias("entry_price"), "later")


@query("price_ordinals", "WN-2",
       f"WITH {views.LINES}, {views.SERIES} SELECT symbol, price_date, rn AS ordinal, n AS series_length FROM series")
def price_ordinals(spark, d):
    return asof.ordinals(_series(spark, d)).select("symbol", "price_date", "ordinal", "series_length")


@query("adjacent_returns", "WN-1",
       f"""WITH {views.LINES}, {views.SERIES}, steps AS (
         SELECT symbol, price_date AS date, px / lag(px) OVER (PARTITION BY symbol ORDER BY price_date) - 1 AS r
         FROM series) SELECT symbol, date, round(r, 6) AS "return" FROM steps WHERE r IS NOT NULL""")
def adjacent_returns(spark, d):
    return rounded(asof.adjacent_returns(_series(spark, d)), "return")


@query("series_from_several_sources", "WN-6 FLT-2",
       f"""WITH {views.LINES}, {views.FEED_PRICES}
       SELECT symbol, price_date, arg_min(close, source) AS px FROM feed_prices GROUP BY ALL""")
def series_from_several_sources(spark, d):
    return asof.price_series(views.feed_prices(spark, d, by_source=True), source_priority=["feed-f"])


@query("series_preferring_second_source", "WN-6",
       f"""WITH {views.LINES}, {views.FEED_PRICES}
       SELECT symbol, price_date, arg_max(close, source) AS px FROM feed_prices GROUP BY ALL""")
def series_preferring_second_source(spark, d):
    return asof.price_series(views.feed_prices(spark, d, by_source=True), source_priority=["feed-o"])


HOLDING = 5
TRADES = f"""{RETURNS}, trades AS MATERIALIZED (
  SELECT ticker || '|' || CAST(filing_date AS VARCHAR) || '|' || accession_number || '|' || record_hash AS signal_key,
         ticker AS symbol, entry_date, future_date AS exit_date, entry_px AS entry_price, future_px AS exit_price,
         return_pct, transaction_code, filing_date, filing_period FROM returns WHERE horizon_days = {HOLDING})"""


def _trades(spark, d):
    return research.backtest_trades(views.filings(spark, d), _series(spark, d), HOLDING)


def _weighted_trades(spark, d, by):
    """Trades of all events as weighted returns: enough for every summary."""
    rows = research.weighted_returns(views.filings(spark, d), _series(spark, d), [HOLDING], by)
    return rows.withColumnRenamed("horizon_days", "holding_periods")


@query("backtest_trades", "JN-7 JN-15 OP-5",
       f"""WITH {TRADES} SELECT signal_key, symbol, entry_date, exit_date, round(return_pct, 6) AS return_pct,
             {HOLDING} AS holding_periods FROM trades""")
def backtest_trades(spark, d):
    out = _trades(spark, d).select("signal_key", "symbol", "entry_date", "exit_date", "return_pct", "holding_periods")
    return rounded(out, "return_pct")


@query("backtest_summary", "AGG-2 OP-5",
       f"""WITH {TRADES} SELECT transaction_code, count(*) AS trade_count, round(sum(return_pct), 2) AS total_return_pct,
             round(avg(return_pct), 6) AS mean_trade_return_pct,
             count(*) FILTER (return_pct > 0) AS winning_trade_count,
             count(*) FILTER (return_pct < 0) AS losing_trade_count,
             count(*) FILTER (return_pct = 0) AS zero_return_trade_count,
             round(count(*) FILTER (return_pct > 0) / count(*) * 100, 6) AS win_rate_pct,
             CAST({HOLDING} AS DOUBLE) AS average_holding_periods FROM trades GROUP BY ALL""")
def backtest_summary(spark, d):
    out = research.summarize_trades(_weighted_trades(spark, d, ["transaction_code"]), ["transaction_code"])
    return rounded(rounded(out, "mean_trade_return_pct", "win_rate_pct"), "total_return_pct", places=2)


@query("simple_trade_summary", "AGG-3 SC-15",
       f"""WITH {TRADES} SELECT round(sum(round(exit_price / entry_price - 1, 10)), 4) AS total_return,
             count(*) AS trade_count FROM trades""")
def simple_trade_summary(spark, d):
    return rounded(research.simple_trade_summary(_trades(spark, d)), "total_return", places=4)


@query("simple_outcome_summary", "AGG-4 SC-15",
       f"""WITH {TRADES} SELECT round(sum(exit_price / entry_price - 1), 4) AS total_return,
             count(*) AS outcome_count FROM trades""")
def simple_outcome_summary(spark, d):
    return rounded(research.simple_outcome_summary(_trades(spark, d)), "total_return", places=4)


# A signal per part and day, priced at that day's close.
def _price_signals(spark, d, bars=None):
    return (views.prices(spark, d) if bars is None else bars).select(
        F.concat_ws("|", F.col("symbol"), F.col("price_date").cast("string")).alias("signal_key"), "symbol",
        F.col("price_date").alias("signal_date"), F.col("close").alias("signal_price"))


OUTCOMES = f"""{views.LINES}, {views.SERIES}, price_signals AS MATERIALIZED (
  SELECT symbol || '|' || CAST(price_date AS VARCHAR) AS signal_key, symbol, price_date AS signal_date,
         close AS signal_price FROM prices),
days AS MATERIALIZED (SELECT symbol || '|' || CAST(price_date AS VARCHAR) AS signal_key, rn FROM series),
located AS MATERIALIZED (SELECT *, symbol || '#' || (rn + evaluation_periods) AS place FROM (
  SELECT p.*, s.rn, unnest([1, 3]) AS evaluation_periods FROM price_signals p JOIN days s ON s.signal_key = p.signal_key)),
outcomes AS MATERIALIZED (SELECT l.*, x.price_date AS outcome_date, x.px AS outcome_price,
         (x.px / l.signal_price - 1) * 100 AS return_pct
  FROM located l LEFT JOIN placed x ON x.place = l.place)"""


@query("signal_outcomes", "JN-7 OP-6 SC-14",
       f"""WITH {OUTCOMES} SELECT signal_key, evaluation_periods, outcome_date, round(return_pct, 6) AS return_pct,
             CASE WHEN outcome_date IS NULL THEN 'REJECTED_INSUFFICIENT_OBSERVATIONS' END AS reason FROM outcomes""")
def signal_outcomes(spark, d):
    out = research.evaluate_signals(_price_signals(spark, d), _series(spark, d), [1, 3])
    return rounded(out.select("signal_key", "evaluation_periods", "outcome_date", "return_pct", "reason"), "return_pct")


PERFORMANCE = """count(*) AS outcome_count, round(avg(return_pct), 6) AS mean_return_pct,
  round(median(return_pct), 6) AS median_return_pct, count(*) FILTER (return_pct > 0) AS positive_count,
  count(*) FILTER (return_pct < 0) AS negative_count, count(*) FILTER (return_pct = 0) AS zero_count,
  round(count(*) FILTER (return_pct > 0) / count(*) * 100, 6) AS positive_rate_pct,
  round(max(return_pct), 6) AS best_return_pct, round(min(return_pct), 6) AS worst_return_pct"""
_PERF = ("mean_return_pct", "median_return_pct", "positive_rate_pct", "best_return_pct", "worst_return_pct")


def _outcomes(spark, d):
    out = research.evaluate_signals(_price_signals(spark, d), _series(spark, d), [1, 3])
    return out.where(F.col("reason").isNull())


@query("performance_summary", "AGG-5",
       f"WITH {OUTCOMES} SELECT {PERFORMANCE} FROM outcomes WHERE return_pct IS NOT NULL")
def performance_summary(spark, d):
    return rounded(research.performance(_outcomes(spark, d)), *_PERF)


@query("performance_by_period", "AGG-6",
       f"""WITH {OUTCOMES} SELECT CASE WHEN signal_date < DATE '1998-01-01' THEN 'first_period' ELSE 'second_period' END
             AS period, {PERFORMANCE} FROM outcomes WHERE return_pct IS NOT NULL GROUP BY ALL""")
def performance_by_period(spark, d):
    label = F.when(F.col("signal_date") < F.lit("1998-01-01").cast("date"), "first_period").otherwise("second_period")
    return rounded(research.compare_periods(_outcomes(spark, d).withColumn("period", label), "period"), *_PERF)


STEPS = f"""{views.LINES}, {views.SERIES}, steps AS (SELECT symbol, r FROM (
  SELECT symbol, px / lag(px) OVER (PARTITION BY symbol ORDER BY price_date) - 1 AS r FROM series)
  WHERE r IS NOT NULL), symbol_stats AS (
  SELECT symbol, count(*) AS return_count, count(*) FILTER (r > 0) / count(*) AS positive_rate, avg(r) AS mean_return
  FROM steps GROUP BY ALL)"""


@query("symbol_return_stats", "AGG-7",
       f"""WITH {STEPS} SELECT symbol, return_count, round(positive_rate, 6) AS positive_rate,
             round(mean_return, 6) AS mean_return FROM symbol_stats""")
def symbol_return_stats(spark, d):
    return rounded(signals.symbol_stats(asof.adjacent_returns(_series(spark, d))), "positive_rate", "mean_return")


@query("symbol_classification", "OP-9",
       f"""WITH {STEPS} SELECT symbol, CASE WHEN return_count < 30 THEN 'INSUFFICIENT_DATA'
             WHEN positive_rate >= 0.5 AND mean_return >= 0 THEN 'SIGNAL' ELSE 'NO_SIGNAL' END AS signal
           FROM symbol_stats""")
def symbol_classification(spark, d):
    out = signals.classify(asof.adjacent_returns(_series(spark, d)), minimum_positive_rate=0.5)
    return out.select("symbol", "signal")


DECISIONS = f"""{RETURNS}, summaries AS (
  SELECT ticker AS symbol, horizon_days, count(*) AS event_count, avg(return_pct) AS mean_return_pct,
         count(*) FILTER (return_pct > 0) / count(*) * 100 AS positive_event_rate_pct FROM returns GROUP BY ALL),
decisions AS (SELECT *, concat_ws('; ',
    CASE WHEN event_count < 10 THEN 'Insufficient event count.' END,
    CASE WHEN positive_event_rate_pct < 55 THEN 'Positive-event rate is below the required threshold.' END,
    CASE WHEN mean_return_pct < 0 THEN 'Mean return is below the required threshold.' END) AS reasons
  FROM summaries)"""
CRITERIA = signals.Criteria(minimum_event_count=10)


def _symbol_summaries(spark, d):
    weighted = research.weighted_returns(views.filings(spark, d), _series(spark, d), HORIZONS)
    return research.summarize_event_returns(weighted, ["symbol"], small_groups=True)


@query("signal_decisions", "OP-7",
       f"""WITH {DECISIONS} SELECT symbol, horizon_days, event_count, reasons = '' AS qualified, reasons
           FROM decisions""")
def signal_decisions(spark, d):
    return signals.decide(_symbol_summaries(spark, d), CRITERIA).select(
        "symbol", "horizon_days", "event_count", "qualified", F.array_join("reasons", "; ").alias("reasons"))


@query("created_signals", "OP-8 SC-25 SC-26",
       f"""WITH {DECISIONS} SELECT sha256('{{"event_count":' || event_count || ',"horizon_days":' || horizon_days
             || ',"methodology_version":"1.0","signal_date":"2002-01-02","signal_type":"insider","symbol":"' || symbol
             || '"}}') AS signal_key, symbol, '2002-01-02' AS signal_date, 'insider' AS signal_type,
             round(positive_event_rate_pct + mean_return_pct, 6) AS score, '1.0' AS methodology_version
           FROM decisions WHERE reasons = ''""")
def created_signals(spark, d):
    out = signals.create_signals(_symbol_summaries(spark, d), "2002-01-02", "insider", "1.0", CRITERIA)
    return rounded(out.drop("rationale"), "score")


@query("signal_records", "SC-27",
       f"""WITH {DECISIONS} SELECT symbol, horizon_days, event_count FROM decisions WHERE reasons = ''""")
def signal_records(spark, d):
    made = signals.create_signals(_symbol_summaries(spark, d), "2002-01-02", "insider", "1.0", CRITERIA)
    back = signals.to_record(made).select(F.from_json("record", "symbol string, rationale string").alias("r"))
    return back.select("r.symbol", F.regexp_extract("r.rationale", r"horizon=(\d+)", 1).cast("int").alias("horizon_days"),
                       F.regexp_extract("r.rationale", r"Events=(\d+)", 1).cast("long").alias("event_count"))


@query("validated_signals", "VAL-6 WN-5",
       f"""WITH {views.SUBMISSIONS}, {views.SIGNALS}, marked AS (
         SELECT *, row_number() OVER (PARTITION BY signal_key ORDER BY input_index) AS seen FROM signals)
       SELECT input_index, signal_key, concat_ws('; ', CASE WHEN trim(signal_type) = '' THEN 'signal_type is empty.' END,
           CASE WHEN seen > 1 THEN 'signal_key is duplicated.' END) AS errors FROM marked""")
def validated_signals(spark, d):
    return signals.validate_signals(views.signals(spark, d)).select(
        "input_index", "signal_key", F.array_join("errors", "; ").alias("errors"))

"""Event preparation, event studies, backtests and signal outcomes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, numbers, text
from tidemark.operators import asof, skew, stats

# Reasons a filing gives no event.
AMENDMENT = "REJECTED_AMENDMENT_UNRESOLVED_ORIGINAL"
MISSING_TICKER = "REJECTED_MISSING_TICKER"
MISSING_DATE = "REJECTED_MISSING_DATE"
INVALID_DATE = "REJECTED_INVALID_DATE"
MISSING_PRICE = "REJECTED_MISSING_PRICE"
INVALID_PRICE = "REJECTED_INVALID_PRICE"
INSUFFICIENT = "REJECTED_INSUFFICIENT_OBSERVATIONS"


def amendment_screen(filings: DataFrame) -> DataFrame:
    """Marks unresolved amendments; originals are never superseded and look-alikes never merged."""
    amended = text.amendment_for_research(
        F.col("is_amendment"), F.col("form_type"), F.col("date_of_orig_submission")
    )
    return filings.withColumn("amendment_reason", F.when(amended, F.lit(AMENDMENT)))


def _with_probe_columns(filings: DataFrame) -> DataFrame:
    screened = amendment_screen(filings)
    ticker = text.symbol(F.col("ticker"))
    reason = F.coalesce(
        F.col("amendment_reason"),
        F.when(ticker.isNull(), F.lit(MISSING_TICKER)),
        F.when(F.col("filing_date").isNull(), F.lit(MISSING_DATE)),
    )
    return screened.withColumns({"symbol": ticker, "row_reason": reason}).drop("amendment_reason")


def _probe_reason(horizon: int) -> Column:
    return (
        F.when(F.coalesce(F.col("later"), F.lit(0)) == 0, F.lit(MISSING_PRICE))
        .when(F.col("min_px") <= 0, F.lit(INVALID_PRICE))
        .when(F.col("later") - 1 < horizon, F.lit(INSUFFICIENT))
    )


def _open_probes(prepared: DataFrame, extra: list[str]) -> DataFrame:
    """Distinct questions to the price series and how many filings ask each of them."""
    return (
        prepared.where(F.col("row_reason").isNull())
        .groupBy("symbol", F.col("filing_date").alias("probe_date"), *extra)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )


def prepare_events(filings: DataFrame, series: DataFrame, horizon: int = 1,
                   horizons: Iterable[int] = (), buckets: int | None = None) -> DataFrame:
    """Every filing row with its entry observation or the first rule it fails.

    Rule order: amendment, ticker, filing date, no later price, non-positive price in the series,
    fewer than ``horizon`` observations after the entry. ``reason`` is null for valid events. Entry
    is the first observation strictly after the filing date. ``horizons`` adds their observations
    (``obs_<h + 1>``) for the studies below. ``buckets`` as in :func:`asof.observations_after`.
    """
    wanted = sorted({horizon, *horizons})
    prepared = _with_probe_columns(filings)
    probes = _open_probes(prepared, [])
    found = asof.observations_after(series, probes, [1, *[h + 1 for h in wanted]], buckets)
    found = found.withColumnRenamed("probe_date", "filing_date").drop("_rows")
    # Counts for salts would read the filings once more; splitting a partition that grew too large costs nothing.
    joined = hashing.unpacked(skew.salted_lookup(
        hashing.packed(prepared, "record_hash"), found, ["symbol", "filing_date"]), "record_hash")
    reason = F.coalesce(F.col("row_reason"), _probe_reason(horizon))
    valid = F.col("reason").isNull()
    return joined.withColumn("reason", reason).withColumns({
        "event_date": F.when(valid, F.col("obs_1.date")),
        "event_price": F.when(valid, F.col("obs_1.px")),
        "observations_after_entry": F.when(F.col("later") > 0, F.col("later") - 1),
        "event_key": F.when(valid, hashing.event_key(
            F.col("symbol"), F.col("filing_date"), F.col("accession_number"), F.col("record_hash"))),
    }).drop("row_reason", "later", "min_px")


def event_returns(filings: DataFrame, series: DataFrame, horizons: Iterable[int], buckets: int | None = None) -> DataFrame:
    """One row per valid event and horizon. A horizon the series cannot serve gives no row."""
    wanted = sorted(set(horizons))
    events = prepare_events(filings, series, min(wanted), wanted, buckets)
    legs = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"obs_{h + 1}").alias("future")) for h in wanted
    ])
    keep = [c for c in events.columns if not c.startswith("obs_")]
    return (
        events.where(F.col("reason").isNull())
        .select(*keep, F.explode(legs).alias("_leg"))
        .where(F.col("_leg.future").isNotNull())
        .select(
            *keep, F.col("_leg.horizon_days"),
            F.col("_leg.future.date").alias("future_date"), F.col("_leg.future.px").alias("future_price"),
            numbers.pct_return(F.col("event_price"), F.col("_leg.future.px")).alias("return_pct"),
        )
    )


def weighted_returns(filings: DataFrame, series: DataFrame, horizons: Iterable[int],
                     by: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """Returns of all valid events without a row per event. ``buckets`` as in :func:`asof.observations_after`.

    Filings are first counted per symbol, filing date and ``by``; the return depends on no more than
    the first two, so the study runs on these counts and no join back to the filings is needed.
    """
    wanted, by = sorted(set(horizons)), list(by)
    probes = _open_probes(_with_probe_columns(filings), by)
    found = asof.observations_after(series, probes, [1, *[h + 1 for h in wanted]], buckets)
    legs = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"obs_{h + 1}").alias("future")) for h in wanted
    ])
    return (
        found.where((F.col("later") > 0) & (F.col("min_px") > 0))
        .select("symbol", "probe_date", *by, "_rows", "obs_1", F.explode(legs).alias("_leg"))
        .where(F.col("_leg.future").isNotNull())
        .select(
            "symbol", F.col("probe_date").alias("filing_date"), *by, "_leg.horizon_days",
            F.col("obs_1.date").alias("event_date"), F.col("obs_1.px").alias("event_price"),
            F.col("_leg.future.date").alias("future_date"), F.col("_leg.future.px").alias("future_price"),
            numbers.pct_return(F.col("obs_1.px"), F.col("_leg.future.px")).alias("return_pct"),
            F.col("_rows").alias("weight"),
        )
    )


def summarize_event_returns(returns: DataFrame, by: Iterable[str] = (), small_groups: bool = False) -> DataFrame:
    """Event-study summary per horizon and ``by``; horizons are never mixed in one group.

    Takes rows with ``return_pct`` and, where present, ``weight``. ``small_groups`` as in
    :func:`stats.summarize`.
    """
    keys = [*by, "horizon_days"]
    weight = F.col("weight") if "weight" in returns.columns else None
    done = stats.summarize(stats.compact(returns, keys, F.col("return_pct"), weight), keys, small_groups)
    return done.select(
        *keys, F.col("n").alias("event_count"), F.col("mean").alias("mean_return_pct"),
        F.col("median").alias("median_return_pct"), F.col("positive_count").alias("positive_event_count"),
        F.col("negative_count").alias("negative_event_count"), F.col("zero_count").alias("zero_return_event_count"),
        F.col("positive_rate_pct").alias("positive_event_rate_pct"),
    )


def event_study(filings: DataFrame, series: DataFrame, horizons: Iterable[int],
                by: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """Summary of the forward returns of all valid events, all horizons in one pass."""
    by = list(by)
    return summarize_event_returns(weighted_returns(filings, series, horizons, by, buckets), by)


def backtest_trades(filings: DataFrame, series: DataFrame, holding_periods: int = 1, buckets: int | None = None) -> DataFrame:
    """One simulated long trade per valid event: entry to the ``holding_periods``-th later price."""
    return trades_of(event_returns(filings, series, [holding_periods], buckets))


def trades_of(returns: DataFrame) -> DataFrame:
    """The trades that :func:`event_returns` of one horizon stand for."""
    return returns.select(
        F.col("event_key").alias("signal_key"), "symbol", F.col("event_date").alias("entry_date"),
        F.col("future_date").alias("exit_date"), F.col("event_price").alias("entry_price"),
        F.col("future_price").alias("exit_price"), "return_pct",
        F.col("horizon_days").alias("holding_periods"),
    )


def summarize_trades(trades: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Trade count, sum and mean of returns, wins, losses, win rate and mean holding time."""
    by = list(by)
    r = F.col("return_pct")
    w = F.col("weight") if "weight" in trades.columns else F.lit(1).cast("long")
    total, n = F.sum(r * w), F.sum(w)
    count = F.nullif(n, F.lit(0))
    wins, losses, zeros = stats.signed_counts(r, w)
    return trades.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("trade_count"), total.alias("total_return_pct"),
        (total / count).alias("mean_trade_return_pct"),
        F.coalesce(wins, F.lit(0)).alias("winning_trade_count"),
        F.coalesce(losses, F.lit(0)).alias("losing_trade_count"),
        F.coalesce(zeros, F.lit(0)).alias("zero_return_trade_count"),
        (wins / count * 100.0).alias("win_rate_pct"),
        (F.sum(F.col("holding_periods") * w) / count).alias("average_holding_periods"),
    )


def evaluate_signals(signals: DataFrame, series: DataFrame, evaluation_periods: Iterable[int],
                     buckets: int | None = None) -> DataFrame:
    """Outcome of each signal at the ``k``-th observation after its date. ``buckets`` as in :func:`asof.observations_after`.

    ``signals`` has ``signal_key, symbol, signal_date, signal_price``. A signal the series cannot
    serve gets ``reason`` instead of an outcome.
    """
    wanted = sorted(set(evaluation_periods))
    probes = signals.where(F.col("symbol").isNotNull() & F.col("signal_date").isNotNull()).groupBy(
        "symbol", F.col("signal_date").alias("probe_date")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    found = asof.observations_after(series, probes, wanted, buckets).withColumnRenamed("probe_date", "signal_date")
    joined = skew.salted_lookup(signals, found.drop("_rows"), ["symbol", "signal_date"])
    legs = F.array(*[
        F.struct(F.lit(k).alias("evaluation_periods"), F.col(f"obs_{k}").alias("obs")) for k in wanted
    ])
    reason = (
        F.when(F.col("min_px").isNull(), F.lit(MISSING_PRICE))
        .when((F.col("min_px") <= 0) | (F.col("signal_price") <= 0), F.lit(INVALID_PRICE))
        .when(F.col("_leg.obs").isNull(), F.lit(INSUFFICIENT))
    )
    keep = [c for c in signals.columns]
    return (
        joined.select(*keep, "min_px", F.explode(legs).alias("_leg"))
        .withColumn("reason", reason)
        .select(
            *keep, F.col("_leg.evaluation_periods"), "reason",
            F.when(F.col("reason").isNull(), F.col("_leg.obs.date")).alias("outcome_date"),
            F.when(F.col("reason").isNull(), F.col("_leg.obs.px")).alias("outcome_price"),
            F.when(F.col("reason").isNull(),
                   numbers.pct_return(F.col("signal_price"), F.col("_leg.obs.px"))).alias("return_pct"),
        )
    )


def simple_trade_summary(trades: DataFrame) -> DataFrame:
    """Sum of entry-to-exit fractions, each rounded to ten places, and their number."""
    r = numbers.fraction_return_10dp(F.col("entry_price"), F.col("exit_price"))
    return trades.agg(
        F.coalesce(F.bround(F.sum(r), 10), F.lit(0.0)).alias("total_return"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def simple_outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Sum of unrounded entry-to-exit fractions and their number."""
    r = numbers.fraction_return(F.col("entry_price"), F.col("exit_price"))
    return outcomes.agg(
        F.coalesce(F.sum(r), F.lit(0.0)).alias("total_return"), F.count(F.lit(1)).alias("outcome_count"),
    )


def performance(outcomes: DataFrame, by: Iterable[str] = (), small_groups: bool = False) -> DataFrame:
    """Descriptive statistics of outcome returns; ``result.return_pct`` stands in where needed."""
    by = list(by)
    value = F.col("return_pct") if "return_pct" in outcomes.columns else F.col("result.return_pct")
    weight = F.col("weight") if "weight" in outcomes.columns else None
    done = stats.summarize(stats.compact(outcomes, by, value, weight), by, small_groups)
    return done.select(
        *by, F.col("n").alias("outcome_count"), F.col("mean").alias("mean_return_pct"),
        F.col("median").alias("median_return_pct"), "positive_count", "negative_count", "zero_count",
        "positive_rate_pct", F.col("best").alias("best_return_pct"), F.col("worst").alias("worst_return_pct"),
    )


def compare_periods(outcomes: DataFrame, period: str) -> DataFrame:
    """Independent statistics per period label; no winner is named."""
    return performance(outcomes, [period])

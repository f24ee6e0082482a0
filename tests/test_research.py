import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, research, signals, skew, stats

D = datetime.date
PRICES = "symbol string, price_date date, close double, adjusted_close double, source string"
FILINGS = ("accession_number string, ticker string, filing_date date, form_type string, is_amendment boolean, "
           "date_of_orig_submission date, record_hash string")


@pytest.fixture
def series(rows):
    bars = [("AAPL", D(2024, 1, 15 + i), 150.0 + 5 * i, None, "s") for i in range(5)]
    return asof.price_series(rows(PRICES, *bars))


def filing(accession, ticker="AAPL", day=D(2024, 1, 16), form="4", amended=False, orig=None):
    return (accession, ticker, day, form, amended, orig, f"h{accession}")


def prepared(rows, series, *filings, horizon=1):
    out = research.prepare_events(rows(FILINGS, *filings), series, horizon).collect()
    return {r.accession_number: r for r in out}


def test_entry_is_strictly_after_the_filing_date(rows, series):
    got = prepared(rows, series, filing("a", " aapl "), filing("b", day=D(2024, 1, 14)), filing("c", day=D(2023, 1, 1)))
    assert (got["a"].event_date, got["a"].event_price) == (D(2024, 1, 17), 160.0)
    assert got["b"].event_date == D(2024, 1, 15)
    assert got["c"].event_date == D(2024, 1, 15)
    assert got["a"].event_key == "AAPL|2024-01-16|a|ha"


def test_first_failing_rule_wins(rows, series):
    got = prepared(
        rows, series, filing("ok"), filing("amend", None, form="4/A"), filing("orig", orig=D(2023, 1, 1)),
        filing("ticker", " "), filing("date", day=None), filing("noprice", "ZZZ"), filing("late", day=D(2024, 1, 19)),
        filing("short", day=D(2024, 1, 18)), filing("edge", day=D(2024, 1, 17)), horizon=1)
    assert {k: r.reason for k, r in got.items()} == {
        "ok": None, "amend": research.AMENDMENT, "orig": research.AMENDMENT, "ticker": research.MISSING_TICKER,
        "date": research.MISSING_DATE, "noprice": research.MISSING_PRICE, "late": research.MISSING_PRICE,
        "short": research.INSUFFICIENT, "edge": None}


def test_insufficient_observations_counts_after_entry(rows, series):
    got = prepared(rows, series, filing("a", day=D(2024, 1, 17)), horizon=2)
    assert got["a"].reason == research.INSUFFICIENT
    assert got["a"].observations_after_entry == 1


def test_same_day_filings_are_both_kept(rows, series):
    got = prepared(rows, series, filing("a"), filing("b"))
    assert got["a"].reason is None and got["b"].reason is None


def test_non_positive_price_rejects_the_symbol(rows):
    bars = [("A", D(2024, 1, 1 + i), p, None, "s") for i, p in enumerate([0.0, 5.0, 6.0, 7.0])]
    got = prepared(rows, asof.price_series(rows(PRICES, *bars)), filing("a", "A", D(2024, 1, 1)))
    assert got["a"].reason == research.INVALID_PRICE


def test_series_are_never_mixed(rows):
    bars = rows(PRICES, ("A", D(2024, 1, 1), 100.0, None, "s"), ("A", D(2024, 1, 2), None, 105.0, "s"))
    assert [r.px for r in asof.price_series(bars).collect()] == [100.0]
    assert [r.px for r in asof.price_series(bars, "adjusted_close").collect()] == [105.0]


def test_source_priority(rows):
    bars = rows(PRICES, ("A", D(2024, 1, 1), 1.0, None, "b"), ("A", D(2024, 1, 1), 2.0, None, "a"))
    assert asof.price_series(bars).count() == 1
    assert asof.price_series(bars, source_priority=["b"]).first().px == 1.0


def test_horizons_and_summary(rows, series):
    filings = rows(FILINGS, filing("a", day=D(2024, 1, 14)), filing("b", day=D(2024, 1, 16)), filing("c", day=D(2024, 1, 16)))
    returns = research.event_returns(filings, series, [1, 2, 4]).collect()
    assert {(r.accession_number, r.horizon_days): round(r.return_pct, 6) for r in returns} == {
        ("a", 1): round(5 / 150 * 100, 6), ("a", 2): round(10 / 150 * 100, 6), ("a", 4): round(20 / 150 * 100, 6),
        ("b", 1): 3.125, ("c", 1): 3.125, ("b", 2): 6.25, ("c", 2): 6.25}
    both = {r.horizon_days: r for r in research.event_study(filings, series, [1, 2, 4]).collect()}
    assert both[1].event_count == 3
    assert both[1].mean_return_pct == pytest.approx((5 / 150 * 100 + 2 * 3.125) / 3)
    assert both[1].median_return_pct == pytest.approx(3.125)
    assert both[4].event_count == 1 and both[4].positive_event_rate_pct == 100.0


def test_empty_study(rows, series):
    out = research.event_study(rows(FILINGS, filing("a", "ZZZ")), series, [1]).collect()
    assert out == []
    total = research.summarize_trades(research.backtest_trades(rows(FILINGS, filing("a", "ZZZ")), series)).first()
    assert total.trade_count == 0 and total.total_return_pct is None


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, -1.0, 0.0], [0.0, 0.0, 1.0, 1.0], [5.0] * 7 + [1.0] * 7, [-1e-9, 1e9, 2.0, -3.5],
    [float(i % 17) - 8.0 for i in range(200)], [1.0 + i * 1e-13 for i in range(51)]])
def test_weighted_median_is_exact(rows, values):
    df = rows("g string, v double", *[("a", v) for v in values], *[(None, v * 2) for v in values])
    got = {r.g: r.median for r in stats.weighted_median(stats.compact(df, ["g"], F.col("v")), ["g"]).collect()}
    assert got["a"] == pytest.approx(statistics.median(values), abs=1e-12)
    assert got[None] == pytest.approx(2 * statistics.median(values), abs=1e-12)


def test_weighted_median_uses_weights(rows):
    df = rows("v double, w bigint", (1.0, 10), (2.0, 1), (3.0, 1))
    out = stats.summarize(stats.compact(df, [], F.col("v"), F.col("w")), []).first()
    assert (out.median, out.n, out.best, out.worst) == (1.0, 12, 3.0, 1.0)
    small = stats.summarize(stats.compact(df, [], F.col("v"), F.col("w")), [], small_groups=True).first()
    assert small.median == 1.0


def test_adjacent_returns(rows):
    bars = rows(PRICES, *[("A", D(2024, 1, i + 1), p, None, "s") for i, p in enumerate([100.0, 105.0, 110.0])],
                ("B", D(2024, 1, 1), 1.0, None, "s"))
    got = asof.adjacent_returns(asof.price_series(bars)).orderBy("date").collect()
    assert [(r.symbol, r["return"]) for r in got] == [("A", 0.05), ("A", pytest.approx(110 / 105 - 1))]


def test_outcomes(rows, series):
    given = rows("signal_key string, symbol string, signal_date date, signal_price double",
                 ("k", "AAPL", D(2024, 1, 16), 155.0), ("end", "AAPL", D(2024, 1, 19), 170.0), ("none", "Z", D(2024, 1, 1), 1.0))
    got = {(r.signal_key, r.evaluation_periods): r for r in research.evaluate_signals(given, series, [1, 3]).collect()}
    assert got["k", 1].outcome_price == 160.0 and got["k", 3].outcome_date == D(2024, 1, 19)
    assert got["end", 1].reason == research.INSUFFICIENT and got["none", 1].reason == research.MISSING_PRICE


def test_simple_summaries(rows):
    trades = rows("entry_price double, exit_price double", (100.0, 110.0), (200.0, 190.0))
    assert tuple(research.simple_trade_summary(trades).first()) == (0.05, 2)
    none = rows("entry_price double, exit_price double")
    assert tuple(research.simple_trade_summary(none).first()) == (0.0, 0)


def test_performance_reads_nested_result(rows):
    df = rows("result struct<return_pct: double>", ((1.0,),), ((-1.0,),), ((0.0,),))
    got = research.performance(df).first()
    assert (got.outcome_count, got.median_return_pct, got.positive_count, got.negative_count, got.zero_count) == (3, 0.0, 1, 1, 1)


def summary(rows, n=40, rate=60.0, mean=1.0):
    return rows("symbol string, horizon_days int, event_count bigint, positive_event_rate_pct double, mean_return_pct double",
                ("A", 5, n, rate, mean))


def test_decisions(rows):
    assert signals.decide(summary(rows)).first().qualified
    assert signals.decide(summary(rows, 30, 55.0, 0.0)).first().qualified
    assert list(signals.decide(summary(rows, 29, None, -1.0)).first().reasons) == [
        "Insufficient event count.", "Positive-event rate is unavailable.", "Mean return is below the required threshold."]


def test_created_signal(rows):
    got = signals.create_signals(summary(rows), "2024-01-01", "insider", "1.0").first()
    assert got.score == 61.0 and "Events=40; positive_rate=60.0000%" in got.rationale
    assert signals.create_signals(summary(rows, 3), "2024-01-01", "insider", "1.0").count() == 0
    with pytest.raises(ValueError):
        signals.create_signals(summary(rows), " ", "insider", "1.0")


def test_classification(rows):
    df = rows("symbol string, return double", *[("S", 0.05)] * 40, ("I", 0.1), ("I", None), *[("N", -0.1)] * 30)
    got = {r.symbol: r.signal for r in signals.classify(df).collect()}
    assert got == {"S": "SIGNAL", "I": "INSUFFICIENT_DATA", "N": "NO_SIGNAL"}


def test_signal_validation(rows):
    df = rows("input_index int, signal_key string, symbol string, signal_date string, signal_type string, "
              "methodology_version string", (0, "k", "A", "d", "t", "1"), (1, "k", "A", "d", " ", "1"), (2, None, "A", "d", "t", "1"))
    got = {r.input_index: list(r.errors) for r in signals.validate_signals(df).collect()}
    assert got == {0: [], 1: ["signal_type is empty.", "signal_key is duplicated."], 2: ["signal_key is empty."]}


def test_hot_symbol_keeps_every_row(rows, series):
    many = [filing(str(i)) for i in range(300)] + [filing(f"x{i}", "ZZZ", D(2024, 1, 1)) for i in range(5)]
    got = research.prepare_events(rows(FILINGS, *many), series, 1)
    assert got.count() == 305 and got.where("reason is null").count() == 300


def test_median_of_infinite_values(rows):
    inf = float("inf")
    df = rows("k string, value double, weight bigint", ("a", -inf, 1), ("a", 1.0, 1), ("a", inf, 1), ("b", inf, 5), ("b", 2.0, 2),
              ("c", 0.0, 1), ("c", 3.0, 1))
    got = {r.k: r.median for r in stats.weighted_median(df, ["k"]).collect()}
    assert got == {"a": 1.0, "b": inf, "c": 1.5}


def test_median_inside_one_bucket(rows):
    values = [1.0 + k * 1e-7 for k in range(2001)]
    df = rows("value double, weight bigint", *[(v, 1 + (k % 3)) for k, v in enumerate(values)])
    every = sorted(v for k, v in enumerate(values) for _ in range(1 + k % 3))
    n = len(every)
    want = (every[(n - 1) // 2] + every[n // 2]) / 2
    assert stats.weighted_median(df, []).first().median == pytest.approx(want, abs=1e-15)


def test_hot_keys_are_spread_by_their_own_count(rows, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 3)
    left = rows("k string, n int", *[("hot", i) for i in range(20)], ("cold", 1), (None, 2))
    right = rows("k string, v int", ("hot", 7), ("cold", 8))
    counts = rows("k string, _rows bigint", ("hot", 20), ("cold", 1))
    assert [tuple(r) for r in skew.hot_keys(counts, ["k"]).collect()] == [("hot", 7)]
    got = {(r.n, r.v) for r in skew.salted_lookup(left, right, ["k"], counts).collect()}
    assert got == {(i, 7) for i in range(20)} | {(1, 8), (2, None)}


def test_median_of_buckets_too_full_to_sort(rows, monkeypatch):
    monkeypatch.setattr(stats, "SORTED_ROWS", 5)
    made = [(g, 1.0 + k / 4096 / (g + 1), 1 + k % 3) for g in range(3) for k in range(1200)] + [(5, 2.0, 4)]
    df = rows("k int, value double, weight bigint", *made)
    for out in (stats.weighted_median(df, ["k"]), stats.summarize(df, ["k"])):
        got = {r.k: r.median for r in out.collect()}
        for g in (0, 1, 2, 5):
            assert got[g] == pytest.approx(statistics.median(v for k, v, w in made if k == g for _ in range(w)), abs=1e-15)


def test_summary_of_no_rows(rows):
    out = stats.summarize(rows("value double, weight bigint"), []).first()
    assert (out.n, out.median, out.positive_count, out.best) == (0, None, 0, None)
    assert stats.summarize(rows("k int, value double, weight bigint"), ["k"]).count() == 0

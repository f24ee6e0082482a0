"""Reading filings, prices and results: filters, tiers, coverage, top-k."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates, text
from tidemark.operators import skew

Many = str | Iterable[str] | None

HOT, ARCHIVE, MISSING = "HOT", "ARCHIVE", "MISSING"


def _values(given: Many) -> list[str]:
    if not given:
        return []
    return [given] if isinstance(given, str) else list(given)


def query_transactions(
    transactions: DataFrame, *, start_date: str | date | None = None, end_date: str | date | None = None,
    filing_start_date: str | date | None = None, filing_end_date: str | date | None = None, tickers: Many = None,
    issuer_ciks: Many = None, transaction_codes: Many = None, acquired_disposed: str | None = None,
    ownership_types: Many = None, source: str | None = None, accession_numbers: Many = None,
    limit: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Conjunction of the filters given; one value or many, empty means no filter.

    Predicates stay on bare columns so that they reach the scan: tickers, codes and indicators are
    stored in upper case. Order is transaction date, then filing date, nulls first.
    """
    out = transactions
    for column, op, bound in (
        ("transaction_date", "ge", start_date), ("transaction_date", "le", end_date),
        ("filing_date", "ge", filing_start_date), ("filing_date", "le", filing_end_date),
    ):
        if bound:
            c, value = F.col(column), F.lit(bound).cast("date")
            out = out.where(c >= value if op == "ge" else c <= value)
    ciks = [c.zfill(10) if c.isdigit() else c for c in _values(issuer_ciks)]
    for column, wanted in (
        ("ticker", [t.upper() for t in _values(tickers)]), ("issuer_cik", ciks),
        ("transaction_code", [c.upper() for c in _values(transaction_codes)]),
        ("acquired_disposed", [acquired_disposed.strip().upper()] if acquired_disposed else []),
        ("ownership_type", [o.upper() for o in _values(ownership_types)]),
        ("source", _values(source)), ("accession_number", _values(accession_numbers)),
    ):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    if ordered:
        out = out.orderBy(F.asc_nulls_first("transaction_date"), F.asc_nulls_first("filing_date"))
    return out.limit(limit) if limit and limit > 0 else out


def read_defaults(stored: DataFrame) -> DataFrame:
    """Fill stored rows on read: side from the payload, form 4, flag from the form."""
    payload_side = F.get_json_object("raw_payload", "$.transaction.TRANS_ACQUIRED_DISP_CD")
    form = F.coalesce(F.nullif("form_type", F.lit("")), F.lit("4"))
    return stored.withColumns({
        "acquired_disposed": F.coalesce(F.nullif("acquired_disposed", F.lit("")), payload_side),
        "is_amendment": text.amendment_on_read(F.col("is_amendment"), form),
        "form_type": form,
    })


def quarters(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All quarters from ``start`` to ``end`` inclusive: ``year, quarter, period``."""
    bounds = spark.range(1).select(
        dates.period_index(dates.normalize_period(F.lit(start))).alias("a"),
        dates.period_index(dates.normalize_period(F.lit(end))).alias("b"),
    )
    return quarters_between(bounds)


def quarters_between(bounds: DataFrame) -> DataFrame:
    """Quarter spine of a frame of quarter-index bounds ``(a, b)``; empty where ``a > b``."""
    index = bounds.where(F.col("a") <= F.col("b")).select(F.explode(F.sequence("a", "b")).alias("i"))
    return index.select(
        F.floor(F.col("i") / 4).cast("int").alias("year"), (F.col("i") % 4 + 1).cast("int").alias("quarter"),
        dates.period_from_index(F.col("i")).alias("period"),
    )


def resolve_tiers(periods: DataFrame, state: DataFrame, archives: DataFrame, reference_period: str,
                  retention_years: int = 3) -> DataFrame:
    """Where each quarter is read from.

    HOT when inside retention and COMPLETED, else ARCHIVE when an archive exists, else MISSING.
    """
    done = state.where(F.col("status") == "COMPLETED").select("period", F.lit(True).alias("_done")).dropDuplicates(
        ["period"])
    kept = archives.select("period", F.lit(True).alias("_kept")).dropDuplicates(["period"])
    inside = dates.within_retention(F.col("period"), dates.normalize_period(F.lit(reference_period)), retention_years)
    tier = F.when(F.col("_done") & inside, HOT).when(F.col("_kept"), ARCHIVE).otherwise(MISSING)
    return periods.join(done, "period", "left").join(kept, "period", "left").withColumn("tier", tier).drop(
        "_done", "_kept")


def missing_periods(tiers: DataFrame) -> DataFrame:
    return tiers.where(F.col("tier") == MISSING).select("period")


def historical_transactions(hot: DataFrame, archived: DataFrame, tiers: DataFrame, *, strict: bool = True,
                            limit: int | None = None, ordered: bool = True, **filters: object) -> DataFrame:
    """Rows of the requested quarters, each from its own tier; tiers are disjoint by quarter.

    Both inputs carry ``filing_period``. With ``strict`` a missing quarter fails the read before any
    row is returned. Order is transaction date, filing date, accession, nulls first.
    """
    columns = [c for c in hot.columns if c in archived.columns]
    spine = tiers.select(F.col("period").alias("filing_period"), "tier")
    if strict:
        gone = missing_periods(tiers)
        names = gone.agg(F.array_join(F.array_sort(F.collect_list("period")), ", ").alias("p")).select("p").scalar()
        message = F.concat(F.lit("Requested period(s) missing from every tier: "), names, F.lit("."))
        spine = spine.withColumn("tier", F.when(names == "", F.col("tier")).otherwise(
            F.raise_error(message).cast("string")))
    # At most a few hundred quarters exist in a century, so the spine is small by its nature.
    parts = []
    for frame, tier in ((hot, HOT), (archived, ARCHIVE)):
        wanted = F.broadcast(spine.where(F.col("tier") == tier).select("filing_period"))
        parts.append(query_transactions(frame.select(*columns).join(wanted, "filing_period", "left_semi"),
                                        ordered=False, **filters))
    out = parts[0].unionByName(parts[1])
    if ordered:
        out = out.orderBy(*[F.asc_nulls_first(c) for c in ("transaction_date", "filing_date", "accession_number")])
    return out.limit(limit) if limit and limit > 0 else out


def price_range(prices: DataFrame, *, symbols: Many = None, start_date: str | None = None,
                end_date: str | None = None, adjusted: bool = False) -> DataFrame:
    """Non-null raw or adjusted closes of a date range, for all symbols or the ones named."""
    column = "adjusted_close" if adjusted else "close"
    out = prices
    if start_date:
        out = out.where(F.col("price_date") >= F.lit(start_date.strip()).cast("date"))
    if end_date:
        out = out.where(F.col("price_date") <= F.lit(end_date.strip()).cast("date"))
    wanted = [s.strip().upper() for s in _values(symbols)]
    if wanted:
        out = out.where(F.col("symbol").isin(wanted))
    return out.where(F.col(column).isNotNull()).select("symbol", "price_date", "source", F.col(column).alias("px"))


def coverage(requested: DataFrame, prices: DataFrame, *, start_date: str | None = None, end_date: str | None = None,
             required_observations: int = 0, adjusted: bool = False) -> DataFrame:
    """Coverage report for every requested symbol in one pass over the prices."""
    column = F.col("adjusted_close" if adjusted else "close")
    start = F.lit(start_date).cast("date")
    end = F.lit(end_date).cast("date")
    rows = prices
    if start_date:
        rows = rows.where(F.col("price_date") >= start)
    if end_date:
        rows = rows.where(F.col("price_date") <= end)
    found = rows.groupBy("symbol").agg(
        F.min("price_date").alias("first_available_date"), F.max("price_date").alias("last_available_date"),
        F.count(column).alias("_n"), F.count(F.when(column.isNull(), 1)).alias("_gaps"),
        (F.count(F.when(F.col("price_date") > start, column)) if start_date else F.count(column)).alias("_future"),
    )
    wanted = requested.select(text.symbol(F.col("symbol")).alias("symbol")).where(F.col("symbol").isNotNull()).distinct()
    joined = wanted.join(found, "symbol", "left")
    any_rows = F.col("first_available_date").isNotNull()
    before = F.when(any_rows, F.col("first_available_date") > start).otherwise(True) if start_date else F.lit(False)
    after = F.when(any_rows, F.col("last_available_date") < end).otherwise(True) if end_date else F.lit(False)
    n, gaps = F.coalesce("_n", F.lit(0)), F.coalesce("_gaps", F.lit(0))
    return joined.select(
        "symbol", "first_available_date", "last_available_date", n.alias("observation_count"),
        gaps.alias("missing_requested_price_field_count"), before.alias("starts_before_available"),
        after.alias("ends_after_available"), (before | after | (gaps > 0)).alias("missing_requested_range"),
        (any_rows & ~before & ~after & (n > 0)).alias("is_range_covered_boundary_level"),
        (any_rows & (F.coalesce("_future", F.lit(0)) >= required_observations)).alias(
            "has_sufficient_future_observations"),
    )


def ticker_universe(transactions: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Distinct trimmed upper-case tickers, alphabetically, of rows filed or traded in the range."""
    return universe_rows(transactions, start_date, end_date).select(
        text.symbol(F.col("ticker")).alias("ticker")
    ).where(F.col("ticker").isNotNull()).distinct().orderBy("ticker")


def universe_rows(transactions: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """The rows a universe is taken from; white-space tickers count here, though not in the universe."""
    out = transactions.where(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    if start_date or end_date:
        a, b = F.lit(start_date or "0001-01-01").cast("date"), F.lit(end_date or "9999-12-31").cast("date")
        out = out.where(F.col("filing_date").between(a, b) | F.col("transaction_date").between(a, b))
    return out


def first_symbols(universe: DataFrame, n: int) -> DataFrame:
    """The alphabetical prefix of a universe."""
    return universe.orderBy("ticker").limit(n)


def newest(rows: DataFrame, order_by: list[str], tiebreak: str, limit: int = 100,
           **equal: str | None) -> DataFrame:
    """Newest rows first, filtered by equality where a value is given."""
    if limit < 1:
        raise ValueError("limit must be at least 1.")
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*[F.desc_nulls_last(c) for c in order_by], tiebreak).limit(limit)


# What a trading run may say.
RUN_MODES = ("paper", "live")
RUN_STATUSES = ("created", "running", "completed", "failed", "cancelled")


def trade_runs(runs: DataFrame, mode: str | None = None, status: str | None = None) -> DataFrame:
    """Runs of a mode and status; unknown names are refused."""
    mode = mode.strip().lower() if mode is not None else None
    status = status.strip().lower() if status is not None else None
    if mode is not None and mode not in RUN_MODES:
        raise ValueError("Unsupported trading mode.")
    if status is not None and status not in RUN_STATUSES:
        raise ValueError("Unsupported trading-run status.")
    for column, value in (("mode", mode), ("status", status)):
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs


def decode_results(events: DataFrame, event_type: str, fields: str, symbol: str | None = None) -> DataFrame:
    """Stored results of one type with some fields of their payload as typed columns in ``result``; a field that the
    payload lacks or holds in another kind is null."""
    out = events.where(F.col("event_type") == event_type)
    if symbol:
        out = out.where(F.col("symbol") == symbol.strip().upper())
    return out.withColumn("result", F.try_variant_get("result_payload", "$", f"struct<{fields}>"))


def result_by_key(events: DataFrame, key: str) -> DataFrame:
    """The stored result of one key, read from the key's range of the store."""
    if not key.strip():
        raise ValueError("event_key cannot be empty.")
    return schemas.with_key(events, schemas.RESEARCH_EVENTS, key.strip())


def signal_by_key(signals: DataFrame, key: str) -> DataFrame:
    """The stored signal of one key, read from the key's range of the store."""
    if not key.strip():
        raise ValueError("signal_key cannot be empty.")
    return schemas.with_key(signals, schemas.SIGNALS, key.strip())


def pending_periods(periods: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Quarters still to be done: failed, partial and unknown ones are tried again."""
    if force:
        return periods
    return periods.join(state.where(F.col("status") == "COMPLETED"), "period", "left_anti")


def latest_period(state: DataFrame, archives: DataFrame) -> DataFrame:
    """The newest quarter that is completed or archived; reading it fails when there is none."""
    known = state.where(F.col("status") == "COMPLETED").select("period").unionByName(archives.select("period"))
    newest_known = F.max("period")
    return known.agg(
        F.coalesce(newest_known, F.raise_error(F.lit(
            "No authoritative period is available from completed state or archives.")).cast("string")).alias("period"))


def companies_by(rows: DataFrame, companies: DataFrame, on: str) -> DataFrame:
    """Company columns by ``ticker`` or ``cik``; the first company in order of the other key wins."""
    other = "cik" if on == "ticker" else "ticker"
    key = text.symbol(F.col(on)) if on == "ticker" else text.cik(F.col(on))
    chosen = companies.groupBy(on).agg(
        F.min(other).alias(f"company_{other}"), F.min_by("title", other).alias("company_title"))
    return skew.salted_lookup(rows.withColumn(on, key), chosen, [on])

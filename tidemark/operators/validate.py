"""Validation rules: every function adds an ``errors`` array, empty for a valid row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text


def _error_column(df: DataFrame, checks: list[Column]) -> DataFrame:
    return df.withColumn("errors", text.errors(*checks))


def is_valid() -> Column:
    return F.size("errors") == 0


def require_valid(df: DataFrame, prefix: str = "Record validation failed: ") -> DataFrame:
    """The rows themselves; the first invalid one read stops the job with its messages."""
    message = F.concat(F.lit(prefix), F.array_join("errors", "; "))
    return df.where(F.when(is_valid(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def _not_negative(c: Column, field: str) -> Column:
    return F.coalesce(numbers.numeric_error(c, field), F.when(c < 0, F.lit(f"{field} cannot be negative.")))


def _outside(c: Column, allowed: tuple[str, ...], label: str) -> Column:
    value = text.clean(c)
    return F.when(value.isNotNull() & ~F.upper(value).isin(*allowed), F.concat(F.lit(f"Invalid {label}: "), c))


def bulk_transactions(df: DataFrame) -> DataFrame:
    """Rules of a landed filing row; dates are ISO text or text that was no date at all.

    A missing reporting owner is no error on this path: an archive row always carries its (possibly
    empty) owner list.
    """
    # Read once, as a column: a rule that names an expression repeats it.
    fields = ("transaction_date", "filing_date", "date_of_orig_submission")
    df = df.withColumns({f"_day_{f}": dates.lenient_iso_date(F.col(f)) for f in fields})

    def date_error(field: str) -> Column:
        c = F.col(field)
        return F.when(F.col(f"_day_{field}").isNull() & text.clean(c).isNotNull(),
                      F.concat(F.lit(f"Invalid {field} format: "), c))

    traded, filed = F.col("_day_transaction_date"), F.col("_day_filing_date")
    ahead = F.datediff(traded, filed) > 365
    return _error_column(df, [
        F.when(text.clean(F.col("accession_number")).isNull(), F.lit("Missing filing identity (accession_number)")),
        F.when(text.clean(F.col("form_type")).isNull(), F.lit("Missing form type")),
        F.when(text.clean(F.col("issuer_cik")).isNull(), F.lit("Missing issuer identity (issuer_cik)")),
        date_error("transaction_date"), date_error("filing_date"), date_error("date_of_orig_submission"),
        F.when(ahead, F.concat(
            F.lit("Transaction date ("), F.col("transaction_date"), F.lit(") is >1 year ahead of filing date ("),
            F.col("filing_date"), F.lit(")"))),
        _outside(F.col("transaction_code"), text.TRANSACTION_CODES, "transaction code"),
        _outside(F.col("acquired_disposed"), text.ACQUIRED_DISPOSED, "acquired_disposed indicator"),
        _outside(F.col("ownership_type"), text.OWNERSHIP_TYPES, "ownership_type indicator"),
        F.when(F.col("shares") < 0, F.concat(F.lit("Negative shares value: "), F.col("shares").cast("string"))),
        F.when(F.col("price_per_share") < 0,
               F.concat(F.lit("Negative price_per_share value: "), F.col("price_per_share").cast("string"))),
        F.when(text.clean(F.col("source_url")).isNull(), F.lit("Missing source URL/reference")),
    ]).drop(*[f"_day_{f}" for f in fields])


def insider_transactions(df: DataFrame) -> DataFrame:
    return _error_column(df, [
        *[text.required_error(F.col(f), f) for f in ("source", "accession_number", "issuer_cik")],
        _not_negative(F.col("shares"), "shares"), _not_negative(F.col("price"), "price"),
    ])


def market_prices(df: DataFrame) -> DataFrame:
    """Price rules; a price of zero is allowed, an adjusted close of zero is not."""
    c = {f: F.col(f) for f in ("open", "high", "low", "close", "adjusted_close", "volume")}
    finite = {f: F.when(numbers.is_finite(v), v) for f, v in c.items()}
    ohlc = ("open", "high", "low", "close")
    checks = [text.required_error(F.col(f).cast("string"), f) for f in ("symbol", "price_date", "source")]
    checks += [numbers.numeric_error(v, f) for f, v in c.items()]
    checks += [F.when(finite[f] < 0, F.lit(f"{f} cannot be negative.")) for f in ohlc]
    checks += [
        F.when(finite["adjusted_close"] <= 0, F.lit("adjusted_close must be greater than zero.")),
        F.when(finite["volume"] < 0, F.lit("volume cannot be negative.")),
        F.when(c["close"].isNull() & c["adjusted_close"].isNull(),
               F.lit("at least one of close or adjusted_close is required.")),
        F.when(finite["high"] < finite["low"], F.lit("high cannot be lower than low.")),
    ]
    for f in ("open", "close"):
        checks.append(F.when(finite[f] > finite["high"], F.lit(f"{f} cannot exceed high.")))
        checks.append(F.when(finite[f] < finite["low"], F.lit(f"{f} cannot be below low.")))
    return _error_column(df, checks)


def corporate_actions(df: DataFrame) -> DataFrame:
    return _error_column(df, [
        *[text.required_error(F.col(f).cast("string"), f) for f in ("symbol", "action_type", "action_date", "source")],
        _not_negative(F.col("cash_amount"), "cash_amount"),
    ])


def insider_records(df: DataFrame) -> DataFrame:
    side = F.col("transaction_type")
    required = ("symbol", "insider_name", "transaction_date", "transaction_type", "source", "accession_number")
    return _error_column(df, [
        *[text.required_error(F.col(f).cast("string"), f) for f in required],
        F.when(side.isNotNull() & ~F.coalesce(text.symbol(side), F.lit("")).isin(*text.RECORD_SIDES),
               F.concat(F.lit("Invalid transaction_type: "), side)),
        _not_negative(F.col("shares"), "shares"), _not_negative(F.col("price"), "price"),
    ])

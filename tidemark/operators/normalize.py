"""Payload fields to typed rows.

Payload columns are text named as the provider names them. Each normalizer takes the first alias
that holds a value, types it, and adds ``normalize_error`` (the first rule broken, else null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.functions.settle import settled

# The names under which providers deliver each field, best first.
ALIASES = {
    "accession_number": ("accession_number", "accessionNumber", "accession"),
    "issuer_cik": ("issuer_cik", "issuerCik", "cik"),
    "issuer_name": ("issuer_name", "issuerName", "issuer"),
    "insider_name": ("insider_name", "insiderName", "reporting_owner_name", "insider"),
    "record_insider_name": ("insider_name", "insiderName", "insider", "reporting_owner_name"),
    "insider_cik": ("insider_cik", "insiderCik", "reporting_owner_cik"),
    "transaction_date": ("transaction_date", "transactionDate", "transaction_date_formatted"),
    "record_transaction_date": ("transaction_date", "transactionDate"),
    "filing_date": ("filing_date", "filingDate"),
    "form_type": ("form_type", "formType", "form"),
    "transaction_code": ("transaction_code", "transactionCode", "code", "transaction_type"),
    "transaction_type": ("transaction_type", "transactionType", "transaction_code", "transactionCode"),
    "shares": ("shares",),
    "price": ("price", "transaction_price"),
    "ownership_type": ("ownership_type", "ownershipType"),
    "symbol": ("symbol", "ticker"),
    "price_date": ("price_date", "priceDate", "date"),
    "open": ("open", "open_price"),
    "high": ("high", "high_price"),
    "low": ("low", "low_price"),
    "close": ("close", "close_price"),
    "adjusted_close": ("adjusted_close", "adjustedClose", "adj_close"),
    "volume": ("volume",),
    "action_type": ("action_type", "actionType", "type"),
    "action_date": ("action_date", "actionDate", "date"),
    "ratio": ("ratio",),
    "cash_amount": ("cash_amount", "cashAmount", "amount"),
    "source": ("source",),
    "historical_filing_date": ("filing_date", "filingDate", "filed"),
    "historical_issuer_name": ("issuer_name", "issuerName", "company_name", "companyName"),
}

Getter = Callable[[str], Column]


def from_columns(df: DataFrame) -> Getter:
    """Reads a payload whose fields are columns; names that do not exist are null."""
    present = set(df.columns)

    def get(name: str) -> Column:
        found = [F.col(f"`{a}`").cast("string") for a in ALIASES[name] if a in present]
        return text.first_present(*found) if found else F.lit(None).cast("string")

    return get


def from_map(column: str = "payload") -> Getter:
    """Reads a payload held as ``map<string,string>``."""
    def get(name: str) -> Column:
        return text.first_present(*[F.element_at(column, a) for a in ALIASES[name]])

    return get


def _staged(df: DataFrame, get: Getter, keep: list[str] | None, texts: tuple[str, ...],
            values: tuple[str, ...] = (), **given: Column) -> DataFrame:
    """Cleaned text of every field as ``t_<field>``, parsed numbers as ``n_<field>``.

    Two projections, so that the text work is done once per field however often rules refer to it.
    """
    fields = {f"t_{f}": text.clean(get(f)) for f in (*texts, *values)}
    fields |= {f"t_{f}": text.clean(c) for f, c in given.items()}
    cleaned = df.select(*[F.col(c) for c in keep or []], *[c.alias(n) for n, c in fields.items()])
    return cleaned.withColumns({f"n_{f}": numbers.parsed(numbers.strict_text(F.col(f"t_{f}"))) for f in values})


def _required(*fields: str) -> list[Column]:
    return [F.when(F.col(f"t_{f}").isNull(), F.lit(f"{f} is required.")) for f in fields]


def _numeric(*fields: str) -> list[Column]:
    return [numbers.parse_error(F.col(f"t_{f}"), F.col(f"n_{f}"), f) for f in fields]


def _error(*checks: Column) -> Column:
    return F.coalesce(*checks).alias("normalize_error")


def _texts(*fields: str) -> list[Column]:
    return [F.col(f"t_{f}").alias(f) for f in fields]


def _values(*fields: str) -> list[Column]:
    return [numbers.finite(F.col(f"n_{f}")).alias(f) for f in fields]


def bulk_transactions(raw: DataFrame) -> DataFrame:
    """Landed filing rows to typed transactions: blank text to null, lenient numbers."""
    out = {}
    for f in ("issuer_name", "ticker", "reporting_owner_name", "reporting_owner_cik", "transaction_date",
              "filing_date", "transaction_code", "security_title", "transaction_type", "acquired_disposed",
              "ownership_nature", "date_of_orig_submission", "record_hash"):
        out[f] = text.clean(F.col(f))
    for f in ("accession_number", "issuer_cik", "source_url"):
        out[f] = F.coalesce(text.clean(F.col(f)), F.lit(""))
    out["shares"] = numbers.lenient_number(F.col("shares"))
    out["price_per_share"] = numbers.lenient_number(F.col("price_per_share"))
    out["ownership_type"] = text.clean(F.col("direct_indirect"))
    out["is_amendment"] = F.coalesce(F.col("is_amendment"), F.lit(False))
    out["source"] = F.lit("SEC")
    out["form_type"] = F.coalesce(text.clean(F.col("form_type")), F.lit("4"))
    others = [c for c in raw.columns if c not in out and c != "direct_indirect"]
    return settled(raw.select(*others, *[c.alias(n) for n, c in out.items()]), others)


def insider_transactions(df: DataFrame, get: Getter, source: str, keep: list[str] | None = None) -> DataFrame:
    texts = ("accession_number", "issuer_cik", "issuer_name", "insider_name", "insider_cik", "transaction_date",
             "filing_date", "form_type", "transaction_code", "ownership_type")
    staged = _staged(df, get, keep, texts, ("shares", "price"), source=F.lit(source))
    return settled(staged.select(
        *(keep or []), *_texts("source", *texts), *_values("shares", "price"),
        _error(*_required("source", "accession_number", "issuer_cik"), *_numeric("shares", "price"))), keep or [])


_PRICE_NUMBERS = ("open", "high", "low", "close", "adjusted_close", "volume")


def market_prices(df: DataFrame, get: Getter, source: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Price rows; without ``source`` it is read from the payload."""
    named = F.lit(source) if source is not None else get("source")
    staged = _staged(df, get, keep, ("symbol", "price_date"), _PRICE_NUMBERS, source=named)
    staged = staged.withColumn("d_price_date", dates.iso_day(F.col("t_price_date")))
    return settled(staged.select(
        *(keep or []), F.upper("t_symbol").alias("symbol"), F.col("d_price_date").alias("price_date"),
        *_values(*_PRICE_NUMBERS), *_texts("source"),
        _error(*_required("source", "symbol"), dates.iso_day_error(F.col("t_price_date"), F.col("d_price_date"), "price_date"),
               *_numeric(*_PRICE_NUMBERS))), keep or [])


def price_records(prices: DataFrame) -> DataFrame:
    """The same rows under the record names ``open_price`` … ``close_price``."""
    return prices.withColumnsRenamed({f: f"{f}_price" for f in ("open", "high", "low", "close")})


def corporate_actions(df: DataFrame, get: Getter, source: str, keep: list[str] | None = None) -> DataFrame:
    """Corporate actions; type and source are lowered, as they are in the stored identity."""
    staged = _staged(df, get, keep, ("symbol", "action_type", "action_date", "ratio"), ("cash_amount",),
                     source=F.lit(source))
    return settled(staged.select(
        *(keep or []), F.upper("t_symbol").alias("symbol"), F.lower("t_action_type").alias("action_type"),
        *_texts("action_date", "ratio"), *_values("cash_amount"), F.lower("t_source").alias("source"),
        _error(*_required("source", "symbol", "action_type", "action_date"), *_numeric("cash_amount"))), keep or [])


def insider_records(df: DataFrame, get: Getter, keep: list[str] | None = None) -> DataFrame:
    texts = ("symbol", "record_insider_name", "record_transaction_date", "transaction_type", "source",
             "accession_number")
    staged = _staged(df, get, keep, texts, ("shares", "price"))
    return settled(staged.select(
        *(keep or []), F.upper("t_symbol").alias("symbol"), F.col("t_record_insider_name").alias("insider_name"),
        F.col("t_record_transaction_date").alias("transaction_date"), *_texts("transaction_type"),
        *_values("shares", "price"), *_texts("source", "accession_number"),
        _error(*_required("symbol"), *_numeric("shares", "price"), *_required("source"))), keep or [])


def historical_records(df: DataFrame, get: Getter, keep: list[str] | None = None) -> DataFrame:
    """Generic filing records: five fields, all optional."""
    return df.select(
        *(keep or []), text.clean(get("accession_number")).alias("accession_number"),
        text.clean(get("historical_filing_date")).alias("filing_date"), text.clean(get("form_type")).alias("form_type"),
        text.clean(get("issuer_cik")).alias("issuer_cik"),
        text.clean(get("historical_issuer_name")).alias("issuer_name"),
    )


def batch(df: DataFrame, get: Getter, record_type: str, source: str, index: str, strict: bool = True) -> DataFrame:
    """One record type for the whole frame; strict stops at a bad record and names its index."""
    kind = record_type.strip().lower()
    by_type = {"insider_transaction": insider_transactions, "market_price": market_prices,
               "corporate_action": corporate_actions}
    if kind not in by_type:
        raise ValueError("Unsupported record_type.")
    out = by_type[kind](df, get, source, keep=[index])
    if not strict:
        return out
    message = F.concat(F.lit("Failed to normalize record "), F.col(index).cast("string"), F.lit(": "),
                       F.col("normalize_error"))
    return out.where(F.when(F.col("normalize_error").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))

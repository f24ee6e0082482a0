"""Canonical text and fingerprints.

Canonical JSON has its keys sorted, ``,`` and ``:`` as separators, nulls kept and non-ASCII text as
it is. Doubles are written in the shortest decimal form with the same switch to exponents as the
usual ``repr`` of a double (below 1e-4 and from 1e16 on), so a fingerprint does not depend on how
one engine happens to print numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_text(c: Column) -> Column:
    """``150.0``, ``12345678.9``, ``1e+16``, ``1.5e-07``."""
    text = c.cast("double").cast("string")
    wide = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    wide = F.regexp_replace(wide, r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1")
    power = F.regexp_replace(F.regexp_replace(power, "E-", "e-"), r"e([+-])(\d)$", "e$10$2")
    plain = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)
    return F.when(text.contains("E"), F.when(plain, wide).otherwise(power)).otherwise(text)


def _string_json(c: Column) -> Column:
    # to_json escapes the text; the one-field object around it is cut off again.
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _value_json(kind: str, c: Column) -> Column:
    if kind == "double":
        body = double_text(c)
    elif kind == "int":
        body = c.cast("string")
    elif kind == "bool":
        body = F.when(c, F.lit("true")).otherwise(F.lit("false"))
        return F.when(c.isNull(), F.lit("null")).otherwise(body)
    else:
        return F.when(c.isNull(), F.lit("null")).otherwise(_string_json(c))
    return F.coalesce(body, F.lit("null"))


def canonical_json(fields: dict[str, tuple[str, Column]]) -> Column:
    """JSON object from ``{name: (kind, column)}``; kind is string, double, int or bool."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        kind, c = fields[name]
        parts.append(F.lit(("{" if i == 0 else ",") + f'"{name}":'))
        parts.append(_value_json(kind, c))
    return F.concat(*parts, F.lit("}"))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


_HEX = "^[0-9a-f]{64}$"


def packed(df: DataFrame, *columns: str | None) -> DataFrame:
    """Hexadecimal fingerprints as their 32 bytes, which is half of what a shuffle has to carry; other texts stay."""
    made = {}
    for c in filter(None, columns):
        text = F.col(c)
        is_hex = text.rlike(_HEX)
        made |= {f"_packed_{c}": F.when(is_hex, F.unhex(text)), c: F.when(~is_hex, text)}
    return df.withColumns(made) if made else df


def unpacked(df: DataFrame, *columns: str | None) -> DataFrame:
    made = {c: F.coalesce(F.lower(F.hex(f"_packed_{c}")), c) for c in filter(None, columns)}
    return df.withColumns(made).drop(*[f"_packed_{c}" for c in made]) if made else df


def record_hash(fields: dict[str, tuple[str, Column]]) -> Column:
    return sha256(canonical_json(fields))


def _date_text(c: Column) -> Column:
    return c.cast("string")


def price_hash() -> Column:
    """Fingerprint of one normalized price row (columns of ``market_prices``); no timestamps in it."""
    return record_hash({
        "symbol": ("string", F.col("symbol")),
        "price_date": ("string", _date_text(F.col("price_date"))),
        "source": ("string", F.col("source")),
        "open": ("double", F.col("open")),
        "high": ("double", F.col("high")),
        "low": ("double", F.col("low")),
        "close": ("double", F.col("close")),
        "adjusted_close": ("double", F.col("adjusted_close")),
        "volume": ("double", F.col("volume")),
    })


def action_hash() -> Column:
    """Fingerprint of one normalized corporate action; type and source are lowered beforehand."""
    return record_hash({
        "symbol": ("string", F.col("symbol")),
        "action_type": ("string", F.col("action_type")),
        "action_date": ("string", _date_text(F.col("action_date"))),
        "ratio": ("string", F.col("ratio")),
        "cash_amount": ("double", F.col("cash_amount")),
        "source": ("string", F.col("source")),
    })


def insider_hash() -> Column:
    """Fingerprint of one normalized insider transaction."""
    text = ("source", "accession_number", "issuer_cik", "issuer_name", "insider_name", "insider_cik",
            "transaction_date", "filing_date", "form_type", "transaction_code", "ownership_type")
    fields: dict[str, tuple[str, Column]] = {n: ("string", F.col(n).cast("string")) for n in text}
    fields["shares"] = ("double", F.col("shares"))
    fields["price"] = ("double", F.col("price"))
    return record_hash(fields)


def transaction_identity(accession: Column, transaction_type: Column, key: Column, form: Column,
                         is_amendment: Column) -> Column:
    """sha256 of ``accession|TYPE|key|form|0-or-1``; every part is wrapped, nulls must not vanish."""
    blank = F.lit("")
    return sha256(F.concat_ws(
        "|",
        F.coalesce(accession, blank), F.upper(F.coalesce(transaction_type, blank)), F.coalesce(key, blank),
        F.coalesce(form, blank), F.when(is_amendment, F.lit("1")).otherwise(F.lit("0")),
    ))


def event_key(ticker: Column, filing_date: Column, accession: Column, record: Column) -> Column:
    return F.concat_ws(
        "|", ticker, filing_date.cast("string"),
        F.coalesce(F.nullif(accession, F.lit("")), F.lit("UNKNOWN")),
        F.coalesce(F.nullif(record, F.lit("")), F.lit("nohash")),
    )


def signal_key(symbol: Column, signal_date: Column, signal_type: Column, methodology: Column,
               horizon: Column, event_count: Column) -> Column:
    return record_hash({
        "symbol": ("string", symbol),
        "signal_date": ("string", signal_date.cast("string")),
        "signal_type": ("string", signal_type),
        "methodology_version": ("string", methodology),
        "horizon_days": ("int", horizon),
        "event_count": ("int", event_count),
    })

"""Provider payloads held as JSON text, one envelope per row, to one record per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

# The keys under which an envelope may hold its record list, best first.
PRICE_KEYS = ("data", "results", "prices", "historical", "records")
ACTION_KEYS = ("data", "results", "actions", "corporate_actions")
FILING_KEYS = ("filings", "records", "data", "results", "recent")
ERROR_STATUSES = ("error", "400", "401", "403", "404", "500")

OBJECT = "map<string,string>"


def _is_list(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("["), F.lit(False))


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


def as_object(c: Column) -> Column:
    """JSON object text as a map of texts; null for anything else."""
    return F.when(_is_object(c), F.from_json(c, OBJECT))


def _first_list(envelope: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(_is_list(F.element_at(envelope, k)), F.element_at(envelope, k)) for k in keys])


def _records(df: DataFrame, lists: Column, keep: list[str]) -> DataFrame:
    """One row per list element with its position; ``payload`` is null when it is no object."""
    listed = df.withColumn("_list", lists)
    rows = listed.select(*keep, F.posexplode(F.from_json("_list", "array<string>")).alias("position", "record"))
    return rows.withColumn("payload", as_object(F.col("record")))


def extract(df: DataFrame, column: str, keys: tuple[str, ...], label: str, keep: list[str] | None = None,
            strict: bool = True) -> DataFrame:
    """Records of envelopes that are a list, or an object with a list under one of ``keys``.

    Any other envelope is no answer to the request. It stops the job; without ``strict`` it is isolated: one row
    without position and payload, whose ``error`` says why, and all other answers go on. Elements that are no
    objects are passed on with a null payload, so that they are accounted for.
    """
    keep = keep or [c for c in df.columns if c != column]
    body = F.col(column)
    staged = df.withColumn("_object", as_object(body))
    inner = _first_list(F.col("_object"), keys)
    if not strict:
        found = F.when(_is_list(body), body).otherwise(inner)
        error = F.when(found.isNull(), F.when(
            F.col("_object").isNull(), F.lit(f"{label} response must be a list or mapping.")).otherwise(
            F.lit(f"{label} response does not contain a supported record list.")))
        listed = staged.withColumns({"error": error, "_list": found})
        rows = listed.where(F.col("error").isNotNull() | (F.size(F.from_json("_list", "array<string>")) > 0)).select(
            *keep, "error", F.posexplode_outer(F.from_json("_list", "array<string>")).alias("position", "record"))
        return rows.withColumn("payload", as_object(F.col("record")))
    lists = (
        F.when(_is_list(body), body)
        .when(F.col("_object").isNull(), F.raise_error(F.lit(f"{label} response must be a list or mapping.")).cast("string"))
        .otherwise(F.coalesce(inner, F.raise_error(
            F.lit(f"{label} response does not contain a supported record list.")).cast("string")))
    )
    return _records(staged, lists, keep)


def prices(df: DataFrame, column: str, keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    return extract(df, column, PRICE_KEYS, "Market-data", keep, strict)


def actions(df: DataFrame, column: str, keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    return extract(df, column, ACTION_KEYS, "Corporate-actions", keep, strict)


def historical(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Generic filing payloads: a list, the first list under a known key, or else one single record."""
    keep = keep or [c for c in df.columns if c != column]
    body = F.col(column)
    staged = df.withColumn("_object", as_object(body))
    single = F.concat(F.lit("["), body, F.lit("]"))
    lists = F.when(_is_list(body), body).otherwise(F.coalesce(_first_list(F.col("_object"), FILING_KEYS), single))
    return _records(staged, lists, keep)


def _has(envelope: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(envelope, key), F.lit(False))


def price_error(envelope: Column) -> Column:
    """What a provider's price envelope says went wrong, or null."""
    status = F.lower(F.element_at(envelope, "status"))
    no_history = F.coalesce(F.element_at(envelope, "historical"), F.lit("[]")).isin("[]", "", "null", "{}")
    return (
        F.when(_has(envelope, "Error Message"), F.element_at(envelope, "Error Message"))
        .when(_has(envelope, "error"), F.element_at(envelope, "error"))
        .when(_has(envelope, "message") & no_history, F.element_at(envelope, "message"))
        .when(status.isin(*ERROR_STATUSES), F.coalesce(
            F.element_at(envelope, "message"), F.concat(F.lit("Status "), F.element_at(envelope, "status"))))
    )


def action_error(envelope: Column) -> Column:
    present = _has(envelope, "Error Message") | _has(envelope, "error") | _has(envelope, "message")
    said = F.coalesce(*[F.element_at(envelope, k) for k in ("Error Message", "error", "message")], F.lit("unknown"))
    return F.when(present, said)


def provider_errors(df: DataFrame, column: str, error=price_error) -> DataFrame:
    """The envelopes that report an error instead of records."""
    staged = df.withColumn("provider_error", error(as_object(F.col(column))))
    return staged.where(F.col("provider_error").isNotNull()).drop(column)


def _provider_items(df: DataFrame, column: str, error, keys: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Items of the envelopes without error; an object without any of ``keys`` has none."""
    staged = df.withColumn("_object", as_object(F.col(column)))
    good = staged.where(error(F.col("_object")).isNull())
    lists = F.when(_is_list(F.col(column)), F.col(column)).otherwise(
        F.coalesce(_first_list(F.col("_object"), keys), F.lit("[]")))
    return _records(good, lists, keep)


def _pick(*names: str) -> Column:
    return F.coalesce(*[F.element_at("payload", n) for n in names])


def _filled(*names: str) -> Column:
    """First value that is neither absent nor blank."""
    return F.coalesce(*[F.nullif(F.element_at("payload", n), F.lit("")) for n in names])


def _mapped(items: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    names = F.array(*[F.lit(k) for k in fields])
    values = F.array(*[c.cast("string") for c in fields.values()])
    payload = F.when(F.col("payload").isNotNull(), F.map_from_arrays(names, values))
    return items.select(*keep, "position", payload.alias("payload"))


def _item_symbol(requested: str) -> Column:
    return text.symbol(F.coalesce(F.nullif(F.element_at("payload", "symbol"), F.lit("")), F.col(requested)))


def provider_prices(df: DataFrame, column: str, requested: str, keep: list[str] | None = None) -> DataFrame:
    """Provider price items under the loader's names.

    Raw prices come from ``open`` else ``adjOpen`` and so on. ``adjClose`` never becomes the adjusted
    close: only an explicitly adjusted field does.
    """
    keep = keep or [requested]
    items = _provider_items(df, column, price_error, ("historical",), keep)
    adjusted = F.when(_has(F.col("payload"), "adjusted_close"), F.element_at("payload", "adjusted_close")).otherwise(
        F.element_at("payload", "adjustedClose"))
    return _mapped(items, keep, {
        "symbol": _item_symbol(requested), "price_date": _filled("date", "price_date", "priceDate"),
        "open": _pick("open", "adjOpen"), "high": _pick("high", "adjHigh"), "low": _pick("low", "adjLow"),
        "close": _pick("close", "adjClose"), "adjusted_close": adjusted, "volume": _pick("volume")})


def provider_splits(df: DataFrame, column: str, requested: str, keep: list[str] | None = None) -> DataFrame:
    """Splits: the ratio given, else ``numerator:denominator``."""
    keep = keep or [requested]
    items = _provider_items(df, column, action_error, ("historical", "splits"), keep)
    parts = F.concat(F.element_at("payload", "numerator"), F.lit(":"), F.element_at("payload", "denominator"))
    return _mapped(items, keep, {
        "symbol": _item_symbol(requested), "action_type": F.lit("split"),
        "action_date": text.clean(_filled("date", "executionDate", "action_date")),
        "ratio": F.coalesce(F.element_at("payload", "ratio"), parts), "cash_amount": F.lit(None)})


def provider_dividends(df: DataFrame, column: str, requested: str, keep: list[str] | None = None) -> DataFrame:
    """Dividends: the cash field is chosen by the key being there, even when its value is null."""
    keep = keep or [requested]
    items = _provider_items(df, column, action_error, ("historical", "dividends"), keep)
    payload = F.col("payload")
    cash = F.when(_has(payload, "dividend"), F.element_at(payload, "dividend")).when(
        _has(payload, "amount"), F.element_at(payload, "amount")).otherwise(F.element_at(payload, "cash_amount"))
    return _mapped(items, keep, {
        "symbol": _item_symbol(requested), "action_type": F.lit("dividend"),
        "action_date": text.clean(_filled("date", "paymentDate", "declarationDate", "action_date")),
        "ratio": F.lit(None), "cash_amount": cash})


def companies(df: DataFrame, column: str) -> DataFrame:
    """Company map ``{key: {cik_str | cik, ticker, title}}`` to rows with an ``error`` column.

    A document that is no mapping gives one row without key whose error says so.
    """
    known = df.withColumn("_map", as_object(F.col(column)))
    entries = known.where(F.col("_map").isNull() | (F.size("_map") > 0)).select(
        F.col("_map").isNull().alias("broken"), F.explode_outer("_map").alias("key", "entry"))
    rows = entries.withColumn("payload", as_object(F.col("entry"))).where(F.col("payload").isNotNull() | F.col("broken"))
    raw = F.when(_has(F.col("payload"), "cik_str"), F.element_at("payload", "cik_str")).otherwise(
        F.element_at("payload", "cik"))
    staged = rows.select("broken", "key", raw.alias("raw_cik"), text.symbol(F.element_at("payload", "ticker")).alias("ticker"),
                         text.clean(F.element_at("payload", "title")).alias("title"))
    error = F.coalesce(
        F.when(F.col("broken"), F.lit("Company map must be a mapping.")), text.cik_error(F.col("raw_cik")), F.when(F.col("ticker").isNull(), F.lit("Company ticker is required.")),
        F.when(F.col("title").isNull(), F.lit("Company title is required.")))
    return staged.select("key", text.cik(F.col("raw_cik")).alias("cik"), "ticker", "title", error.alias("error"))

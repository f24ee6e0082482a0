"""Registered queries: scalar rules, normalizers and validators over rendered text.

The line number (1 to 7) chooses how a value is written: date layouts, commas, blanks, junk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, numbers, text
from tidemark.operators import normalize, validate
from tidemark.plans import views
from tidemark.plans.registry import query

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "ship_date"]
ROW_SQL = ", ".join(ROW)


def _variant(*choices):
    """The n-th choice for line number n, the last one for all further ones."""
    out = choices[-1]
    for i, c in reversed(list(enumerate(choices[:-1], start=1))):
        out = F.when(F.col("l_linenumber") == i, c).otherwise(out)
    return out


def raw_lines(spark, d):
    """Line items with dates, numbers and names as a careless provider writes them."""
    day = F.col("ship_date")
    amount = F.col("l_extendedprice")
    bare = F.regexp_replace(F.format_number(amount, 2), ",", "")
    # The amount itself decides on the comma: 999.997 is rounded, but is no thousand.
    plain = F.when(amount < 1000, bare).otherwise(F.format_number(amount, 2))
    return views.lines(spark, d).withColumns({
        "date_text": _variant(
            F.upper(F.date_format(day, "dd-MMM-yyyy")), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"),
            F.upper(F.date_format(day, "dd-MMM-yy")), F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit("\t")),
            F.lit(" \t"), F.concat(F.year(day).cast("string"), F.lit("-02-30"))),
        "number_text": _variant(
            plain, bare, F.concat(F.lit("\t"), bare, F.lit(" ")), F.lit(""), F.concat(bare, F.lit("d")),
            F.concat(bare, F.lit("e999")), F.concat(F.lit("1_0"), bare)),
        "cik_text": _variant(
            F.col("l_suppkey").cast("string"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
            F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit("\t")), F.lit("  "),
            F.concat(F.lit("x"), F.col("l_suppkey").cast("string")),
            F.concat(F.lit("123456789012"), F.col("l_suppkey").cast("string")),
            F.col("l_suppkey").cast("string")),
        "name_text": _variant(
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
            F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" ")),
            F.concat(F.lit("\tP"), F.col("l_partkey").cast("string"), F.lit("\n")), F.lit("\t "), F.lit(""),
            F.lit(None).cast("string"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))),
    })


RAW_LINES = f"""{views.LINES}, raw_lines AS (
  SELECT *,
    CASE l_linenumber WHEN 1 THEN upper(strftime(ship_date, '%d-%b-%Y')) WHEN 2 THEN strftime(ship_date, '%Y-%m-%d')
      WHEN 3 THEN strftime(ship_date, '%Y%m%d') WHEN 4 THEN upper(strftime(ship_date, '%d-%b-%y'))
      WHEN 5 THEN ' ' || strftime(ship_date, '%Y-%m-%d') || chr(9) WHEN 6 THEN ' ' || chr(9)
      ELSE CAST(year(ship_date) AS VARCHAR) || '-02-30' END AS date_text,
    format('{{:.2f}}', l_extendedprice) AS bare,
    CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN lpad(CAST(l_suppkey AS VARCHAR), 10, '0')
      WHEN 3 THEN ' ' || l_suppkey || chr(9) WHEN 4 THEN '  ' WHEN 5 THEN 'x' || l_suppkey
      WHEN 6 THEN '123456789012' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS cik_text,
    CASE WHEN l_linenumber IN (1, 2, 3, 7) THEN 'P' || l_partkey END AS clean_name
  FROM lines)"""


@query("text_and_symbol", "SC-1 SC-2 SC-10",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, clean_name AS symbol,
             CASE WHEN l_linenumber <= 2 THEN 'p' || l_partkey ELSE clean_name END AS name,
             CASE WHEN clean_name IS NULL THEN 'name is required.' END AS error FROM raw_lines""")
def text_and_symbol(spark, d):
    c = F.col("name_text")
    return raw_lines(spark, d).select(*ROW, text.symbol(c).alias("symbol"), text.clean(c).alias("name"),
                                      text.required_error(c, "name").alias("error"))


@query("strict_dates", "SC-3",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, CASE WHEN l_linenumber IN (2, 5) THEN ship_date END AS day,
             CASE WHEN l_linenumber = 6 THEN 'date is required.'
                  WHEN l_linenumber IN (1, 3, 4) THEN 'date must be in YYYY-MM-DD ISO format.'
                  WHEN l_linenumber = 7 THEN 'date is an invalid calendar date.' END AS error FROM raw_lines""")
def strict_dates(spark, d):
    c = F.col("date_text")
    return raw_lines(spark, d).select(*ROW, dates.iso_date(c).alias("day"), dates.iso_date_error(c, "date").alias("error"))


@query("filing_date_layouts", "SC-4",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, CASE WHEN l_linenumber <= 5 THEN ship_date END AS day,
             CASE WHEN l_linenumber <= 5 THEN strftime(ship_date, '%Y-%m-%d')
                  WHEN l_linenumber = 7 THEN date_text END AS day_text FROM raw_lines""")
def filing_date_layouts(spark, d):
    c = F.col("date_text")
    return raw_lines(spark, d).select(*ROW, dates.filing_date(c).alias("day"), dates.filing_date_text(c).alias("day_text"))


@query("strict_numbers", "SC-5 SC-7",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, CASE WHEN l_linenumber <= 3 THEN CAST(bare AS DOUBLE)
                  WHEN l_linenumber = 7 THEN CAST('10' || bare AS DOUBLE) END AS number,
             CASE l_linenumber WHEN 5 THEN 'price must be numeric.' WHEN 6 THEN 'price must be finite.' END AS error
           FROM raw_lines""")
def strict_numbers(spark, d):
    c = F.col("number_text")
    return raw_lines(spark, d).select(*ROW, numbers.strict_number(c).alias("number"),
                                      numbers.strict_number_error(c, "price").alias("error"))


@query("lenient_numbers", "SC-6",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, CASE WHEN l_linenumber IN (2, 3) OR (l_linenumber = 1 AND l_extendedprice < 1000)
             THEN CAST(bare AS DOUBLE) WHEN l_linenumber = 6 THEN CAST('Infinity' AS DOUBLE)
             WHEN l_linenumber = 7 THEN CAST('10' || bare AS DOUBLE) END AS number FROM raw_lines""")
def lenient_numbers(spark, d):
    return raw_lines(spark, d).select(*ROW, numbers.lenient_number(F.col("number_text")).alias("number"))


@query("cik_padding", "SC-9 SC-8",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, CASE l_linenumber WHEN 4 THEN NULL WHEN 5 THEN cik_text WHEN 6 THEN cik_text
             ELSE lpad(CAST(l_suppkey AS VARCHAR), 10, '0') END AS cik,
             CASE l_linenumber WHEN 4 THEN 'CIK is required.' WHEN 5 THEN 'CIK must contain digits only.' END AS error,
             coalesce(CASE l_linenumber WHEN 4 THEN NULL ELSE trim(replace(cik_text, chr(9), ' ')) END, clean_name) AS found
           FROM raw_lines""")
def cik_padding(spark, d):
    c = F.col("cik_text")
    return raw_lines(spark, d).select(*ROW, text.cik(c).alias("cik"), text.cik_error(c).alias("error"),
                                      text.first_nonblank(c, F.col("name_text")).alias("found"))


@query("periods_and_retention", "SC-11 SC-12 SC-13 FLT-4",
       f"""WITH {views.LINES}, {views.SUBMISSIONS} SELECT o_orderkey, filing_period AS period,
             CAST(date_trunc('quarter', filing_date) AS DATE) AS first_day,
             CAST(date_trunc('quarter', filing_date) + INTERVAL 3 MONTH AS DATE) - 1 AS last_day,
             (2000 * 4 + 2) - (year(filing_date) * 4 + quarter(filing_date) - 1) BETWEEN 0 AND 11 AS within_retention
           FROM submissions""")
def periods_and_retention(spark, d):
    compact = F.concat(F.lit(" "), F.lower(F.regexp_replace("filing_period", "-", "")))
    period = dates.normalize_period(compact)
    return views.submissions(spark, d).select(
        "o_orderkey", period.alias("period"), dates.period_first_day(period).alias("first_day"),
        dates.period_last_day(period).alias("last_day"),
        dates.within_retention(period, dates.normalize_period(F.lit("2000Q3")), 3).alias("within_retention"))


@query("transaction_identity", "SC-19 SC-17",
       f"WITH {views.FILINGS} SELECT accession_number, transaction_key, record_hash FROM filings")
def transaction_identity(spark, d):
    return views.filings(spark, d).select("accession_number", "transaction_key", "record_hash")


@query("price_hashes", "SC-16 SC-18",
       f"WITH {views.LINES}, {views.PRICES} SELECT symbol, price_date, {views.PRICE_HASH} AS record_hash FROM prices")
def price_hashes(spark, d):
    return views.prices(spark, d).select("symbol", "price_date", hashing.price_hash().alias("record_hash"))


@query("record_hashes", "SC-20 DQ-10",
       f"""WITH {views.FILINGS}, h AS (SELECT accession_number, transaction_key,
             sha256('{{"accession_number":"' || accession_number || '","filing_date":"' || CAST(filing_date AS VARCHAR)
             || '","form_type":"' || form_type || '","insider_cik":"' || insider_cik || '","insider_name":"' || insider_name
             || '","issuer_cik":"' || issuer_cik || '","issuer_name":null,"ownership_type":"' || ownership_type
             || '","price":' || CAST(price AS VARCHAR) || ',"shares":' || CAST(shares AS VARCHAR) || ',"source":"SEC"'
             || ',"transaction_code":"' || transaction_code || '","transaction_date":"' || CAST(transaction_date AS VARCHAR)
             || '"}}') AS expected_hash FROM filings)
       SELECT accession_number, transaction_key, expected_hash, expected_hash AS actual_hash, true AS valid FROM h""")
def record_hashes(spark, d):
    rows = views.filings(spark, d).withColumn("issuer_name", F.lit(None).cast("string"))
    expected = rows.withColumn("expected_hash", F.concat(F.lit(" "), hashing.insider_hash(), F.lit("\t")))
    out = validate_hashes(expected)
    return out.select("accession_number", "transaction_key", text.clean(F.col("expected_hash")).alias("expected_hash"),
                      "actual_hash", "valid")


def validate_hashes(rows):
    from tidemark.operators import audit

    return audit.verify_hashes(rows, hashing.insider_hash(), "expected_hash")


@query("source_urls", "SC-21",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key,
             'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(issuer_cik AS BIGINT) AS VARCHAR) || '/'
               || replace(accession_number, '-', '') || '/' || accession_number || '.txt' AS url,
             'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(issuer_cik AS BIGINT) AS VARCHAR) || '/'
               || replace(accession_number, '-', '') || '/doc.xml' AS document_url,
             'https://www.sec.gov/files/structureddata/data/insider-transactions-data-sets/'
               || lower(replace(filing_period, '-', '')) || '_form345.zip' AS dataset_url FROM filings""")
def source_urls(spark, d):
    return views.filings(spark, d).select(
        "accession_number", "transaction_key",
        text.filing_url(F.lit(""), F.col("issuer_cik"), F.col("accession_number")).alias("url"),
        text.document_url(F.col("issuer_cik"), F.col("accession_number"), F.lit("doc.xml")).alias("document_url"),
        text.dataset_url(F.col("filing_period")).alias("dataset_url"))


@query("amendment_flags", "SC-22 SC-23",
       f"""WITH {views.LINES}, {views.SUBMISSIONS} SELECT o_orderkey,
             date_of_orig_submission IS NOT NULL OR form_type LIKE '%/A' AS at_parse,
             CASE WHEN o_orderstatus = 'P' THEN contains(form_type, '/A') ELSE is_amendment END AS on_read,
             is_amendment AS for_research, CASE WHEN o_orderstatus = 'P' THEN form_type ELSE '4' END AS form_or_default,
             o_orderstatus <> 'O' AS insider_form FROM submissions""")
def amendment_flags(spark, d):
    pending = F.col("o_orderstatus") == "P"
    return views.submissions(spark, d).select(
        "o_orderkey",
        text.amendment_at_parse(F.col("date_of_orig_submission").cast("string"), F.col("form_type")).alias("at_parse"),
        text.amendment_on_read(F.when(~pending, F.col("is_amendment")), F.col("form_type")).alias("on_read"),
        text.amendment_for_research(F.col("is_amendment"), F.col("form_type"), F.col("date_of_orig_submission")).alias(
            "for_research"),
        text.form_or_default(F.lit(""), F.when(pending, F.col("form_type"))).alias("form_or_default"),
        text.is_insider_form(F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("1"), "form_type")).otherwise(
            F.col("form_type"))).alias("insider_form"))


def _payload(**fields):
    return F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[c.cast("string") for c in fields.values()]))


def insider_payloads(spark, d):
    """Payload maps whose field names change with the line number."""
    key = _variant(F.lit("accession_number"), F.lit("accessionNumber"), F.lit("accession"), F.lit("unknown"))
    order = F.col("l_orderkey").cast("string")
    return raw_lines(spark, d).withColumn("payload", F.map_concat(
        F.map_from_arrays(F.array(key), F.array(order)),
        _payload(issuerCik=F.col("cik_text"), insider=F.col("name_text"), transactionDate=F.col("date_text"),
                 formType=F.lit(" 4 "), code=F.col("l_returnflag"), shares=F.col("l_quantity"),
                 transaction_price=F.col("number_text"), ownershipType=F.lit("D"), ticker=F.col("name_text"),
                 source=F.lit("SEC"))))


_CIK_CLEAN = "CASE WHEN l_linenumber <> 4 THEN trim(replace(cik_text, chr(9), ' ')) END"
_PRICE = "CASE WHEN l_linenumber <= 3 THEN CAST(bare AS DOUBLE) WHEN l_linenumber = 7 THEN CAST('10' || bare AS DOUBLE) END"
_PRICE_ERROR = "CASE l_linenumber WHEN 5 THEN 'price must be numeric.' WHEN 6 THEN 'price must be finite.' END"


@query("normalized_insider_transactions", "NRM-2 VAL-2 SC-8",
       f"""WITH {RAW_LINES}, n AS (SELECT *, {_PRICE} AS price,
             coalesce(CASE WHEN l_linenumber >= 4 THEN 'accession_number is required.' END, {_PRICE_ERROR}) AS e
           FROM raw_lines)
       SELECT {ROW_SQL}, CASE WHEN l_linenumber < 4 THEN CAST(l_orderkey AS VARCHAR) END AS accession_number,
             {_CIK_CLEAN} AS issuer_cik, CASE WHEN l_linenumber <= 2 THEN 'p' || l_partkey ELSE clean_name END AS insider_name,
             '4' AS form_type, l_returnflag AS transaction_code, l_quantity AS shares, price, e AS normalize_error,
             CASE WHEN l_linenumber >= 4 THEN 'accession_number is required.' ELSE '' END
               || CASE WHEN l_linenumber = 4 THEN '; issuer_cik is required.' ELSE '' END AS errors FROM n""")
def normalized_insider_transactions(spark, d):
    raw = insider_payloads(spark, d)
    rows = normalize.insider_transactions(raw, normalize.from_map(), "SEC", keep=ROW)
    return validate.insider_transactions(rows).select(
        *ROW, "accession_number", "issuer_cik", "insider_name", "form_type", "transaction_code", "shares", "price",
        "normalize_error", F.array_join("errors", "; ").alias("errors"))


@query("normalized_insider_records", "NRM-5 VAL-5",
       f"""WITH {RAW_LINES}, n AS (SELECT *, {_PRICE} AS price,
             coalesce(CASE WHEN clean_name IS NULL THEN 'symbol is required.' END, {_PRICE_ERROR}) AS e FROM raw_lines)
       SELECT {ROW_SQL}, clean_name AS symbol, l_returnflag AS transaction_type, price, e AS normalize_error,
         concat_ws('; ', CASE WHEN clean_name IS NULL THEN 'symbol is required.; insider_name is required.' END,
           CASE WHEN l_linenumber = 6 THEN 'transaction_date is required.' END,
           CASE WHEN l_linenumber >= 4 THEN 'accession_number is required.' END,
           'Invalid transaction_type: ' || l_returnflag) AS errors FROM n""")
def normalized_insider_records(spark, d):
    raw = insider_payloads(spark, d)
    # This shape names the side "transactionCode".
    raw = raw.withColumn("payload", F.map_concat("payload", _payload(transactionCode=F.col("l_returnflag"))))
    rows = normalize.insider_records(raw, normalize.from_map(), keep=ROW)
    return validate.insider_records(rows).select(
        *ROW, "symbol", "transaction_type", "price", "normalize_error", F.array_join("errors", "; ").alias("errors"))


def price_payloads(spark, d):
    """Price payloads: adjusted closes that are wrong, highs below lows, odd names and dates."""
    return raw_lines(spark, d).withColumn("payload", _payload(
        ticker=F.col("name_text"), priceDate=F.date_format("ship_date", "yyyy-MM-dd"), open=F.col("px"),
        high_price=F.when(F.col("l_returnflag") == "R", F.col("px") / 2).otherwise(F.col("px")),
        low=F.col("px"), close=F.when(F.col("l_linestatus") == "F", F.col("px")),
        adjustedClose=F.when(F.col("l_discount") == 0, F.lit(0)), volume=F.col("l_quantity") - 1,
        source=F.lit(" EOD ")))


_PRICE_CHECK = f"""WITH {RAW_LINES}, n AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN px / 2 ELSE px END AS high,
         CASE WHEN l_linestatus = 'F' THEN px END AS close, CASE WHEN l_discount = 0 THEN 0.0 END AS adjusted_close
       FROM raw_lines)
   SELECT {ROW_SQL}, clean_name AS symbol, ship_date AS price_date, px AS OPEN_NAME, close AS CLOSE_NAME,
     CAST(l_quantity - 1 AS DOUBLE) AS volume, 'EOD' AS source,
     CASE WHEN clean_name IS NULL THEN 'symbol is required.' END AS normalize_error,
     concat_ws('; ', CASE WHEN clean_name IS NULL THEN 'symbol is required.' END,
       CASE WHEN adjusted_close <= 0 THEN 'adjusted_close must be greater than zero.' END,
       CASE WHEN close IS NULL AND adjusted_close IS NULL THEN 'at least one of close or adjusted_close is required.' END,
       CASE WHEN high < px THEN 'high cannot be lower than low.' END,
       CASE WHEN px > high THEN 'open cannot exceed high.' END,
       CASE WHEN close > high THEN 'close cannot exceed high.' END) AS errors FROM n"""


@query("normalized_prices", "NRM-3 VAL-3 VAL-7", _PRICE_CHECK.replace("OPEN_NAME", "open").replace("CLOSE_NAME", "close"))
def normalized_prices(spark, d):
    rows = normalize.market_prices(price_payloads(spark, d), normalize.from_map(), "EOD", keep=ROW)
    return validate.market_prices(rows).select(
        *ROW, "symbol", "price_date", "open", "close", "volume", "source", "normalize_error",
        F.array_join("errors", "; ").alias("errors"))


@query("normalized_price_records", "NRM-3", _PRICE_CHECK.replace(
    "OPEN_NAME", "open_price").replace("CLOSE_NAME", "close_price"))
def normalized_price_records(spark, d):
    rows = validate.market_prices(normalize.market_prices(price_payloads(spark, d), normalize.from_map(), keep=ROW))
    return normalize.price_records(rows).select(
        *ROW, "symbol", "price_date", "open_price", "close_price", "volume", "source", "normalize_error",
        F.array_join("errors", "; ").alias("errors"))


@query("normalized_actions", "NRM-4 VAL-4 SC-20",
       f"""WITH {RAW_LINES} SELECT {ROW_SQL}, clean_name AS symbol, 'dividend' AS action_type,
         CASE WHEN l_linenumber <= 4 OR l_linenumber = 7 THEN date_text
              WHEN l_linenumber = 5 THEN strftime(ship_date, '%Y-%m-%d') END AS action_date, l_quantity - 10 AS cash_amount,
         CASE WHEN clean_name IS NULL THEN 'symbol is required.' WHEN l_linenumber = 6 THEN 'action_date is required.'
           END AS normalize_error,
         concat_ws('; ', CASE WHEN clean_name IS NULL THEN 'symbol is required.' END,
           CASE WHEN l_linenumber = 6 THEN 'action_date is required.' END,
           CASE WHEN l_quantity < 10 THEN 'cash_amount cannot be negative.' END) AS errors FROM raw_lines""")
def normalized_actions(spark, d):
    raw = raw_lines(spark, d).withColumn("payload", _payload(
        symbol=F.col("name_text"), type=F.lit("Dividend "), date=F.col("date_text"), amount=F.col("l_quantity") - 10))
    rows = normalize.corporate_actions(raw, normalize.from_map(), "Feed", keep=ROW)
    return validate.corporate_actions(rows).select(
        *ROW, "symbol", "action_type", "action_date", "cash_amount", "normalize_error",
        F.array_join("errors", "; ").alias("errors"))


@query("normalized_batch", "NRM-6",
       f"""WITH {RAW_LINES} SELECT l_orderkey, clean_name AS symbol, count(*) AS rows,
             count(*) FILTER (clean_name IS NULL) AS bad FROM raw_lines GROUP BY ALL""")
def normalized_batch(spark, d):
    rows = normalize.batch(price_payloads(spark, d), normalize.from_map(), "market_price", "EOD", "l_orderkey",
                           strict=False)
    return rows.groupBy("l_orderkey", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count("normalize_error").alias("bad"))


@query("validated_filings", "NRM-1 VAL-1",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key, concat_ws('; ',
             CASE WHEN transaction_date - filing_date > 365 THEN 'Transaction date (' || CAST(transaction_date AS VARCHAR)
               || ') is >1 year ahead of filing date (' || CAST(filing_date AS VARCHAR) || ')' END,
             CASE WHEN transaction_code = 'R' THEN 'Invalid transaction code: R' END) AS errors FROM filings""")
def validated_filings(spark, d):
    raw = views.filings(spark, d).select(
        "accession_number", "issuer_cik", "ticker", "form_type", "is_amendment", "transaction_code", "shares",
        "acquired_disposed", "transaction_type", "record_hash", "transaction_key",
        F.lit(None).cast("string").alias("issuer_name"), F.col("insider_name").alias("reporting_owner_name"),
        F.col("insider_cik").alias("reporting_owner_cik"), F.col("ownership_type").alias("direct_indirect"),
        F.lit("").alias("ownership_nature"), F.lit("Common Stock").alias("security_title"),
        F.col("price").alias("price_per_share"), F.lit("landed").alias("source_url"),
        *[F.col(c).cast("string").alias(c) for c in ("transaction_date", "filing_date", "date_of_orig_submission")])
    return validate.bulk_transactions(normalize.bulk_transactions(raw)).select(
        "accession_number", "transaction_key", F.array_join("errors", "; ").alias("errors"))

"""Registered queries: sources, bulk parsing, loads and sinks."""

from __future__ import annotations

import datetime
import hashlib
import io
import itertools
import json
import operator
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import hashing, text
from tidemark.operators import access, accounting, audit, changes, filings, loads, normalize, profiles, sinks
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.session import fresh_dir, small_methods, stage
from tidemark.sources import archive_source, archives, envelopes, filing_index, ownership
from tidemark.streaming import landing as stream
from tidemark.streaming import quarters

STAMP = datetime.datetime(2002, 1, 2)
KEY = ["accession_number", "transaction_key"]


def _cells(**columns):
    names = F.array(*[F.lit(k) for k in columns])
    return F.map_from_arrays(names, F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()]))


def _section(df, member, order, **columns):
    return df.select("filing_period", F.lit(member).alias("member"), order.cast("bigint").alias("line_no"),
                     _cells(ACCESSION_NUMBER=F.col("accession_number"), **columns).alias("cells"))


def sections(spark, d):
    """The given tables as the member tables of quarterly archives.

    Urgent orders have a second owner, pending ones a footnote, finished ones a signature, open ones a holding of
    each kind; every submission comes twice, and the later line is the right one.
    """
    heads = views.submissions(spark, d)
    rows = views.filings(spark, d)
    day = F.upper(F.date_format("filing_date", "dd-MMM-yyyy"))
    order = F.col("o_orderkey")

    def submission(line, name):
        return _section(
            heads, "SUBMISSION", line, FILING_DATE=day, DATE_OF_ORIG_SUB=F.date_format("date_of_orig_submission", "yyyyMMdd"),
            DOCUMENT_TYPE=F.col("form_type"), ISSUERCIK=F.col("o_custkey"), ISSUERNAME=name, ISSUERTRADINGSYMBOL=F.lit(" abc"))

    def owner(df, line, name):
        return _section(df, "REPORTINGOWNER", line, RPTOWNERCIK=F.col("o_custkey"), RPTOWNERNAME=name)

    def trade(df, member, key):
        return _section(
            df, member, F.col("o_orderkey"), **{key: F.col("transaction_key")}, SECURITY_TITLE=F.lit("Common Stock"),
            TRANS_DATE=F.date_format("transaction_date", "yyyy-MM-dd"), TRANS_FORM_TYPE=F.lit(""),
            TRANS_CODE=F.col("transaction_code"), TRANS_SHARES=F.col("shares"), TRANS_PRICEPERSHARE=F.lit("1.5"),
            TRANS_ACQUIRED_DISP_CD=F.col("acquired_disposed"), DIRECT_INDIRECT_OWNERSHIP=F.col("ownership_type"))

    parts = [
        submission(order * 2, F.lit("outdated")), submission(order * 2 + 1, F.lit("Issuer")),
        owner(heads, order * 2, F.lit("First")),
        owner(heads.where(F.col("o_orderpriority") == "1-URGENT"), order * 2 + 1, F.lit("Second")),
        _section(heads.where(F.col("o_orderstatus") == "P"), "FOOTNOTES", order, FOOTNOTE_TXT=F.lit("note")),
        _section(heads.where(F.col("o_orderstatus") == "F"), "OWNER_SIGNATURE", order, OWNERSIGNATURENAME=F.lit("/s/ First")),
        _section(heads.where(F.col("o_orderstatus") == "O"), "NONDERIV_HOLDING", order, SECURITY_TITLE=F.lit("Common Stock")),
        _section(heads.where(F.col("o_orderstatus") == "O"), "DERIV_HOLDING", order, SECURITY_TITLE=F.lit("Option")),
        trade(rows.where(F.col("transaction_type") == "non_derivative"), "NONDERIV_TRANS", "NONDERIV_TRANS_SK"),
        trade(rows.where(F.col("transaction_type") == "derivative"), "DERIV_TRANS", "DERIV_TRANS_SK"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BULK = """SELECT f.accession_number, f.transaction_key, f.record_hash, f.form_type, f.is_amendment, f.transaction_type,
  CAST(f.filing_date AS VARCHAR) AS filing_date, CAST(f.transaction_date AS VARCHAR) AS transaction_date,
  lpad(CAST(f.o_custkey AS VARCHAR), 10, '0') AS issuer_cik, 'Issuer' AS issuer_name,
  CASE WHEN f.ownership_type = 'D' THEN lpad(CAST(f.o_custkey AS VARCHAR), 10, '0') END AS reporting_owner_cik,
  CASE WHEN f.ownership_type = 'D' THEN 'First' END AS reporting_owner_name,
  CASE WHEN f.ownership_type = 'D' THEN 1 ELSE 2 END AS owner_count,
  CAST(f.date_of_orig_submission AS VARCHAR) AS date_of_orig_submission FROM filings f"""
BULK_COLUMNS = ["accession_number", "transaction_key", "record_hash", "form_type", "is_amendment", "transaction_type",
                "filing_date", "transaction_date", "issuer_cik", "issuer_name", "reporting_owner_cik",
                "reporting_owner_name", "owner_count", "date_of_orig_submission"]


@query("bulk_records", "OP-1 JN-1 JN-2 SET-3 WN-3", f"WITH {views.FILINGS} {BULK}")
def bulk_records(spark, d):
    return filings.bulk_records(sections(spark, d)).select(*BULK_COLUMNS)


@query("bulk_transactions", "OP-1 NRM-1 VAL-1",
       f"""WITH {views.FILINGS}, b AS ({BULK}) SELECT b.accession_number, b.transaction_key, f.shares, 1.5 AS price_per_share,
             'abc' AS ticker, concat_ws('; ',
             CASE WHEN f.transaction_date - f.filing_date > 365 THEN 'Transaction date (' || b.transaction_date
               || ') is >1 year ahead of filing date (' || b.filing_date || ')' END,
             CASE WHEN f.transaction_code = 'R' THEN 'Invalid transaction code: R' END) AS errors
           FROM b JOIN filings f ON f.record_hash = b.record_hash""")
def bulk_transactions(spark, d):
    return filings.parse(sections(spark, d)).select(
        *KEY, "shares", "price_per_share", "ticker", F.array_join("errors", "; ").alias("errors"))


@query("filing_detail_counts", "JN-3",
       f"""WITH {views.FILINGS} SELECT f.accession_number, f.transaction_key,
             CASE WHEN s.o_orderstatus = 'P' THEN 1 ELSE 0 END AS footnote_count,
             CASE WHEN s.o_orderstatus = 'F' THEN 1 ELSE 0 END AS signature_count,
             CASE WHEN s.o_orderstatus = 'O' THEN 1 ELSE 0 END AS nonderiv_holdings,
             CASE WHEN s.o_orderstatus = 'O' THEN 1 ELSE 0 END AS deriv_holdings,
             length(f.transaction_key) > 0 AS has_payload
           FROM filings f JOIN submissions s ON s.accession_number = f.accession_number""")
def filing_detail_counts(spark, d):
    return filings.bulk_records(sections(spark, d), with_details=True).select(
        *KEY, "footnote_count", "signature_count", "nonderiv_holdings", "deriv_holdings",
        F.get_json_object("raw_payload", "$.transaction.ACCESSION_NUMBER").eqNullSafe(F.col("accession_number")).alias(
            "has_payload"))


DETAILS = """SELECT accession_number, 'REPORTINGOWNER' AS member,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS rows FROM submissions
  UNION ALL SELECT accession_number, 'FOOTNOTES', 1 FROM submissions WHERE o_orderstatus = 'P'
  UNION ALL SELECT accession_number, 'OWNER_SIGNATURE', 1 FROM submissions WHERE o_orderstatus = 'F'
  UNION ALL SELECT accession_number, unnest(['NONDERIV_HOLDING', 'DERIV_HOLDING']), 1 FROM submissions
    WHERE o_orderstatus = 'O'"""


@query("filing_details", "JN-3", f"WITH {views.LINES}, {views.SUBMISSIONS} {DETAILS}")
def filing_details(spark, d):
    return filings.details(sections(spark, d)).groupBy("accession_number", "member").agg(
        F.count(F.lit(1)).alias("rows"))


@query("stored_details", "JN-2 JN-3 SNK-1",
       f"""WITH {views.LINES}, {views.SUBMISSIONS}, d AS ({DETAILS}), k AS (SELECT member, sum(rows) AS n FROM d
             JOIN submissions s ON s.accession_number = d.accession_number WHERE filing_period >= '1999-Q1' GROUP BY ALL)
           SELECT member, CAST(n AS BIGINT) AS stored, CAST(n AS BIGINT) AS with_cells,
             (SELECT CAST(sum(n) AS BIGINT) FROM k) AS repeated FROM k""")
def stored_details(spark, d):
    table, path = fresh_dir(spark, "insider_transactions"), fresh_dir(spark, "filing_details")
    landed = sections(spark, d)
    filings.load_quarters(spark, landed, table, STAMP, "2001-Q4", 3, store_payload=True, details_path=path)
    kept = filings.details(landed).where(F.col("filing_period") >= "1999-Q1")
    again = sinks.outcome_counts(filings.store_details(spark, kept, path, STAMP)).where("outcome = 'DUPLICATE'")
    return schemas.read(spark, schemas.FILING_DETAILS, path).groupBy("member").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_if(F.get_json_object("cells", "$.ACCESSION_NUMBER") == F.col("accession_number")).alias("with_cells")
    ).withColumn("repeated", again.select("rows").scalar())


# --- archives -----------------------------------------------------------------------------------

_TRADE = ["SECURITY_TITLE", "TRANS_DATE", "TRANS_FORM_TYPE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE",
          "TRANS_ACQUIRED_DISP_CD", "DIRECT_INDIRECT_OWNERSHIP"]
HEADER = {m: ["ACCESSION_NUMBER", *columns] for m, columns in {
    "SUBMISSION": ["FILING_DATE", "DATE_OF_ORIG_SUB", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL"],
    "REPORTINGOWNER": ["RPTOWNERCIK", "RPTOWNERNAME"], "FOOTNOTES": ["FOOTNOTE_TXT"],
    "OWNER_SIGNATURE": ["OWNERSIGNATURENAME"], "NONDERIV_HOLDING": ["SECURITY_TITLE"], "DERIV_HOLDING": ["SECURITY_TITLE"],
    "NONDERIV_TRANS": ["NONDERIV_TRANS_SK", *_TRADE], "DERIV_TRANS": ["DERIV_TRANS_SK", *_TRADE]}.items()}


def _line():
    """A row of a member table as its line of text, quoted where a cell needs it."""
    options = {"sep": "\t", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    made = F.lit(None).cast("string")
    for member, names in HEADER.items():
        cells = F.struct(*[F.coalesce(F.element_at("cells", n), F.lit("")).alias(n) for n in names])
        made = F.when(F.col("member") == member, F.to_csv(cells, options)).otherwise(made)
    return made


class _Digested:
    """An output stream that knows the checksum and size of what went through it."""

    def __init__(self, out):
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def write(self, data: bytes) -> int:
        self.digest.update(data)
        self.size += len(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def _archive_writer(folder: str):
    """Writes each input partition, sorted by member and line, as one archive with manifest.

    Lines pass through to the file system, whichever it is; none are held. Beside every archive there is one whose
    manifest is wrong and one without manifest. Returns ``period, zip_path``.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        files, root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        files.create_dir(root, recursive=True)
        period = first.column("part")[0].as_py()

        def archive(name: str, rows) -> dict:
            with files.open_output_stream(f"{root}/{name}.zip") as stream:
                out = _Digested(stream)
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for member, group in itertools.groupby(rows, key=operator.itemgetter(0)):
                        with z.open(f"{member.lower()}.TSV", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text_out:
                            text_out.write("\t".join(f" {c} " for c in HEADER[member]) + "\n")
                            text_out.writelines(f"{line}\n" for _, line in group)
            return {"period": name, "sha256": out.digest.hexdigest(), "file_size_bytes": out.size}

        def manifest(content: dict) -> None:
            with files.open_output_stream(f"{root}/{content['period']}.json") as stream:
                stream.write(json.dumps(content).encode())

        rows = (r for b in itertools.chain([first], batches)
                for r in zip(b.column("member").to_pylist(), b.column("line").to_pylist(), strict=True))
        manifest(archive(period, rows))
        manifest(archive(f"WRONG-{period}", []) | {"sha256": "0" * 64})
        archive(f"LONE-{period}", [])
        yield pa.RecordBatch.from_pydict({"period": [period], "zip_path": [f"{folder}/{period}.zip"]})

    return write


def _archives(spark, d):
    """All member tables written as archives in the shared folder, one per task."""
    folder = fresh_dir(spark, "archives")
    small_methods(spark)
    lines = sections(spark, d).select("member", "line_no", F.element_at("cells", "ACCESSION_NUMBER").alias("accession"),
                                      _line().alias("line"))
    spread = lines.repartition("accession").sortWithinPartitions("member", "line_no")
    parts = spread.select(F.concat(F.lit("PART-"), F.spark_partition_id().cast("string")).alias("part"), "member", "line")
    made = parts.mapInArrow(_archive_writer(folder), "period string, zip_path string")
    # Writing the list makes the archives exist before they are read.
    listing = fresh_dir(spark, "archive-list")
    made.write.parquet(listing)
    return folder, spark.read.parquet(listing)


@query("archive_expansion", "SRC-1 OP-1",
       f"""WITH {views.FILINGS}, b AS ({BULK}) SELECT b.*, CASE WHEN s.o_orderstatus = 'P' THEN 1 ELSE 0 END AS footnote_count,
             CASE WHEN s.o_orderstatus = 'F' THEN 1 ELSE 0 END AS signature_count,
             CASE WHEN s.o_orderstatus = 'O' THEN 2 ELSE 0 END AS holdings
           FROM b JOIN submissions s ON s.accession_number = b.accession_number""")
def archive_expansion(spark, d):
    _, found = _archives(spark, d)
    path = fresh_dir(spark, "landed")
    archives.land(found, path)
    return filings.bulk_records(archives.landed(spark, path), with_details=True).select(
        *BULK_COLUMNS, "footnote_count", "signature_count", (F.col("nonderiv_holdings") + F.col("deriv_holdings")).alias("holdings"))


EXPANDED = f"""WITH {views.FILINGS}, b AS ({BULK}) SELECT b.*, CASE WHEN s.o_orderstatus = 'P' THEN 1 ELSE 0 END AS footnote_count,
             CASE WHEN s.o_orderstatus = 'O' THEN 2 ELSE 0 END AS holdings
           FROM b JOIN submissions s ON s.accession_number = b.accession_number"""


@query("archive_source", "SRC-1 SRC-17 OP-1", EXPANDED)
def archive_source_rows(spark, d):
    """The archives read in place, by the data source, instead of landed."""
    folder, _ = _archives(spark, d)
    return filings.bulk_records(archive_source.read(spark, folder), with_details=True).select(
        *BULK_COLUMNS, "footnote_count", (F.col("nonderiv_holdings") + F.col("deriv_holdings")).alias("holdings"))


@query("archive_columns", "SRC-1 SRC-17",
       f"""WITH {views.FILINGS} SELECT 'DERIV_TRANS' AS member, transaction_code AS code, count(*) AS rows,
             count(DISTINCT accession_number) AS filings FROM filings
           WHERE transaction_type = 'derivative' AND transaction_code IN ('P', 'S') GROUP BY ALL""")
def archive_columns(spark, d):
    """Two columns of one member, filtered while it is read; the other members are not opened."""
    folder, _ = _archives(spark, d)
    rows = archive_source.read(spark, folder, "ACCESSION_NUMBER string, TRANS_CODE string")
    chosen = rows.where((F.col("member") == "DERIV_TRANS") & F.col("TRANS_CODE").isin("P", "S"))
    return chosen.groupBy("member", F.col("TRANS_CODE").alias("code")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ACCESSION_NUMBER").alias("filings"))


@query("archive_inventory", "SRC-3 SRC-4",
       """SELECT unnest(['PART', 'WRONG', 'LONE']) AS kind, unnest(['COMPLETE', 'COMPLETE', 'INCOMPLETE']) AS status,
            unnest([true, false, false]) AS all_match, count(*) > 0 AS any_archive FROM orders""")
def archive_inventory(spark, d):
    folder, _ = _archives(spark, d)
    found = archives.inventory(archives.files(spark, folder))
    audited = archives.checksum_audit(spark, folder)
    return found.join(audited.select("period", "matches"), "period").groupBy(
        F.substring_index("period", "-", 1).alias("kind"), "status").agg(
        F.bool_and("matches").alias("all_match"), (F.count(F.lit(1)) > 0).alias("any_archive"))


# --- envelopes ----------------------------------------------------------------------------------

def _price_json(spark, d, **fields):
    """One JSON object per daily bar; its envelope follows from the volume."""
    bars = views.prices(spark, d)
    return bars.withColumn("item", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def _bar_item(spark, d):
    return _price_json(spark, d, symbol=F.col("symbol"), date=F.col("price_date").cast("string"), open=F.col("open"),
                       high=F.col("high"), low=F.col("low"), close=F.col("close"), volume=F.col("volume"))


@query("price_envelopes", "SRC-5",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol, price_date, 0 AS position, close FROM prices
           UNION ALL SELECT symbol, price_date, 1, NULL FROM prices WHERE volume >= 30""")
def price_envelopes(spark, d):
    item = F.col("item")
    body = F.when(F.col("volume") < 10, F.concat(F.lit("["), item, F.lit("]"))).when(
        F.col("volume") < 30, F.concat(F.lit('{"meta": 1, "results": ['), item, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"data": "none", "historical": ['), item, F.lit(", 17]}")))
    packed = _bar_item(spark, d).select("symbol", "price_date", body.alias("body"))
    out = envelopes.prices(packed, "body", ["symbol", "price_date"])
    return out.select("symbol", "price_date", "position", F.element_at("payload", "close").cast("double").alias("close"))


@query("provider_prices", "SRC-6",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol, CAST(price_date AS VARCHAR) AS price_date,
             CASE WHEN volume < 20 THEN open ELSE close END AS open, close, CAST(NULL AS DOUBLE) AS adjusted_close
           FROM prices WHERE volume < 45""")
def provider_prices(spark, d):
    given = F.col("volume") < 20
    items = _price_json(spark, d, date=F.col("price_date").cast("string"), open=F.when(given, F.col("open")),
                        adjOpen=F.col("close"), close=F.col("close"), adjClose=F.col("close"))
    body = F.when(F.col("volume") >= 45, F.lit('{"Error Message": "limit"}')).when(
        given, F.concat(F.lit("["), "item", F.lit("]"))).otherwise(
        F.concat(F.lit('{"message": "ok", "historical": ['), "item", F.lit("]}")))
    packed = items.select(F.lower("symbol").alias("asked"), body.alias("body"))
    out = envelopes.provider_prices(packed, "body", "asked")
    return out.select(*[F.element_at("payload", n).alias(n) for n in ("symbol", "price_date")], *[
        F.element_at("payload", n).cast("double").alias(n) for n in ("open", "close", "adjusted_close")])


@query("provider_errors", "SRC-6",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol AS asked, price_date,
             CASE WHEN volume < 10 THEN 'limit' WHEN volume < 20 THEN 'bad key' ELSE 'Status 404' END AS provider_error
           FROM prices WHERE volume < 30""")
def provider_errors(spark, d):
    v = F.col("volume")
    body = F.when(v < 10, F.lit('{"Error Message": "limit"}')).when(v < 20, F.lit('{"message": "bad key"}')).when(
        v < 30, F.lit('{"status": 404}')).otherwise(F.concat(F.lit('{"historical": ['), "item", F.lit("]}")))
    packed = _bar_item(spark, d).select(F.col("symbol").alias("asked"), "price_date", body.alias("body"))
    return envelopes.provider_errors(packed, "body")


@query("action_envelopes", "SRC-7 SRC-8 SRC-9",
       f"""WITH {views.LINES}, {views.PRICES} SELECT symbol, CAST(price_date AS VARCHAR) AS action_date,
             CASE WHEN volume < 20 THEN 'split' ELSE 'dividend' END AS action_type,
             CASE WHEN volume < 10 THEN '2:1' WHEN volume < 20 THEN '3:2' END AS ratio,
             CASE WHEN volume >= 30 THEN volume END AS cash_amount FROM prices""")
def action_envelopes(spark, d):
    v, day = F.col("volume"), F.col("price_date").cast("string")
    bars = views.prices(spark, d).withColumn("asked", F.lower("symbol"))
    split = F.when(v < 10, F.to_json(F.struct(day.alias("executionDate"), F.lit("2:1").alias("ratio")))).otherwise(
        F.to_json(F.struct(day.alias("date"), F.lit(3).alias("numerator"), F.lit(2).alias("denominator"))))
    cash = F.when(v < 30, F.concat(F.lit('{"paymentDate": "'), day, F.lit('", "dividend": null, "amount": 5}'))).otherwise(
        F.to_json(F.struct(day.alias("declarationDate"), v.alias("amount"))))
    splits = bars.where(v < 20).select("asked", F.concat(F.lit('{"splits": ['), split, F.lit("]}")).alias("body"))
    dividends = bars.where(v >= 20).select("asked", F.concat(F.lit("["), cash, F.lit("]")).alias("body"))
    both = envelopes.provider_splits(splits, "body", "asked").unionByName(
        envelopes.provider_dividends(dividends, "body", "asked"))
    # The mapped items travel in the loader's own envelope.
    packed = both.select(F.concat(F.lit('{"corporate_actions": ['), F.to_json("payload"), F.lit("]}")).alias("body"))
    again = envelopes.actions(packed, "body")
    return again.select(*[F.element_at("payload", n).alias(n) for n in ("symbol", "action_date", "action_type", "ratio")],
                        F.element_at("payload", "cash_amount").cast("double").alias("cash_amount"))


def _index_docs(spark, d):
    """Filing indexes per customer and quarter as JSON columns; the form column is one short when the
    first order is pending. Like the real ones a document is limited: it takes the rows of 5,000
    consecutive orders, so that a large customer has several."""
    heads = views.submissions(spark, d).withColumns({
        "document": F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")),
        "page": F.floor(F.col("o_orderkey") / 5000)})
    packed = heads.groupBy("o_custkey", "filing_period", "page").agg(F.array_sort(F.collect_list(F.struct(
        "o_orderkey", "accession_number", "filing_date", "form_type", "document", "o_orderstatus"))).alias("rows"))
    short = F.element_at("rows", 1)["o_orderstatus"] == "P"
    forms = F.when(short, F.slice("rows.form_type", 1, F.size("rows") - 1)).otherwise(F.col("rows.form_type"))
    columns = F.struct(
        F.col("rows.accession_number").alias("accessionNumber"), F.col("rows.filing_date").cast("array<string>").alias("filingDate"),
        forms.alias("form"), F.col("rows.document").alias("primaryDocument"))
    file = F.concat(F.lit(" CIK-"), F.col("o_custkey").cast("string"), F.lit(".json "))
    main = F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.struct(
        columns.alias("recent"), F.array(F.struct(file.alias("name"))).alias("files")).alias("filings")))
    # Continuation documents hold the columns at top level.
    late = F.col("filing_period") < "1998-Q1"
    return packed.select("o_custkey", "filing_period", "page", F.when(late, F.to_json(columns)).otherwise(main).alias("doc"))


INDEX = """indexed AS (SELECT *, row_number() OVER w - 1 AS position,
    row_number() OVER w = count(*) OVER (PARTITION BY o_custkey, filing_period, o_orderkey // 5000)
      AND first_value(o_orderstatus) OVER w = 'P' AS cut,
    'doc-' || o_orderkey AS document_name
  FROM submissions WINDOW w AS (PARTITION BY o_custkey, filing_period, o_orderkey // 5000 ORDER BY o_orderkey))"""


@query("filing_index_rows", "SRC-10",
       f"""WITH {views.SUBMISSIONS}, {INDEX} SELECT o_custkey, filing_period, o_orderkey // 5000 AS page, position, accession_number,
             CAST(filing_date AS VARCHAR) AS filing_date, CASE WHEN NOT cut THEN form_type END AS form_type, document_name
           FROM indexed""")
def filing_index_rows(spark, d):
    return filing_index.rows(_index_docs(spark, d), "doc").drop("error")


@query("continuation_files", "SRC-11",
       f"""WITH {views.SUBMISSIONS} SELECT DISTINCT o_custkey, filing_period, o_orderkey // 5000 AS page, 'CIK-' || o_custkey || '.json' AS file_name
           FROM submissions WHERE filing_period >= '1998-Q1'""")
def continuation_files(spark, d):
    return filing_index.continuation_files(_index_docs(spark, d), "doc").select(
        "o_custkey", "filing_period", "page", "file_name")


@query("first_insider_filings", "WN-4 SC-23",
       f"""WITH {views.SUBMISSIONS}, {INDEX} SELECT accession_number, document_name, filing_period, form_type FROM indexed
           WHERE NOT cut""")
def first_insider_filings(spark, d):
    rows = filing_index.rows(_index_docs(spark, d), "doc")
    # Every row once more under a later quarter.
    twice = rows.withColumn("filing_period", F.explode(F.array("filing_period", F.lit("9999-Q4"))))
    return filing_index.insider_filings(twice, ["filing_period", "position"]).select(
        "accession_number", "document_name", "filing_period", "form_type")


@query("company_map", "SRC-12",
       """SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_acctbal >= 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0')
            ELSE 'x' || s_suppkey END AS cik, 'T' || s_suppkey AS ticker, s_name AS title,
            CASE WHEN s_acctbal < 0 THEN 'CIK must contain digits only.' END AS error FROM supplier""")
def company_map(spark, d):
    good = F.col("s_acctbal") >= 0
    key = F.col("s_suppkey").cast("string")
    entry = F.when(good, F.to_json(F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("t"), key).alias("ticker"),
                                            F.col("s_name").alias("title")))).otherwise(
        F.to_json(F.struct(F.concat(F.lit("x"), key).alias("cik"), F.concat(F.lit("T"), key).alias("ticker"),
                           F.col("s_name").alias("title"))))
    doc = F.concat(F.lit('{"'), key, F.lit('": '), entry, F.lit(', "note": "text"}'))
    return envelopes.companies(views.table(spark, d, "supplier").select(doc.alias("doc")), "doc")


CUT_XML = "<ownershipDocument><documentType>4</documentType><nonDerivativeTable>"


@query("unreadable_documents", "SRC-5 SRC-7 SRC-10 SRC-12 SRC-13",
       f"""WITH {views.SUBMISSIONS}, n AS (SELECT o_orderstatus AS s, count(*) AS rows FROM submissions GROUP BY ALL)
           SELECT kind, CASE WHEN s = 'F' THEN NULL WHEN s = 'O' AND kind IN ('prices', 'actions')
               THEN label || ' response does not contain a supported record list.' ELSE broken END AS error, sum(rows) AS rows
           FROM n, (VALUES ('prices', 'Market-data', 'Market-data response must be a list or mapping.'),
             ('actions', 'Corporate-actions', 'Corporate-actions response must be a list or mapping.'),
             ('index', '', 'Filing index is not a JSON object.'), ('companies', '', 'Company map must be a mapping.'),
             ('ownership', '', 'Ownership document cannot be read.')) k(kind, label, broken) GROUP BY ALL""")
def unreadable_documents(spark, d):
    """Good documents of finished orders among bad ones: none is lost, and none stops the others."""
    heads = views.submissions(spark, d)
    status = F.col("o_orderstatus")

    def given(good, other, cut):
        return heads.select("o_orderkey", F.when(status == "F", F.lit(good)).when(status == "O", F.lit(other)).otherwise(
            F.lit(cut)).alias("doc"))

    listed = given('[{"symbol": "A"}]', '{"none": 1}', '{"data": [')
    index = json.dumps({k: ["x"] for k in filing_index.REQUIRED})
    company = json.dumps({"0": {"cik_str": 1, "ticker": "a", "title": "A"}})
    xml = f"{CUT_XML}<nonDerivativeTransaction><securityTitle><value>x</value></securityTitle></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    parsed = ownership.parse_xml(given(xml, CUT_XML, "no document at all"), "doc")
    found = {
        "prices": envelopes.prices(listed, "doc", strict=False).select("error"),
        "actions": envelopes.actions(listed, "doc", strict=False).select("error"),
        "index": filing_index.rows(given(index, "[1]", index[:20]), "doc").select("error"),
        "companies": envelopes.companies(given(company, "[1]", company[:20]), "doc").select("error"),
        "ownership": ownership.xml_transactions(parsed, ["o_orderkey"]).select(F.col("document_error").alias("error")),
    }
    out = None
    for kind, rows in found.items():
        counted = rows.groupBy("error").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(kind))
        out = counted if out is None else out.unionByName(counted)
    return out.select("kind", "error", "rows")


@query("historical_records", "SRC-16",
       f"""WITH {views.SUBMISSIONS} SELECT accession_number, CAST(filing_date AS VARCHAR) AS filing_date, form_type,
             CAST(o_custkey AS VARCHAR) AS issuer_cik, 'Issuer' AS issuer_name FROM submissions""")
def historical_records(spark, d):
    item = F.to_json(F.struct(
        F.col("accession_number").alias("accession"), F.col("filing_date").cast("string").alias("filed"),
        F.col("form_type").alias("form"), F.col("o_custkey").alias("cik"), F.lit(" Issuer ").alias("companyName")))
    status = F.col("o_orderstatus")
    body = F.when(status == "F", F.concat(F.lit("["), item, F.lit("]"))).when(
        status == "O", F.concat(F.lit('{"recent": ['), item, F.lit("]}"))).otherwise(item)
    rows = envelopes.historical(views.submissions(spark, d).select(body.alias("body")), "body")
    return normalize.historical_records(rows, normalize.from_map())


def _xml_docs(spark, d):
    """One ownership document per line item, derivative or not, with values nested or direct."""
    def tag(name, c, nested=True):
        inner = F.concat(F.lit("<value>"), c.cast("string"), F.lit("</value>")) if nested else c.cast("string")
        return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))

    direct = F.col("transaction_code") == "R"
    shares = F.when(direct, tag("transactionShares", F.col("shares"), False)).otherwise(
        tag("transactionShares", F.format_number("shares", 1)))
    body = F.concat(
        tag("securityTitle", F.lit("Common Stock")), tag("transactionDate", F.col("transaction_date")),
        F.lit("<transactionCoding><transactionFormType>4</transactionFormType>"),
        tag("transactionCode", F.col("transaction_code"), False), F.lit("</transactionCoding><transactionAmounts>"), shares,
        tag("transactionPricePerShare", F.lit("25.50")), F.lit("</transactionAmounts><ownershipNature>"),
        tag("directOrIndirectOwnership", F.col("ownership_type")), F.lit("</ownershipNature>"))
    derivative = F.col("transaction_type") == "derivative"
    table = F.when(derivative, F.concat(F.lit("<derivativeTable><derivativeTransaction>"), body,
                                        F.lit("</derivativeTransaction></derivativeTable>"))).otherwise(
        F.concat(F.lit("<nonDerivativeTable><nonDerivativeTransaction>"), body,
                 F.lit("</nonDerivativeTransaction><nonDerivativeTransaction>"), body,
                 F.lit("</nonDerivativeTransaction></nonDerivativeTable>")))
    doc = F.concat(
        F.lit("<ownershipDocument><documentType>4</documentType><issuer><issuerName>Issuer</issuerName></issuer>"
              "<reportingOwner><rptOwnerName>"), "insider_name", F.lit("</rptOwnerName><rptOwnerCik>"), "insider_cik",
        F.lit("</rptOwnerCik></reportingOwner>"), table, F.lit("</ownershipDocument>"))
    return views.filings(spark, d).select(
        "accession_number", F.col("transaction_key").alias("document_name"), "issuer_cik",
        F.col("filing_date").cast("string").alias("filing_date"), "form_type", doc.alias("doc"))


DOCS = """SELECT accession_number, transaction_key AS document_name, position, transaction_code,
  CAST(transaction_date AS VARCHAR) AS transaction_date, shares, 25.5 AS price, ownership_type, insider_name, insider_cik,
  form_type, issuer_cik FROM filings, (SELECT unnest([0, 1]) AS position)
  WHERE position = 0 OR transaction_type = 'non_derivative'"""
DOC_COLUMNS = ["accession_number", "document_name", "position", "transaction_code", "transaction_date", "shares", "price",
               "ownership_type", "insider_name", "insider_cik", "form_type", "issuer_cik"]


@query("ownership_xml", "SRC-13 SC-7", f"WITH {views.FILINGS} {DOCS}")
def ownership_xml(spark, d):
    docs = ownership.parse_xml(_xml_docs(spark, d), "doc")
    keep = ["accession_number", "document_name", "issuer_cik", "filing_date", "form_type"]
    return ownership.typed(ownership.xml_transactions(docs, keep)).select(*DOC_COLUMNS)


@query("ownership_json", "SRC-14 SRC-15",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key AS document_name, transaction_code,
             CAST(transaction_date AS VARCHAR) AS transaction_date, shares, price, insider_name,
             CASE WHEN transaction_code = 'S' THEN '5' ELSE form_type END AS form_type FROM filings""")
def ownership_json(spark, d):
    code = F.col("transaction_code")
    rows = views.filings(spark, d)
    nested = F.struct(
        F.struct(F.struct(code.alias("value")).alias("transactionCode")).alias("transactionCoding"),
        F.struct(F.col("transaction_date").cast("string").alias("value")).alias("transactionDate"),
        F.struct(F.struct(F.col("shares").alias("value")).alias("transactionShares"),
                 F.col("price").alias("transactionPricePerShare")).alias("transactionAmounts"))
    flat = F.struct(code.alias("code"), F.col("transaction_date").cast("string").alias("date"), F.col("shares"),
                    F.col("price").alias("transaction_price"))
    owner = F.struct(F.col("insider_name").alias("rptOwnerName")).alias("reportingOwner")
    doc = F.when(code == "P", F.to_json(F.struct(owner, F.struct(nested.alias("nonDerivativeTransaction")).alias(
        "nonDerivativeTable")))).when(
        code == "S", F.to_json(F.struct(F.lit("5").alias("form"), owner, F.array(flat).alias("transactions")))).otherwise(
        F.to_json(F.struct(owner, F.struct(F.array(flat).alias("items")).alias("derivativeTransactions"))))
    docs = rows.select("accession_number", F.col("transaction_key").alias("document_name"), "issuer_cik", "form_type",
                       F.col("filing_date").cast("string").alias("filing_date"), doc.alias("doc"))
    known = ownership.json_metadata(docs, "doc", "form_type", "accession_number", "filing_date")
    keep = ["accession_number", "document_name", "issuer_cik", "form_type", "filing_date"]
    return ownership.typed(ownership.json_transactions(known, "doc", keep)).select(
        "accession_number", "document_name", "transaction_code", "transaction_date", "shares", "price", "insider_name",
        "form_type")


@query("filing_history", "OP-15",
       f"""WITH {views.FILINGS} SELECT accession_number, transaction_key, shares, CAST(NULL AS VARCHAR) AS error FROM (
             SELECT *, unnest(CASE WHEN transaction_type = 'derivative' THEN [0] ELSE [0, 1] END) AS position FROM filings)
           UNION ALL SELECT accession_number, NULL, NULL, 'Filing contains no identifiable insider transactions.'
           FROM submissions WHERE accession_number NOT IN (SELECT accession_number FROM filings)""")
def filing_history(spark, d):
    docs = _xml_docs(spark, d)
    index = views.submissions(spark, d).select(
        "accession_number", F.lit("doc.xml").alias("document_name"), "form_type", F.col("o_custkey").cast("string").alias("issuer_cik"),
        F.col("filing_date").cast("string").alias("filing_date"), F.lit("Title").alias("company_title"),
        F.col("o_orderkey").alias("position_in_source"))

    # The key of the line travels as the security title.
    def titled(table, rows):
        return F.col(table).withField(rows, F.transform(f"{table}.{rows}", lambda t: t.withField(
            "securityTitle.value", F.col("document_name"))))

    keyed = ownership.parse_xml(docs, "doc").withColumns({
        "derivativeTable": titled("derivativeTable", "derivativeTransaction"),
        "nonDerivativeTable": titled("nonDerivativeTable", "nonDerivativeTransaction"),
    }).withColumn("document_name", F.lit("doc.xml"))
    return filings.history(index, keyed, ["position_in_source"]).select(
        "accession_number", F.col("security_title").alias("transaction_key"), "shares", "error")


# --- loads and sinks ----------------------------------------------------------------------------

def _price_records(spark, d, returned: bool):
    """Line items as price payloads: the returned ones first, then all of them."""
    rows = views.lines(spark, d)
    if returned:
        rows = rows.where(F.col("l_returnflag") == "R")
    position = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "px")
    payload = F.when(F.col("l_tax") < 0.08, _cells(
        symbol=F.concat(F.lit("p"), F.col("l_partkey").cast("string")), date=F.date_format("ship_date", "yyyy-MM-dd"),
        open=F.col("px"), high=F.when(F.col("l_discount") > 0, F.col("px")).otherwise(F.col("px") / 2), low=F.col("px"),
        close=F.col("px"), volume=F.col("l_quantity")))
    return rows.select(position.alias("index"), payload.alias("payload"))


LOAD = f"""{views.LINES}, judged AS (SELECT *, l_tax < 0.08 AND l_discount > 0 AS good,
    (l_orderkey, l_linenumber, l_suppkey, l_quantity, px) AS i FROM lines),
stored AS (SELECT l_partkey, ship_date, arg_min(px, i) AS px, arg_min(l_quantity, i) AS qty, min(i) AS i FROM judged
  WHERE good AND l_returnflag = 'R' GROUP BY ALL),
firsts AS (SELECT l_partkey, ship_date, arg_min(px, i) AS px, arg_min(l_quantity, i) AS qty, min(i) AS i FROM judged
  WHERE good GROUP BY ALL),
first_run AS (SELECT 1 AS run, CASE WHEN NOT good THEN 'REJECTED' WHEN j.i = s.i THEN 'INSERTED'
    WHEN j.px = s.px AND j.l_quantity = s.qty THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome, j.l_partkey
  FROM judged j LEFT JOIN stored s ON s.l_partkey = j.l_partkey AND s.ship_date = j.ship_date WHERE l_returnflag = 'R'),
second_run AS (SELECT 2 AS run, CASE WHEN NOT good THEN 'REJECTED' WHEN s.i IS NULL AND j.i = f.i THEN 'INSERTED'
    WHEN j.px = coalesce(s.px, f.px) AND j.l_quantity = coalesce(s.qty, f.qty) THEN 'DUPLICATE' ELSE 'CONFLICT' END
    AS outcome, j.l_partkey
  FROM judged j LEFT JOIN stored s ON s.l_partkey = j.l_partkey AND s.ship_date = j.ship_date
  LEFT JOIN firsts f ON f.l_partkey = j.l_partkey AND f.ship_date = j.ship_date)"""


def _two_loads(spark, d):
    path = fresh_dir(spark, "market_prices")
    first = loads.load_prices(spark, _price_records(spark, d, True), path, "EOD", STAMP)
    second = loads.load_prices(spark, _price_records(spark, d, False), path, "EOD", STAMP)
    return path, first, second


@query("price_load_outcomes", "OP-12 OP-14 SNK-3 JN-5",
       f"""WITH {LOAD} SELECT run, outcome, count(*) AS rows FROM (SELECT * FROM first_run UNION ALL
             SELECT * FROM second_run) GROUP BY ALL""")
def price_load_outcomes(spark, d):
    _, first, second = _two_loads(spark, d)
    return sinks.outcome_counts(first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))), ["run"])


PRICE_ACCOUNTING = f"""WITH {LOAD}, c AS (SELECT CASE WHEN outcome = 'REJECTED' AND NOT known THEN 'UNMAPPED'
               ELSE 'P' || CAST(l_partkey AS VARCHAR) END AS symbol, outcome FROM (
             SELECT 2 AS run, CASE WHEN NOT good THEN 'REJECTED' WHEN s.i IS NULL AND j.i = f.i THEN 'INSERTED'
               WHEN j.px = coalesce(s.px, f.px) AND j.l_quantity = coalesce(s.qty, f.qty) THEN 'DUPLICATE'
               ELSE 'CONFLICT' END AS outcome, j.l_partkey, j.l_tax < 0.08 AS known
             FROM judged j LEFT JOIN stored s ON s.l_partkey = j.l_partkey AND s.ship_date = j.ship_date
             LEFT JOIN firsts f ON f.l_partkey = j.l_partkey AND f.ship_date = j.ship_date)),
           n AS (SELECT symbol, symbol <> 'UNMAPPED' AS requested, count(*) AS received,
             count(*) FILTER (outcome = 'INSERTED') AS inserted, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate,
             count(*) FILTER (outcome = 'REJECTED') AS rejected, count(*) FILTER (outcome = 'CONFLICT') AS conflict
             FROM c GROUP BY ALL),
           asked AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol FROM part UNION SELECT 'UNMAPPED' FROM c
             WHERE symbol = 'UNMAPPED')
           SELECT a.symbol, a.symbol <> 'UNMAPPED' AS requested, coalesce(received, 0) AS received, coalesce(inserted, 0) AS inserted,
             coalesce(duplicate, 0) AS duplicate, coalesce(rejected, 0) AS rejected, coalesce(conflict, 0) AS conflict,
             true AS balanced, CASE WHEN a.symbol = 'UNMAPPED' THEN 'FAILED' WHEN received > 0 AND conflict = 0 THEN 'SUCCESS'
               WHEN inserted > 0 OR duplicate > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status
           FROM asked a LEFT JOIN n ON n.symbol = a.symbol"""


@query("price_load_accounting", "AGG-10 AGG-11", PRICE_ACCOUNTING)
def price_load_accounting(spark, d):
    _, _, second = _two_loads(spark, d)
    counts = accounting.by_symbol(second, _parts(spark, d)).withColumn("provider_failures", F.lit(0))
    return accounting.price_status(counts).select(
        "symbol", "requested", "received", "inserted", "duplicate", "rejected", "conflict", "balanced", "status")


@query("price_load_totals", "AGG-10 AGG-12",
       f"""SELECT count(*) FILTER (requested) AS requested_symbols, count(*) FILTER (requested AND status = 'SUCCESS')
             AS successful_symbols, count(*) FILTER (requested AND status <> 'SUCCESS') AS failed_symbols,
             CAST(sum(received) AS BIGINT) AS received, CAST(sum(inserted) AS BIGINT) AS inserted,
             CAST(sum(duplicate) AS BIGINT) AS duplicate, CAST(sum(rejected) AS BIGINT) AS rejected,
             CAST(sum(conflict) AS BIGINT) AS conflict, CAST(0 AS BIGINT) AS failed, bool_and(balanced) AS balanced
           FROM ({PRICE_ACCOUNTING})""")
def price_load_totals(spark, d):
    _, _, second = _two_loads(spark, d)
    counts = accounting.by_symbol(second, _parts(spark, d)).withColumn("provider_failures", F.lit(0))
    return accounting.totals(accounting.price_status(counts))


@query("quarter_totals", "AGG-13",
       f"""WITH {views.FILINGS}, {views.STATE} SELECT count(*) AS periods, CAST(sum(records_parsed) AS BIGINT) AS records_parsed,
             CAST(sum(records_inserted) AS BIGINT) AS records_inserted, CAST(sum(duplicates_count) AS BIGINT) AS duplicates_count,
             CAST(sum(invalid_count) AS BIGINT) AS invalid_count, CAST(sum(failures_count) AS BIGINT) AS failures_count
           FROM state""")
def quarter_totals(spark, d):
    return accounting.run_totals(views.state(spark, d))


@query("unmapped_records", "OP-14 SET-4",
       f"""WITH {views.LINES} SELECT l_tax < 0.08 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AS mapped,
             count(*) AS rows FROM lines GROUP BY ALL""")
def unmapped_records(spark, d):
    """Records of symbols that were asked for (even parts), and all others."""
    asked = _parts(spark, d).where("cast(substring(symbol, 2) AS bigint) % 2 = 0")
    return loads.split_unmapped(_price_records(spark, d, False), asked).groupBy("mapped").agg(
        F.count(F.lit(1)).alias("rows"))


def _parts(spark, d):
    return views.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))


@query("stored_prices", "SNK-3 SRC-17 DQ-3",
       f"""WITH {LOAD} SELECT 'P' || CAST(f.l_partkey AS VARCHAR) AS symbol, f.ship_date AS price_date,
             coalesce(s.px, f.px) AS close, coalesce(s.qty, f.qty) AS volume
           FROM firsts f LEFT JOIN stored s ON s.l_partkey = f.l_partkey AND s.ship_date = f.ship_date""")
def stored_prices(spark, d):
    path, _, _ = _two_loads(spark, d)
    return schemas.read(spark, schemas.MARKET_PRICES, path).select("symbol", "price_date", "close", "volume")


@query("streamed_prices", "STR-1",
       f"""WITH {views.LINES} SELECT count(DISTINCT (l_partkey, ship_date)) AS stored,
             count(*) - count(DISTINCT (l_partkey, ship_date)) AS repeated, count(*) AS received FROM lines""")
def streamed_prices(spark, d):
    root = fresh_dir(spark, "stream")
    rows = views.lines(spark, d)
    payload = _cells(symbol=F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
                     date=F.date_format("ship_date", "yyyy-MM-dd"), close=F.lit(1.0))
    index = F.xxhash64(*rows.columns)
    rows.select(index.alias("index"), payload.alias("payload")).repartition(2).write.json(f"{root}/in")
    # The second run finds nothing new: finished files are known to the checkpoint.
    for _ in range(2):
        stream.land_prices(spark, f"{root}/in", schemas.MARKET_PRICES, f"{root}/table", f"{root}/outcomes",
                           f"{root}/checkpoint", "EOD", STAMP, files_per_batch=1).awaitTermination()
    done = spark.read.parquet(f"{root}/outcomes")
    stored = schemas.read(spark, schemas.MARKET_PRICES, f"{root}/table").agg(F.count(F.lit(1)))
    return done.agg(F.count_if(F.col("outcome") == "DUPLICATE").alias("repeated"),
                    F.count(F.lit(1)).alias("received")).withColumn("stored", stored.scalar())


@query("streamed_quarters", "STR-1 FLT-9 SNK-1 SNK-6 AGG-13 JN-4",
       f"""WITH {views.FILINGS}, v AS (SELECT filing_period AS period, transaction_date - filing_date <= 365
             AND transaction_code <> 'R' AS good, record_hash, o_orderkey % 2 = 0 OR filing_period < '1996-Q1' AS early FROM filings),
           q AS (SELECT period, count(*) AS n, count(*) FILTER (early) >= count(*) AS closed FROM v GROUP BY ALL),
           r AS (SELECT v.* FROM v WHERE early
             UNION ALL SELECT v.* FROM v JOIN q ON q.period = v.period WHERE v.period >= '1995-Q3' AND NOT closed)
           SELECT r.period, CASE WHEN count(*) >= any_value(q.n) THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, count(*) AS records_parsed,
             count(DISTINCT record_hash) FILTER (good) AS records_inserted,
             count(*) FILTER (good) - count(DISTINCT record_hash) FILTER (good) AS duplicates_count,
             count(*) FILTER (NOT good) AS invalid_count, count(DISTINCT record_hash) FILTER (good) AS stored
           FROM r JOIN q ON q.period = r.period GROUP BY r.period""")
def streamed_quarters(spark, d):
    """Quarters that land in two deliveries. The first completes those before 1996 and half of the others; the second
    brings all rows since mid 1995 once more, of which the completed quarters are skipped."""
    root = fresh_dir(spark, "quarters")
    parsed = stage(filings.stored_layout(sections(spark, d)), "parsed")
    manifest = parsed.groupBy(F.col("filing_period").alias("period")).agg(F.count(F.lit(1)).alias("rows"))
    order = F.substring_index("accession_number", "-", -1).cast("bigint")
    deliveries = [parsed.where((order % 2 == 0) | (F.col("filing_period") < "1996-Q1")), parsed.where(F.col("filing_period") >= "1995-Q3")]
    for number, rows in enumerate(deliveries):
        dealt = hashing.unpacked(hashing.packed(rows, "record_hash").repartition(4, "accession_number"), "record_hash")
        dealt.select(*parsed.columns).write.mode("append").option("compression", "zstd").partitionBy("filing_period").parquet(f"{root}/in")
        quarters.land(spark, f"{root}/in", parsed.schema, lambda x: filings.judged(x, "2001-Q4", 10), schemas.INSIDER_TRANSACTIONS,
                      f"{root}/table", f"{root}/outcomes", f"{root}/checkpoint", STAMP,
                      skip=quarters.done_quarters(spark, f"{root}/state")).awaitTermination()
        quarters.record_quarters(spark, f"{root}/outcomes", manifest, f"{root}/state", STAMP + datetime.timedelta(days=number), number)
    stored = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, f"{root}/table").groupBy(F.col("filing_period").alias("period")).agg(
        F.count(F.lit(1)).alias("stored"))
    state = changes.current(spark, schemas.INGESTION_STATE, f"{root}/state", "completed_at")
    return state.drop("failures_count", "completed_at").join(stored, "period", "left")


def _action_records(spark, d, kind):
    return views.lines(spark, d).select(
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "px").alias("index"),
        F.when(F.col("l_tax") < 0.08, _cells(
            ticker=F.concat(F.lit("p"), F.col("l_partkey").cast("string")), type=F.lit(kind),
            date=F.date_format(F.date_trunc("month", "ship_date"), "yyyy-MM-dd"),
            amount=F.col("l_linenumber") - 1)).alias("payload"))


@query("action_load_accounting", "OP-13 SNK-4 AGG-12",
       f"""WITH {views.LINES}, j AS (SELECT *, date_trunc('month', ship_date) AS m, l_tax < 0.08 AS good,
             (l_orderkey, l_linenumber, l_suppkey, l_quantity, px) AS i FROM lines),
           f AS (SELECT l_partkey, m, min(i) AS i, arg_min(l_linenumber, i) AS n FROM j WHERE good GROUP BY ALL),
           o AS (SELECT CASE WHEN good THEN 'P' || CAST(j.l_partkey AS VARCHAR) ELSE 'UNMAPPED' END AS symbol,
             CASE WHEN NOT good THEN 'REJECTED' WHEN j.l_linenumber = f.n THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome
             FROM j LEFT JOIN f ON f.l_partkey = j.l_partkey AND f.m = j.m),
           n AS (SELECT symbol, count(*) AS received, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate,
             count(*) FILTER (outcome = 'CONFLICT') AS conflict, count(*) FILTER (outcome = 'REJECTED') AS rejected
             FROM o GROUP BY ALL)
           SELECT symbol, received, duplicate, conflict, rejected, CASE WHEN conflict + rejected = 0 THEN 'SUCCESS'
             WHEN duplicate > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM n""")
def action_load_accounting(spark, d):
    path = fresh_dir(spark, "corporate_actions")
    loads.load_actions(spark, _action_records(spark, d, "Dividend"), path, "Feed", STAMP)
    # The same delivery again, its type written differently: identity is in lower case.
    second = loads.load_actions(spark, _action_records(spark, d, "dividend "), path, "FEED", STAMP)
    wanted = views.lines(spark, d).where(F.col("l_tax") < 0.08).select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"))
    counts = accounting.by_symbol(second, wanted).withColumn("provider_failures", F.lit(0))
    return accounting.action_status(counts).select("symbol", "received", "duplicate", "conflict", "rejected", "status")


@query("quarter_load", "SNK-1 SNK-9 AGG-13 JN-4 OP-14",
       f"""WITH {views.FILINGS}, v AS (SELECT filing_period, transaction_date - filing_date <= 365
             AND transaction_code <> 'R' AS good, record_hash, filing_period >= '1999-Q1' AS kept FROM filings),
           r AS (SELECT unnest([1, 2]) AS run)
       SELECT run, filing_period AS period, count(*) AS records_parsed,
         count(DISTINCT record_hash) FILTER (good AND kept AND run = 1) AS records_inserted,
         count(*) FILTER (good AND kept) - count(DISTINCT record_hash) FILTER (good AND kept AND run = 1)
           AS duplicates_count, count(*) FILTER (NOT good) AS invalid_count FROM v, r GROUP BY ALL""")
def quarter_load(spark, d):
    path = fresh_dir(spark, "insider_transactions")
    landed = sections(spark, d)
    stats = []
    for run in (1, 2):
        done = filings.load_quarters(spark, landed, path, STAMP, "2001-Q4", 3)
        stats.append(accounting.quarter_stats(done).withColumn("run", F.lit(run)))
    return stats[0].unionByName(stats[1]).drop("failures_count")


PROFILED = f"""{views.FILINGS}, p AS (SELECT filing_period AS period, count(DISTINCT record_hash) AS rows,
             min(transaction_date) AS earliest_transaction, max(transaction_date) AS latest_transaction,
             count(DISTINCT accession_number) AS distinct_accessions, count(DISTINCT record_hash) AS distinct_hashes FROM filings
           WHERE filing_period >= '1999-Q1' AND transaction_date - filing_date <= 365 AND transaction_code <> 'R' GROUP BY ALL)"""


def _profiled(spark, d):
    """Two loads: all but some filings of 2000, then everything. Profiles are renewed for the quarters each one changed."""
    path, log = fresh_dir(spark, "insider_transactions"), fresh_dir(spark, "quarter_profiles")
    landed = sections(spark, d)
    order = F.substring_index(F.element_at("cells", "ACCESSION_NUMBER"), "-", -1).cast("bigint")
    late = F.col("filing_period").startswith("2000") & (order % 3 == 0)
    for number, rows in enumerate((landed.where(~late), landed)):
        done = filings.load_quarters(spark, rows, path, STAMP, "2001-Q4", 3)
        profiles.refresh(spark, done, path, log, STAMP + datetime.timedelta(days=number), number)
    return log


@query("quarter_profiles", "AGG-14 AGG-13", f"WITH {PROFILED} SELECT * FROM p")
def quarter_profiles(spark, d):
    return profiles.current(spark, _profiled(spark, d)).drop("profiled_at")


@query("profile_totals", "AGG-15 AGG-22",
       f"""WITH {PROFILED}, a AS (SELECT CAST(y AS VARCHAR) || '-Q' || CAST(q AS VARCHAR) AS period
             FROM range(1998, 2001) t(y), range(1, 5) u(q))
           SELECT count(*) AS periods_requested, count(rows) AS periods_with_rows, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows,
             min(earliest_transaction) AS earliest_transaction, max(latest_transaction) AS latest_transaction
           FROM a LEFT JOIN p ON p.period = a.period""")
def profile_totals(spark, d):
    """Totals of three years of quarters, from a row a quarter."""
    return profiles.totals(profiles.current(spark, _profiled(spark, d)), access.quarters(spark, "1998-Q1", "2000-Q4"))


@query("single_inserts", "SNK-2 OP-14",
       f"""WITH {views.LINES}, k AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lines)
           SELECT 1 AS run, 'INSERTED' AS outcome, (SELECT count(*) FROM k) AS rows
           UNION ALL SELECT 1, 'DUPLICATE', count(*) - (SELECT count(*) FROM k) FROM lines
           UNION ALL SELECT 2, 'DUPLICATE', count(*) FROM lines""")
def single_inserts(spark, d):
    path = fresh_dir(spark, "insider_transactions")
    rows = views.lines(spark, d)
    payload = _cells(accession=F.col("l_orderkey"), cik=F.col("l_linenumber"), shares=F.col("l_quantity"))
    records = rows.select(F.xxhash64(*rows.columns).alias("index"), payload.alias("payload"))
    done = [loads.load_insider(spark, records, path, "SEC", STAMP).withColumn("run", F.lit(run)) for run in (1, 2)]
    return sinks.outcome_counts(done[0].unionByName(done[1]), ["run"])


@query("provenance_upsert", "SNK-5 OP-14",
       f"""WITH {views.SUBMISSIONS}, n AS (SELECT o_custkey, arg_max(o_orderkey || '', (filing_date, o_orderkey)) AS checksum
             FROM submissions GROUP BY ALL)
           SELECT step, 'order' AS record_type, CAST(o_custkey AS VARCHAR) AS record_id, 'SEC' AS source, checksum
           FROM n, (SELECT unnest(['log', 'compacted']) AS step)
           UNION ALL SELECT 'key', 'order', CAST(o_custkey AS VARCHAR), 'SEC', checksum FROM n WHERE o_custkey = 7""")
def provenance_upsert(spark, d):
    """A delivery a year, last year first: the newest row of a key counts, before and after ranges are merged."""
    heads = views.submissions(spark, d)
    rows = heads.select(
        F.lit("order").alias("record_type"), F.col("o_custkey").cast("string").alias("record_id"), F.lit("SEC").alias("source"),
        F.col("o_orderkey").cast("string").alias("checksum"), "filing_date", "o_orderkey")
    # Of a key's rows of one day the largest order is the right one; it is written last.
    days = sinks.latest(rows, [*schemas.PROVENANCE.key, "filing_date"], ["o_orderkey"])
    shaped = stage(days.withColumns({"retrieved_at": F.col("filing_date").cast("timestamp"), "validation_status": F.lit("validated")}),
                   "deliveries")
    path = fresh_dir(spark, "provenance")
    for delivery, (first, last) in enumerate((("1997-01-01", "9999-01-01"), ("1995-01-01", "1997-01-01"), ("0001-01-01", "1995-01-01"))):
        changes.upsert(shaped.where(F.col("filing_date").between(F.lit(first).cast("date"), F.date_sub(F.lit(last).cast("date"), 1))).drop(
            "filing_date", "o_orderkey"), schemas.PROVENANCE, path, "retrieved_at", delivery)

    def read(step, *key):
        found = changes.current(spark, schemas.PROVENANCE, path, "retrieved_at", key)
        return stage(found.select(F.lit(step).alias("step"), *schemas.PROVENANCE.key, "checksum"), "provenance-read")

    before = read("log")
    changes.compact(spark, schemas.PROVENANCE, path, "retrieved_at", least_files=2)
    return before.unionByName(read("compacted")).unionByName(read("key", "order", "7", "SEC"))


@query("state_upsert", "SNK-6",
       f"""WITH {views.FILINGS}, {views.STATE} SELECT step, period, CASE WHEN step = 1 THEN status ELSE 'COMPLETED' END AS status,
             records_parsed FROM state, (SELECT unnest([1, 2, 3]) AS step)""")
def state_upsert(spark, d):
    """Every quarter's state, then all of them completed, then the merged log."""
    state, path = views.state(spark, d), fresh_dir(spark, "ingestion_state")

    def read(step):
        found = changes.current(spark, schemas.INGESTION_STATE, path, "completed_at")
        return stage(found.select(F.lit(step).alias("step"), "period", "status", "records_parsed"), "state-read")

    changes.upsert(state.withColumn("completed_at", F.lit(STAMP)), schemas.INGESTION_STATE, path, "completed_at", 1)
    first = read(1)
    again = state.withColumns({"status": F.lit("COMPLETED"), "completed_at": F.lit(STAMP)})
    changes.upsert(again, schemas.INGESTION_STATE, path, "completed_at", 2)
    second = read(2)
    changes.compact(spark, schemas.INGESTION_STATE, path, "completed_at", least_files=2)
    return first.unionByName(second).unionByName(read(3))


@query("signal_inserts", "SNK-8 SNK-7 SNK-11",
       f"""WITH {views.SUBMISSIONS}, {views.SIGNALS}, k AS (SELECT count(DISTINCT signal_key) AS n, count(*) AS a FROM signals)
           SELECT 1 AS run, 'INSERTED' AS outcome, n AS rows FROM k UNION ALL SELECT 1, 'DUPLICATE', a - n FROM k
           UNION ALL SELECT 2, 'DUPLICATE', a FROM k""")
def signal_inserts(spark, d):
    path = fresh_dir(spark, "signals")
    rows = views.signals(spark, d)
    done = [sinks.store(spark, rows, schemas.SIGNALS, path, "input_index", STAMP).withColumn("run", F.lit(run))
            for run in (1, 2)]
    return sinks.outcome_counts(done[0].unionByName(done[1]), ["run"])


@query("provenance_cleanup", "SNK-10",
       f"""WITH {views.FILINGS}, {views.STATE}, {views.ARCHIVES}, {views.PRICES}, {views.PROVENANCE},
           missing AS (SELECT count(*) AS n FROM state WHERE status = 'COMPLETED' AND period NOT IN (SELECT record_id
             FROM provenance WHERE record_type = 'dataset_period')),
           c AS (SELECT count(*) FILTER (record_type = 'insider_transaction') AS removed,
             count(*) FILTER (record_type <> 'insider_transaction') AS kept,
             count(*) FILTER (record_type = 'dataset_period') AS protected FROM provenance)
           SELECT 'as given' AS provenance, removed, kept, protected, n = 0 AS executed,
             CASE WHEN n = 0 THEN kept END AS left_over FROM c, missing
           UNION ALL SELECT 'completed', removed, kept + n, protected + n, true, kept + n FROM c, missing""")
def provenance_cleanup(spark, d):
    """The guard's audit decides: quarters without dataset provenance forbid the clean-up, completed ones allow it."""
    given, state, rows = views.provenance(spark, d), views.state(spark, d), views.filings(spark, d)
    added = audit.missing_dataset_provenance(state, given).select(
        F.lit("dataset_period").alias("record_type"), F.col("period").alias("record_id"), F.lit("SEC").alias("source"),
        F.lit(None).cast("string").alias("source_reference"), F.sha2("period", 256).alias("checksum"),
        F.lit("validated").alias("validation_status"))
    out = None
    for name, provenance in (("as given", given), ("completed", given.unionByName(added))):
        path = fresh_dir(spark, "provenance")
        safety = audit.provenance_safety(provenance, state, rows)
        try:
            counts = sinks.cleanup_provenance(spark, provenance, safety, path, execute=True)
            left = spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
        except sinks.CleanupRefused:
            counts = sinks.cleanup_provenance(spark, provenance, safety, None)
            left = F.lit(None).cast("bigint")
        one = counts.withColumns({"left_over": left, "provenance": F.lit(name)})
        out = one if out is None else out.unionByName(one)
    return out.select("provenance", "removed", "kept", "protected", "executed", "left_over")


@query("orphaned_actions", "DQ-7 JN-10 OP-14 SNK-4",
       f"""WITH {views.LINES}, {views.PRICES} SELECT 'orphaned_provenance' AS check_name, count(*) AS rows FROM prices
           WHERE volume >= 25 HAVING count(*) > 0""")
def orphaned_actions(spark, d):
    """Provenance of all actions, of which only some are stored."""
    bars = views.prices(spark, d)
    records = bars.select("volume", F.struct("symbol", "price_date").alias("index"), _cells(
        ticker=F.col("symbol"), type=F.lit("dividend"), date=F.col("price_date"), amount=F.col("volume")).alias("payload"))
    every = loads.judged_actions(records.drop("volume"), "Feed").withColumn("outcome", F.coalesce("outcome", F.lit(sinks.INSERTED)))
    path = fresh_dir(spark, "corporate_actions")
    loads.load_actions(spark, records.where("volume < 25").drop("volume"), path, "Feed", STAMP)
    found = audit.orphaned_provenance(loads.load_provenance(every, "corporate_action", None, True), {
        "corporate_action": schemas.read(spark, schemas.CORPORATE_ACTIONS, path)})
    return found.groupBy("check_name").agg(F.count(F.lit(1)).alias("rows"))


@query("repeated_import", "DQ-14 AGG-13 OP-14",
       f"""WITH {views.FILINGS}, g AS (SELECT filing_period AS period, count(*) FILTER (filing_period >= '1999-Q1'
             AND transaction_date - filing_date <= 365 AND transaction_code <> 'R') AS stored FROM filings GROUP BY ALL)
           SELECT period, CASE WHEN stored = 0 THEN 'duplicates_count is 0' ELSE '' END AS errors, stored > 0 AS passed FROM g""")
def repeated_import(spark, d):
    """Two real imports of the same quarters into one table, compared."""
    path = fresh_dir(spark, "insider_transactions")
    landed, runs = sections(spark, d), []
    for _ in range(2):
        done = filings.load_quarters(spark, landed, path, STAMP, "2001-Q4", 3)
        table = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, path)
        per_quarter = table.groupBy(F.col("filing_period").alias("period")).agg(F.count(F.lit(1)).alias("period_rows"))
        known = loads.load_provenance(done, "insider_transaction", None, False).agg(F.count(F.lit(1))).scalar()
        runs.append(stage(accounting.quarter_stats(done).join(per_quarter, "period", "left").withColumns({
            "status": F.lit("COMPLETED"), "total_rows": table.agg(F.count(F.lit(1))).scalar(), "provenance_rows": known}),
            "run-metrics"))
    return audit.idempotency(*runs).withColumn("errors", F.array_join("errors", "; "))


@query("required_tables_stored", "DQ-1",
       """SELECT 'required_tables' AS check_name, 'critical' AS severity, 'Required table ' || chr(39) || name || chr(39)
            || ' does not exist.' AS message
          FROM (SELECT unnest(['corporate_actions', 'research_events', 'trade_runs', 'market_prices']) AS name)
          WHERE (SELECT count(*) FROM orders) > 0""")
def required_tables_stored(spark, d):
    """Tables as they are found below a folder, three of them stored."""
    root = fresh_dir(spark, "store")
    columns = schemas.INSIDER_TRANSACTIONS.columns
    rows = views.filings(spark, d)
    schemas.append(rows.select(*[c for c in rows.columns if c in columns]), schemas.INSIDER_TRANSACTIONS, f"{root}/insider_transactions")
    schemas.append(views.signals(spark, d).drop("input_index"), schemas.SIGNALS, f"{root}/signals")
    schemas.append(views.provenance(spark, d), schemas.PROVENANCE, f"{root}/provenance")
    return audit.required_tables(spark, audit.tables_at(spark, root))

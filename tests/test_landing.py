import datetime
import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import access, accounting, audit, filings, loads, normalize, sinks
from tidemark.sources import archives, envelopes, filing_index, ownership
from tidemark.streaming import landing

NOW = datetime.datetime(2024, 1, 1)
ACC = "0000016732-23-000043"
SUB = ["ACCESSION_NUMBER", "FILING_DATE", "DATE_OF_ORIG_SUB", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL"]
TRANS = ["SECURITY_TITLE", "TRANS_DATE", "TRANS_FORM_TYPE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE",
         "TRANS_ACQUIRED_DISP_CD", "DIRECT_INDIRECT_OWNERSHIP"]


def tsv(header, *lines):
    return "\n".join("\t".join(x) for x in [header, *lines]) + "\n"


def make_archive(folder, period="2023-Q1", owners=1, nonderiv=1, deriv=0, form="4", orig="", with_owner_file=True):
    trade = ["Common Stock", "31-MAR-2023", "", "P", "100", "10.5", "A", "D"]
    members = {
        "submission.TSV": tsv(SUB, [ACC, "31-MAR-2023", "", "3", "1", "old", "x"], [ACC, "31-MAR-2023", orig, form, "16732", "Camp", " CPB "]),
        "NONDERIV_TRANS.tsv": tsv([" ACCESSION_NUMBER", "NONDERIV_TRANS_SK", *TRANS],
                                  *[[ACC, str(5001 + i), *trade] for i in range(nonderiv)], ["", "9", *trade]),
        "FOOTNOTES.tsv": tsv(["ACCESSION_NUMBER", "FOOTNOTE_ID", "FOOTNOTE_TXT"], [ACC, "F1", "\"quoted\ttext\""]),
    }
    if with_owner_file:
        members["REPORTINGOWNER.tsv"] = tsv(["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME"],
                                            *[[ACC, str(7 + i), f"Owner {i}"] for i in range(owners)])
    if deriv:
        members["DERIV_TRANS.tsv"] = tsv(["ACCESSION_NUMBER", "DERIV_TRANS_SK", *TRANS], *[[ACC, str(9 + i), *trade] for i in range(deriv)])
    path = folder / f"{period}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    content = path.read_bytes()
    (folder / f"{period}.json").write_text(json.dumps(
        {"period": period, "sha256": hashlib.sha256(content).hexdigest(), "file_size_bytes": len(content)}, indent=1))
    return path


def parsed(spark, tmp_path, **kwargs):
    path = make_archive(tmp_path, **kwargs)
    sections = archives.expand(spark.createDataFrame([("2023-Q1", str(path))], "period string, zip_path string"))
    return sections, filings.parse(sections, F.lit("url"), with_details=True)


def test_several_owners_are_not_attributed(spark, tmp_path):
    sections, df = parsed(spark, tmp_path, owners=2)
    row = df.first()
    assert (row.reporting_owner_name, row.reporting_owner_cik, row.owner_count, row.footnote_count) == (None, None, 2, 1)
    assert filings.details(sections).where("member = 'REPORTINGOWNER'").count() == 2


def test_rows_and_hashes(spark, tmp_path):
    _, df = parsed(spark, tmp_path, nonderiv=2, deriv=1)
    got = df.collect()
    assert len(got) == 3 and len({r.record_hash for r in got}) == 3 and all(r.reporting_owner_name == "Owner 0" for r in got)
    first = next(r for r in got if r.transaction_key == "5001")
    assert first.record_hash == hashlib.sha256(f"{ACC}|NON_DERIVATIVE|5001|4|0".encode()).hexdigest()
    assert (first.ticker, first.issuer_name, first.issuer_cik, first.filing_date) == ("CPB", "Camp", "0000016732", "2023-03-31")
    assert list(first.errors) == []


def test_amendment_and_missing_members(spark, tmp_path):
    _, df = parsed(spark, tmp_path, form="4/A", orig="15-MAR-2023", with_owner_file=False)
    row = df.first()
    assert row.is_amendment and row.date_of_orig_submission == "2023-03-15" and row.form_type == "4/A"
    assert list(row.errors) == [] and row.reporting_owner_name is None


def test_load_twice(spark, tmp_path):
    path = make_archive(tmp_path, nonderiv=2)
    sections = archives.expand(spark.createDataFrame([("2023-Q1", str(path))], "period string, zip_path string"))
    table = str(tmp_path / "table")
    got = []
    for _ in range(2):
        done = filings.load_quarters(spark, sections, table, NOW, "2023-Q4")
        got.append(accounting.quarter_stats(done).first())
    assert [(r.records_parsed, r.records_inserted, r.duplicates_count) for r in got] == [(2, 2, 0), (2, 0, 2)]
    stored = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, table)
    assert stored.count() == 2 and stored.first().raw_payload is None
    outside = filings.load_quarters(spark, sections, str(tmp_path / "other"), NOW, "2030-Q4")
    assert accounting.quarter_stats(outside).first().records_inserted == 0


def test_inventory_and_checksums(spark, tmp_path):
    make_archive(tmp_path)
    make_archive(tmp_path, "2023-Q2")
    (tmp_path / "2023-Q3.zip").write_bytes(b"x")
    with open(tmp_path / "2023-Q2.zip", "ab") as f:
        f.write(b"tampered")
    got = {r.period: r.status for r in archives.inventory(archives.files(spark, str(tmp_path))).collect()}
    assert got == {"2023-Q1": "COMPLETE", "2023-Q2": "COMPLETE", "2023-Q3": "INCOMPLETE"}
    sums = {r.period: r.matches for r in archives.checksum_audit(spark, str(tmp_path)).collect()}
    assert sums == {"2023-Q1": True, "2023-Q2": False, "2023-Q3": False}
    assert [r.period for r in archives.complete_periods(archives.files(spark, str(tmp_path))).collect()] == ["2023-Q1", "2023-Q2"]


def records(rows, *payloads):
    return rows("index int, payload map<string,string>", *list(enumerate(payloads)))


def price(symbol="A", day="2024-01-02", close="10", **more):
    return {"symbol": symbol, "date": day, "close": close, **more}


def test_price_load(spark, rows, tmp_path):
    table = str(tmp_path / "prices")
    batch = records(rows, price(), price(), price(close="11"), None, price(high="1", low="2"), price(close="nan"), price(day="2024-02-30"))
    got = {r["index"]: (r.outcome, r.reason) for r in loads.load_prices(spark, batch, table, "s", NOW).collect()}
    assert [got[i][0] for i in range(7)] == ["INSERTED", "DUPLICATE", "CONFLICT", "REJECTED", "REJECTED", "REJECTED", "REJECTED"]
    assert got[3][1] == "Record is not an object/mapping." and got[5][1] == "Normalization failed: close must be finite."
    again = loads.load_prices(spark, records(rows, price(close="11"), price(), price("B")), table, "s", NOW)
    assert {r["index"]: r.outcome for r in again.collect()} == {0: "CONFLICT", 1: "DUPLICATE", 2: "INSERTED"}
    assert {r.symbol: r.close for r in schemas.read(spark, schemas.MARKET_PRICES, table).collect()} == {"A": 10.0, "B": 10.0}
    assert loads.load_provenance(again, "market_price", None, False).count() == 2
    with pytest.raises(PySparkException, match="Market-price ingestion failed at record 0"):
        loads.strict(again, ("REJECTED", "CONFLICT", "FAILED"), "Market-price").collect()


def test_equal_rows_with_equal_index_are_stored_once(spark, rows, tmp_path):
    table = str(tmp_path / "prices")
    same = rows("index int, payload map<string,string>", *[(0, price())] * 40, (0, price(close="11")))
    got = loads.load_prices(spark, same.repartition(4), table, "s", NOW).groupBy("outcome").count().collect()
    assert sum(r["count"] for r in got) == 41 and {r.outcome: r["count"] for r in got}["INSERTED"] == 1
    assert schemas.read(spark, schemas.MARKET_PRICES, table).count() == 1


def test_action_identity_ignores_case(spark, rows, tmp_path):
    table = str(tmp_path / "actions")
    a = {"symbol": "a", "type": "Split", "date": "2024-01-02", "ratio": "2:1"}
    first = loads.load_actions(spark, records(rows, a, dict(a, type="split")), table, "Feed", NOW)
    assert sorted(r.outcome for r in first.collect()) == ["DUPLICATE", "INSERTED"]
    assert loads.load_provenance(first, "corporate_action", None, True).count() == 1


def test_accounting_and_status(rows):
    outcomes = rows("symbol string, outcome string", ("A", "INSERTED"), ("A", "REJECTED"), ("B", "CONFLICT"), ("X", "INSERTED"), (None, "REJECTED"))
    counts = accounting.by_symbol(outcomes, rows("symbol string", ("A",), ("B",), ("C",))).withColumn("provider_failures", F.lit(0))
    got = {r.symbol: (r.received, r.rejected, r.status, r.balanced) for r in accounting.price_status(counts).collect()}
    assert got == {"A": (2, 1, "SUCCESS", True), "B": (1, 0, "FAILED", True), "C": (0, 0, "FAILED", True),
                   "UNMAPPED": (2, 2, "FAILED", True)}
    other = {r.symbol: r.status for r in accounting.action_status(counts).collect()}
    assert (other["A"], other["C"]) == ("PARTIAL", "SUCCESS")
    total = accounting.totals(accounting.price_status(counts)).first()
    assert (total.requested_symbols, total.successful_symbols, total.received) == (3, 1, 5)


def test_envelopes(rows):
    df = rows("id int, body string", (1, '[{"a": 1}, 5]'), (2, '{"data": 3, "prices": [{"a": "x"}]}'), (3, "[]"))
    got = [(r.id, r.position, r.payload) for r in envelopes.prices(df, "body").orderBy("id", "position").collect()]
    assert got == [(1, 0, {"a": "1"}), (1, 1, None), (2, 0, {"a": "x"})]
    for bad in ('{"rows": []}', '"text"'):
        with pytest.raises(PySparkException, match="Market-data response"):
            envelopes.prices(rows("id int, body string", (1, bad)), "body").collect()


def test_adjusted_close_is_never_filled_from_adj_close(rows):
    df = rows("s string, body string", ("aapl", '{"historical": [{"date": "2024-01-02", "adjOpen": 1, "open": null, "close": 2, "adjClose": 3}]}'))
    p = envelopes.provider_prices(df, "body", "s").first().payload
    assert (p["symbol"], p["open"], p["close"], p["adjusted_close"]) == ("AAPL", "1", "2", None)


def test_dividend_by_key_presence(rows):
    df = rows("s string, body string", ("a", '[{"paymentDate": "2024-01-02", "dividend": null, "amount": 5}, {"date": "2024-01-03", "amount": 5}]'))
    got = [r.payload["cash_amount"] for r in envelopes.provider_dividends(df, "body", "s").orderBy("position").collect()]
    assert got == [None, "5"]


def test_filing_index(rows):
    doc = {"filings": {"recent": {"accessionNumber": ["1", "2", "1"], "form": ["4", "10-K", "4/A"], "filingDate": ["2024-01-01"],
                                  "primaryDocument": ["d", "d", "d"]}, "files": [{"name": "CIK-1.json"}, {"filename": "b.json"}]}}
    more = {"accessionNumber": ["3", "1"], "form": ["3", "4"], "filingDate": ["2024-01-01", "2024-01-01"], "primaryDocument": ["e", "d"]}
    df = rows("source int, doc string", (0, json.dumps(doc)), (1, json.dumps(more)), (2, "{}"))
    index = filing_index.rows(df, "doc")
    assert index.count() == 5
    got = {(r.accession_number, r.source, r.error) for r in filing_index.insider_filings(index, ["source", "position"]).collect()}
    assert got == {("1", 0, None), ("3", 1, None)}
    assert [r.file_name for r in filing_index.continuation_files(df, "doc").orderBy("position").collect()] == ["CIK-1.json", "b.json"]
    bad = rows("doc string", ('{"filings": {"files": [{"name": "../x"}]}}',))
    with pytest.raises(PySparkException, match="unsafe path"):
        filing_index.continuation_files(bad, "doc").collect()


XML = """<?xml version="1.0"?><ownershipDocument><documentType>4</documentType>
<issuer><issuerCik>0001234567</issuerCik><issuerName>Example</issuerName></issuer>
<reportingOwner><rptOwnerName>Jane Doe</rptOwnerName><rptOwnerCik>0007654321</rptOwnerCik></reportingOwner>
<nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"""
ROW = """<nonDerivativeTransaction><securityTitle><value>Common Stock</value></securityTitle>
<transactionDate><value>2026-09-23</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType>
<transactionCode>{}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{}</value></transactionShares>
<transactionPricePerShare><value>{}</value></transactionPricePerShare></transactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>{}</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"""


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(ROW.format("P", "1,000", "25.50", "D") + ROW.format("S", "250", "26.75", "I")))
    docs = ownership.read_xml(spark, str(tmp_path / "a.xml")).withColumns({
        "accession_number": F.lit("acc"), "issuer_cik": F.lit("1234567"), "form_type": F.lit("4"), "filing_date": F.lit("2026-09-24")})
    got = ownership.typed(ownership.xml_transactions(docs, ["accession_number", "issuer_cik", "form_type", "filing_date"])).orderBy("position").collect()
    assert [(r.transaction_code, r.shares, r.price, r.ownership_type, r.error) for r in got] == [
        ("P", 1000.0, 25.5, "D", None), ("S", 250.0, 26.75, "I", None)]
    assert (got[0].insider_name, got[0].issuer_cik, got[0].security_title) == ("Jane Doe", "0001234567", "Common Stock")


def test_history_without_document_is_reported(rows, spark, tmp_path):
    docs = ownership.parse_xml(rows("accession_number string, document_name string, doc string", ("1", "d", XML.format(ROW.format("P", "1", "x", "D")))), "doc")
    index = rows("accession_number string, document_name string, form_type string, filing_date string, issuer_cik string, "
                 "company_title string, position int", ("1", "d", "4", "2024-01-01", "7", "T", 0), ("2", "d", "4", None, "7", "T", 1),
                 ("3", "d", "10-K", "2024-01-01", "7", "T", 2), ("4", "d", "5", "2024-01-01", "7", "T", 3))
    got = {r.accession_number: r.error for r in filings.history(index, docs, ["position"]).collect()}
    assert got == {"1": "price must be numeric.", "2": "Eligible insider filing has no filing_date.",
                   "4": "Filing contains no identifiable insider transactions."}


def test_generic_historical_shapes(rows):
    df = rows("body string", ('[{"accession": "1"}]',), ('{"records": [{"accession_number": "2"}]}',), ('{"accessionNumber": "3", "companyName": "X"}',))
    got = normalize.historical_records(envelopes.historical(df, "body"), normalize.from_map()).collect()
    assert sorted(r.accession_number for r in got) == ["1", "2", "3"]


def test_tiers_and_strict_read(rows, spark):
    state = rows("period string, status string", ("2006-Q2", "FAILED"), ("2006-Q3", "COMPLETED"))
    kept = rows("period string", ("2006-Q1",), ("2006-Q2",))
    tiers = access.resolve_tiers(access.quarters(spark, "2006Q1", "2006-Q4"), state, kept, "2006-Q4")
    assert {r.period: r.tier for r in tiers.collect()} == {
        "2006-Q1": "ARCHIVE", "2006-Q2": "ARCHIVE", "2006-Q3": "HOT", "2006-Q4": "MISSING"}
    table = rows("filing_period string, transaction_date date, filing_date date, accession_number string", ("2006-Q1", None, None, "b"), ("2006-Q3", None, None, "a"))
    # Both tiers may refuse at the same time, which wraps the error.
    with pytest.raises(Exception, match="2006-Q4"):
        access.historical_transactions(table, table, tiers).collect()
    fine = tiers.where("tier <> 'MISSING'")
    assert [r.accession_number for r in access.historical_transactions(table, table, fine).collect()] == ["a", "b"]
    with pytest.raises(PySparkException, match="No authoritative period"):
        access.latest_period(state.where("false"), kept.where("false")).collect()


def test_unknown_columns_are_refused(rows):
    with pytest.raises(ValueError, match="Unknown columns for signals: colour"):
        schemas.conform(rows("signal_key string, colour string"), schemas.SIGNALS)


def test_blank_provenance_is_refused(rows):
    df = rows("record_type string, record_id string, source string, source_reference string, checksum string, validation_status string",
              ("t", " ", "s", None, None, "validated"))
    with pytest.raises(PySparkException, match="record_id cannot be empty"):
        sinks.provenance_rows(df, NOW).collect()


def test_cleanup_needs_a_passed_audit(spark, rows, tmp_path):
    df = rows("record_type string, record_id string", ("insider_transaction", "1"), ("dataset_period", "2"))
    safety = rows("can_cleanup boolean", (False,))
    assert sinks.cleanup_provenance(spark, df, safety, None).first().removed == 1
    with pytest.raises(ValueError, match="clean-up refused"):
        sinks.cleanup_provenance(spark, df, safety, str(tmp_path / "x"), execute=True)
    sinks.cleanup_provenance(spark, df, rows("can_cleanup boolean", (True,)), str(tmp_path / "x"), execute=True)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_present_tables(spark, rows, tmp_path):
    schemas.append(rows("signal_key string", ("k",)), schemas.SIGNALS, str(tmp_path / "signals"))
    present = audit.tables_at(spark, str(tmp_path))
    assert list(present) == ["signals"]
    assert audit.required_tables(spark, present).count() == len(audit.CORE_TABLES) - 1


def test_stream_replay_and_late_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        landing.land_prices(spark, str(folder), schemas.MARKET_PRICES, str(tmp_path / "t"), str(tmp_path / "o"),
                            str(tmp_path / "c"), "s", NOW, 1).awaitTermination()

    (folder / "1.json").write_text(json.dumps({"index": 0, "payload": price()}))
    run()
    (folder / "2.json").write_text(json.dumps({"index": 0, "payload": price()}) + "\n" + json.dumps({"index": 1, "payload": price("B")}))
    run()
    assert schemas.read(spark, schemas.MARKET_PRICES, str(tmp_path / "t")).count() == 2
    outcomes = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r.outcome for r in outcomes.collect()) == ["DUPLICATE", "INSERTED", "INSERTED"]


def test_a_delivery_run_again_keeps_its_outcomes(spark, rows, tmp_path, monkeypatch):
    table, work = str(tmp_path / "t"), str(tmp_path / "w")
    batch = loads.judged_prices(records(rows, price(), price("B"), price("B"), price(close="x")), "s")

    def store():
        return sorted((r["index"], r.outcome) for r in sinks.store(
            spark, batch, schemas.MARKET_PRICES, table, "index", NOW, work).collect())

    with monkeypatch.context() as m:  # fails after the outcomes are written and before the append
        m.setattr(schemas, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store()
    want = [(0, "INSERTED"), (1, "INSERTED"), (2, "DUPLICATE"), (3, "REJECTED")]
    for _ in range(2):  # fails after the append: the second time nothing is left to append
        assert store() == want
        assert schemas.read(spark, schemas.MARKET_PRICES, table).count() == 2


def test_store_refuses_unknown_columns(spark, rows, tmp_path):
    df = rows("index int, signal_key string, not_a_column string", (0, "k", "x"))
    with pytest.raises(ValueError, match="Unknown columns for signals: not_a_column"):
        sinks.store(spark, df, schemas.SIGNALS, str(tmp_path / "t"), "index", NOW)


def test_stage_copies_hold_no_payload(spark, rows, tmp_path):
    work = str(tmp_path / "w")
    batch = loads.judged_prices(records(rows, price()), "s")
    sinks.store(spark, batch, schemas.MARKET_PRICES, str(tmp_path / "t"), "index", NOW, work)
    kept = spark.read.parquet(f"{work}/outcomes").columns
    assert "close" not in kept and {"symbol", "price_date", "source", "record_hash", "outcome", "reason"} <= set(kept)


def test_decided_rows_are_staged_without_what_only_the_table_wants(spark, rows, tmp_path):
    batch = rows("symbol string, price_date date, close double, source string, record_hash string, price_year int, index long, outcome string",
                 ("A", NOW.date(), 1.5, "e", "h1", 2024, 1, None), ("A", NOW.date(), 2.5, "e", "h2", 2024, 2, "REJECTED"))
    work = str(tmp_path / "w")
    done = sinks.store(spark, batch, schemas.MARKET_PRICES, str(tmp_path / "t"), "index", NOW, work)
    assert {(r["index"], r.close, r.record_hash) for r in spark.read.parquet(f"{work}/batch").collect()} == {(1, 1.5, "h1"), (2, None, "h2")}
    assert {(r["index"], r.record_hash, r.price_year, r.outcome) for r in done.collect()} == {
        (1, "h1", 2024, "INSERTED"), (2, "h2", 2024, "REJECTED")}
    assert [r.close for r in schemas.read(spark, schemas.MARKET_PRICES, str(tmp_path / "t")).collect()] == [1.5]


def test_a_load_leaves_neither_its_batch_nor_its_shuffles(spark, rows, tmp_path, monkeypatch):
    made, freed, real = [], [], schemas.append
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(sinks, "fresh_dir", lambda spark, label: made.append(str(tmp_path / label)) or made[-1])
    monkeypatch.setattr(schemas, "append", lambda *args: freed.append(spark.conf.get(name)) or real(*args))
    batch = rows("symbol string, price_date date, close double, source string, record_hash string, price_year int, index long",
                 ("A", NOW.date(), 1.5, "e", "h1", 2024, 1), ("A", NOW.date(), 1.5, "e", "h1", 2024, 2))
    done = sinks.store(spark, batch, schemas.MARKET_PRICES, str(tmp_path / "t"), "index", NOW)
    assert sorted(r.outcome for r in done.collect()) == ["DUPLICATE", "INSERTED"]
    assert [p.name for p in (tmp_path / "work-market_prices").iterdir()] == ["outcomes"]
    assert freed == ["true"] and spark.conf.get(name, None) == before


def test_stored_fingerprints_are_dealt_as_bytes(spark, rows, tmp_path):
    """A repeated load of hexadecimal and other fingerprints finds them again."""
    prints = [hashlib.sha256(b"1").hexdigest(), "plain"]
    batch = rows("source string, accession_number string, record_hash string, ticker string, filing_period string, index long",
                 *[("SEC", f"0000000001-20-{i}", h, "T", "2020-Q1", i) for i, h in enumerate(prints)])
    for outcome in ("INSERTED", "DUPLICATE"):
        done = sinks.store(spark, batch, schemas.INSIDER_TRANSACTIONS, str(tmp_path / "t"), "index", NOW)
        assert {(r.record_hash, r.outcome) for r in done.collect()} == {(h, outcome) for h in prints}


def test_cells_are_read_before_rows_meet(spark, tmp_path, monkeypatch):
    """Neither a line nor a filing takes a map of cells along, unless the payload is wanted."""
    met, real = [], filings.skew.salted_lookup
    monkeypatch.setattr(filings.skew, "salted_lookup", lambda *sides: met.append(sides[:2]) or real(*sides))
    sections, _ = parsed(spark, tmp_path)
    row = filings.bulk_records(sections).first()
    assert (row.filing_date, row.issuer_cik, row.ticker, row.reporting_owner_cik) == ("2023-03-31", "0000016732", "CPB", "0000000007")
    assert [any("map<" in f.dataType.simpleString() for side in sides for f in side.schema) for sides in met] == [True, False]


def test_a_transaction_without_side_lines_has_blank_cells(rows):
    given = rows("filing_period string, member string, line_no bigint, cells map<string,string>",
                 ("2000-Q1", "DERIV_TRANS", 0, {"ACCESSION_NUMBER": "1", "TRANS_DATE": "1-JAN-00"}))
    row = filings.bulk_records(given, with_details=True).first().asDict()
    assert {k: row[k] for k in ("filing_date", "transaction_date", "issuer_cik", "issuer_name", "ticker", "form_type", "is_amendment",
                                "owner_count", "reporting_owner_cik", "reporting_owner_name", "footnote_count")} == {
        "filing_date": None, "transaction_date": "2000-01-01", "issuer_cik": "", "issuer_name": "", "ticker": "", "form_type": "4",
        "is_amendment": False, "owner_count": 0, "reporting_owner_cik": None, "reporting_owner_name": "", "footnote_count": 0}
    assert json.loads(row["raw_payload"])["submission"] is None


def test_decided_rows_are_not_ruled_on(spark, rows, tmp_path, monkeypatch):
    seen, real = [], sinks.classify
    monkeypatch.setattr(sinks, "classify", lambda batch, *rest: seen.append(batch.count()) or real(batch, *rest))
    batch = rows("symbol string, price_date date, close double, source string, record_hash string, price_year int, index long, outcome string",
                 ("A", NOW.date(), 1.5, "e", "h1", 2024, 1, None), ("A", NOW.date(), 2.5, "e", "h2", 2024, 2, "REJECTED"),
                 ("A", NOW.date(), 1.5, "e", "h1", 2024, 3, None))
    for want in ([(1, "INSERTED"), (2, "REJECTED"), (3, "DUPLICATE")], [(1, "DUPLICATE"), (2, "REJECTED"), (3, "DUPLICATE")]):
        done = sinks.store(spark, batch, schemas.MARKET_PRICES, str(tmp_path / "t"), "index", NOW)
        assert sorted((r["index"], r.outcome) for r in done.collect()) == want
    assert seen == [2, 2]


def test_many_rows_of_a_sliced_table_are_written_as_they_are_dealt(spark, rows, tmp_path, monkeypatch):
    """Buckets hold few ranges each, and their rows go to the table without another shuffle."""
    plans, real = [], schemas.append
    monkeypatch.setattr(sinks, "FEW", 10)
    monkeypatch.setattr(schemas, "append", lambda *args: plans.append(args[3:]) or real(*args))
    batch = spark.range(3000).selectExpr("concat('k', id % 2000) AS event_key", "'t' AS event_type", "id AS index")
    path = str(tmp_path / "t")
    for want in ({"INSERTED": 2000, "DUPLICATE": 1000}, {"DUPLICATE": 3000}):
        done = sinks.store(spark, batch, schemas.RESEARCH_EVENTS, path, "index", NOW)
        assert {r.outcome: r["rows"] for r in sinks.outcome_counts(done).collect()} == want
    assert plans == [(False,), (False,)]
    stored = schemas.read(spark, schemas.RESEARCH_EVENTS, path)
    assert stored.select("event_key").distinct().count() == stored.count() == 2000
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = batch.select(sinks._deal(schemas.RESEARCH_EVENTS, buckets).alias("_d"), F.expr(schemas.RESEARCH_EVENTS.ranges).alias("r"))
    assert per.groupBy("_d").agg(F.countDistinct("r").alias("n")).agg(F.max("n")).first()[0] == 1


def test_an_absent_table_starts_no_python(spark, tmp_path):
    none = schemas.read(spark, schemas.RESEARCH_EVENTS, str(tmp_path / "none"))
    assert none.count() == 0 and [f.name for f in none.schema] == schemas.RESEARCH_EVENTS.columns
    assert [f.dataType for f in none.schema] == [f.dataType for f in schemas.RESEARCH_EVENTS.schema]
    assert "ExistingRDD" not in none._jdf.queryExecution().executedPlan().toString()

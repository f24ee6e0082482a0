import datetime

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import audit, normalize, reconcile, risk, validate
from tidemark.functions import hashing
from tidemark.plans import catalog

PRICE = ("symbol string, price_date date, open double, high double, low double, close double, adjusted_close double, "
         "volume double, source string")
DAY = datetime.date(2024, 1, 2)


def price_errors(rows, o, h, lo, c, adj, v, symbol="A"):
    return list(validate.market_prices(rows(PRICE, (symbol, DAY, o, h, lo, c, adj, v, "s"))).first().errors)


def test_price_rules(rows):
    assert price_errors(rows, 1.0, 2.0, 1.0, 1.5, None, 0.0) == []
    assert price_errors(rows, 0.0, 0.0, 0.0, 0.0, None, None) == []
    assert price_errors(rows, None, None, None, None, 0.0, -1.0) == [
        "adjusted_close must be greater than zero.", "volume cannot be negative."]
    assert price_errors(rows, 5.0, 1.0, 2.0, None, None, 1.0, " ") == [
        "symbol is required.", "at least one of close or adjusted_close is required.", "high cannot be lower than low.",
        "open cannot exceed high."]
    assert price_errors(rows, float("nan"), 1.0, 1.0, 1.0, None, None) == ["open must be finite."]


def test_strict_form_raises(rows):
    bad = validate.market_prices(rows(PRICE, ("A", DAY, None, None, None, None, None, None, "s")))
    with pytest.raises(PySparkException, match="at least one of close"):
        validate.require_valid(bad).collect()


def test_bulk_rules(rows):
    ddl = ("accession_number string, form_type string, issuer_cik string, transaction_date string, filing_date string, "
           "date_of_orig_submission string, transaction_code string, acquired_disposed string, ownership_type string, "
           "shares double, price_per_share double, source_url string")
    good = ("a", "4", "1", "2023-01-01", "2023-01-02", None, "p", "a", "i", 0.0, 0.0, "u")
    bad = ("", "4", "", "soon", "2023-01-02", None, "Q", "B", "X", -1.0, -2.0, "")
    late = ("a", "4", "1", "2024-01-03", "2023-01-02", None, "P", None, None, None, None, "u")
    got = [list(r.errors) for r in validate.bulk_transactions(rows(ddl, good, bad, late)).collect()]
    assert got[0] == [] and len(got[1]) == 9
    assert got[2] == ["Transaction date (2024-01-03) is >1 year ahead of filing date (2023-01-02)"]


def test_insider_record_rules(rows):
    ddl = ("symbol string, insider_name string, transaction_date string, transaction_type string, source string, "
           "accession_number string, shares double, price double")
    df = rows(ddl, ("A", "n", "d", " buy ", "s", "1", 1.0, None), ("A", "n", "d", "GIFT", "s", "1", -1.0, None))
    assert [list(r.errors) for r in validate.insider_records(df).collect()] == [
        [], ["Invalid transaction_type: GIFT", "shares cannot be negative."]]


def test_aliases_keep_zero_and_prefer_the_first(rows):
    df = rows("i int, payload map<string,string>",
              (0, {"ticker": " aapl ", "date": "2024-01-02", "close": "0", "close_price": "5", "source": "x"}),
              (1, {"symbol": "B", "price_date": "2024-01-02", "close": "true"}), (2, {"symbol": "", "ticker": "T"}))
    got = {r.i: r for r in normalize.market_prices(df, normalize.from_map(), "feed", ["i"]).collect()}
    assert (got[0].symbol, got[0].close, got[0].source, got[0].normalize_error) == ("AAPL", 0.0, "feed", None)
    assert got[1].normalize_error == "close must be numeric." and got[2].normalize_error == "symbol is required."


def test_column_payloads(rows):
    df = rows("issuerCik string, accession string, shares string", ("1", "acc", "1,000"))
    got = normalize.insider_transactions(df, normalize.from_columns(df), "SEC").first()
    assert (got.issuer_cik, got.accession_number, got.shares, got.price) == ("1", "acc", 1000.0, None)


def test_strict_batch_names_the_record(rows):
    df = rows("i int, payload map<string,string>", (7, {"symbol": "A"}))
    with pytest.raises(PySparkException, match="Failed to normalize record 7: price_date is required."):
        normalize.batch(df, normalize.from_map(), "market_price", "s", "i").collect()
    with pytest.raises(ValueError):
        normalize.batch(df, normalize.from_map(), "bond", "s", "i")


def test_reconciliation(rows):
    ids = reconcile.reconcile_ids(rows("record_id string", ("a",), ("b",), ("b",)), rows("record_id string", ("b ",), ("c",), ("c",)))
    got = {r.record_id: (r.status, r.is_duplicate) for r in ids.collect()}
    assert got == {"a": ("MISSING", False), "b": ("MATCHED", False), "c": ("UNEXPECTED", True)}
    total = reconcile.reconciliation_summary(ids).first()
    assert (total.expected_count, total.accepted_count, total.matched_count, total.complete) == (3, 3, 1, False)
    with pytest.raises(PySparkException, match="missing=1, unexpected=1, duplicates=1"):
        reconcile.require_complete(reconcile.reconciliation_summary(ids)).collect()


def test_blank_id_is_never_complete(rows):
    one = rows("record_id string", (" ",))
    assert not reconcile.reconciliation_summary(reconcile.reconcile_ids(one, one)).first().complete


def test_hash_verification(rows):
    df = rows("v string, want string", ("x", None), ("x", " "), ("x", "wrong"))
    assert [r.valid for r in audit.verify_hashes(df, hashing.sha256(F.col("v")), "want").collect()] == [False] * 3


def test_audit_refuses_unknown_checks(spark):
    with pytest.raises(ValueError, match="Unsupported integrity check: nonsense"):
        audit.audit_tables(spark, {}, ["nonsense"])


def test_audit_in_one_pass_a_table(spark, rows, monkeypatch):
    monkeypatch.setattr(audit, "_UNROLL", 3)
    fields = ", ".join(f"{f} double" for f in audit.PRICE_FIELDS)
    bar = lambda symbol, close: (symbol, "2024-01-02", "s", f"h{symbol}", None, None, None, close, None, None)
    tables = {
        "market_prices": rows(f"symbol string, price_date string, source string, record_hash string, {fields}",
                              *[bar("A", -1.0)] * 7, bar("A", 1.0), bar("B", 1.0), bar("C", -2.0)),
        "signals": rows("signal_key string", ("k",), ("k",), ("l",)), "trade_runs": rows("run_id string, mode string", ("r", "other"), ("q", "live")),
        "insider_transactions": rows("record_hash string", ("t",), (None,)), "corporate_actions": rows("record_hash string", ("c",), ("c",)),
        "provenance": rows("record_type string, record_id string, validation_status string", ("insider_transaction", "t", "ok"),
                           ("insider_transaction", "gone", " "), ("market_price", "hA", "ok"), ("market_price", "hX", "ok"),
                           ("corporate_action", "c", "ok"), ("corporate_action", "d", "ok"), ("corporate_action", None, "ok"),
                           ("dataset_period", "2020-Q1", None))}
    got = {}
    for r in audit.audit_tables(spark, tables).collect():
        got.setdefault(r.check_name, []).append(r.message)
    assert len(got["negative_market_values"]) == 8 and len(set(got["negative_market_values"])) == 2
    assert got["duplicate_market_prices"] == ["Duplicate market-price identity detected: A / 2024-01-02 / s (8 records)."]
    assert sorted(got["orphaned_provenance"]) == [f"Provenance record references missing {x}'." for x in (
        "corporate_action record '", "corporate_action record 'd", "insider_transaction record 'gone", "market_price record 'hX")]
    assert len(got["provenance_status"]) == 2 and len(got["duplicate_signals"]) == len(got["trade_modes"]) == 1
    assert [m.split("'")[1] for m in got["required_tables"]] == ["research_events"]
    only = audit.audit_tables(spark, tables, [" trade_modes", "duplicate_market_prices"]).collect()
    assert sorted(r.check_name for r in only) == ["duplicate_market_prices", "trade_modes"]


def test_risk(rows):
    positions = rows("symbol string, quantity double, reference_price double", ("A", 10.0, 10.0), (" a", 5.0, 10.0), ("B", 1.0, 50.0))
    orders = rows("id int, symbol string, quantity double, reference_price double",
                  (1, "a", 1.0, 10.0), (2, "A", 100.0, 10.0), (3, "C", 1.0, 10.0), (4, "B", 0.0, 1.0))
    got = {r.id: r for r in risk.check_orders(orders, positions, risk.Limits(1000.0, 1000.0, 500.0, 3)).collect()}
    assert got[1].approved and got[1].existing_exposure == 200.0
    assert len(got[2].reasons) == 3
    assert list(got[3].reasons) == ["Projected open-position count exceeds the configured limit."]
    assert not got[4].approved
    with pytest.raises(ValueError):
        risk.Limits(0, 1, 1)

def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_amounts_just_below_a_thousand_get_no_comma(spark, tmp_path):
    """999.997 is rounded to 1000.00 but is below a thousand, as in the query's SQL."""
    day = datetime.datetime(1995, 3, 1)
    lines = [(n, 1, 1, 1, 1.0, price, 0.0, 0.0, "N", "O", day) for n, price in enumerate((999.997, 1000.0, 999.99))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("lenient_numbers", "strict_numbers"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cur = db.execute(catalog.CHECKS[name])
        columns = [c[0] for c in cur.description]
        assert _sorted(df.columns, [tuple(r) for r in df.collect()]) == _sorted(columns, cur.fetchall())
    numbers = {r.l_orderkey: r.number for r in catalog.QUERIES["lenient_numbers"](spark, str(tmp_path)).collect()}
    assert numbers == {0: 1000.0, 1: None, 2: 999.99}

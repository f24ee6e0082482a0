import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, numbers, text
from tidemark.functions.settle import settled
from tidemark.operators import filings


def one(rows, ddl_value, column):
    ddl, value = ddl_value
    return rows(f"v {ddl}", (value,)).select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("given, want", [
    (" a\t", "a"), ("\t \n", None), ("", None), (None, None), (" x y　", "x y")])
def test_clean(rows, given, want):
    assert one(rows, ("string", given), text.clean) == want


@pytest.mark.parametrize("given, want", [
    ("31-MAR-2023", "2023-03-31"), ("2023-03-31", "2023-03-31"), ("20230331", "2023-03-31"), ("31-mar-23", "2023-03-31"),
    ("31-MAR-85", "1985-03-31"), ("31-MAR-68", "2068-03-31"), ("1-JAN-69", "1969-01-01"), ("", None), (None, None),
    ("soon", "soon"), ("2023-02-30", "2023-02-30")])
def test_filing_date_text(rows, given, want):
    assert one(rows, ("string", given), dates.filing_date_text) == want


@pytest.mark.parametrize("given, want, error", [
    ("2023-01-31", datetime.date(2023, 1, 31), None), (" 2023-01-31 ", datetime.date(2023, 1, 31), None),
    ("2023-02-30", None, "d is an invalid calendar date."), ("2023-1-5", None, "d must be in YYYY-MM-DD ISO format."),
    ("2023-01-01T00:00:00Z", None, "d must be in YYYY-MM-DD ISO format."), (" ", None, "d is required.")])
def test_iso_date(rows, given, want, error):
    assert one(rows, ("string", given), dates.iso_date) == want
    assert one(rows, ("string", given), lambda c: dates.iso_date_error(c, "d")) == error


@pytest.mark.parametrize("given, want, error", [
    ("1,234.5", 1234.5, None), ("", None, None), (None, None, None), ("1_000", 1000.0, None), (".5", 0.5, None),
    ("1e3", 1000.0, None), ("0", 0.0, None), ("1.0d", None, "x must be numeric."), ("0x10", None, "x must be numeric."),
    ("true", None, "x must be numeric."), ("nan", None, "x must be finite."), ("-Infinity", None, "x must be finite."),
    ("1e999", None, "x must be finite."), ("1__0", None, "x must be numeric.")])
def test_strict_number(rows, given, want, error):
    assert one(rows, ("string", given), numbers.strict_number) == want
    assert one(rows, ("string", given), lambda c: numbers.strict_number_error(c, "x")) == error


@pytest.mark.parametrize("given, want", [("1,000", None), ("12", 12.0), ("inf", float("inf")), ("abc", None)])
def test_lenient_number(rows, given, want):
    assert one(rows, ("string", given), numbers.lenient_number) == want


def test_returns_need_positive_prices(rows):
    got = rows("a double, b double", (100.0, 110.0), (0.0, 1.0), (1.0, -1.0), (None, 1.0)).select(
        numbers.pct_return(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r is None for r in got] == [False, True, True, True]
    assert got[0].r == pytest.approx(10.0)


@pytest.mark.parametrize("given, want", [("2006Q1", "2006-Q1"), (" 2006 q4", "2006-Q4"), ("2006-Q2", "2006-Q2")])
def test_period(rows, given, want):
    assert one(rows, ("string", given), dates.normalize_period) == want


def test_retention(rows):
    got = rows("p string", ("2023-Q3",), ("2020-Q4",), ("2020-Q3",), ("2023-Q4",)).select(
        dates.within_retention(F.col("p"), F.lit("2023-Q3"), 3).alias("r")).collect()
    assert [r.r for r in got] == [True, True, False, False]


@pytest.mark.parametrize("given, want", [
    ("1234", "0000001234"), ("12345678901", "12345678901"), ("x1", "x1"), (" 7\t", "0000000007"), ("", None)])
def test_cik(rows, given, want):
    assert one(rows, ("string", given), text.cik) == want


NUMBERS = [150.0, 0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e-7, 0.0001, 0.00001, 123456789.125, -2.5e20, 0.0]


def test_double_text_matches_the_usual_shortest_form(rows):
    got = rows("v double", *[(n,) for n in NUMBERS]).select(hashing.double_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [repr(n) for n in NUMBERS]


def test_price_hash_is_the_hash_of_sorted_json(rows):
    day = datetime.date(2024, 1, 15)
    df = rows("symbol string, price_date date, open double, high double, low double, close double, adjusted_close double, "
              "volume double, source string", ("É\"A", day, 1.5, 20000000.0, None, 0.1, None, 1e7, "feed"))
    record = {"symbol": "É\"A", "price_date": "2024-01-15", "open": 1.5, "high": 20000000.0, "low": None, "close": 0.1,
              "adjusted_close": None, "volume": 1e7, "source": "feed"}
    want = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(hashing.price_hash().alias("h")).first().h == want


def test_transaction_identity(rows):
    df = rows("a string, t string, k string, f string, m boolean",
              ("0000016732-23-000043", "non_derivative", "5001", "4", False), ("a", None, None, "4/A", True))
    got = [r.h for r in df.select(hashing.transaction_identity(*[F.col(c) for c in "atkfm"]).alias("h")).collect()]
    assert got == [hashlib.sha256(s.encode()).hexdigest() for s in (
        "0000016732-23-000043|NON_DERIVATIVE|5001|4|0", "a|||4/A|1")]


def test_amendment_rules_differ(rows):
    df = rows("flag boolean, form string, orig string", (None, "4/A", None), (False, "4/A", ""), (False, "4", "2023-01-01"))
    f, form, o = F.col("flag"), F.col("form"), F.col("orig")
    got = df.select(text.amendment_at_parse(o, form).alias("p"), text.amendment_on_read(f, form).alias("r"),
                    text.amendment_for_research(f, form, o).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (True, False, True), (True, False, True)]


def test_source_url(rows):
    df = rows("g string, c string, a string", ("", "0000001234", "1-2-3"), ("given", "1", "1-2-3"), (None, "", "1-2-3"))
    got = [r.u for r in df.select(text.filing_url(F.col("g"), F.col("c"), F.col("a")).alias("u")).collect()]
    base = "https://www.sec.gov/Archives/edgar/data"
    assert got == [f"{base}/1234/123/1-2-3.txt", "given", f"{base}/0/123/1-2-3.txt"]


def test_clean_text_is_trimmed_like_the_whole_list(spark, rows):
    """Whatever stands at an end: white space of any kind, an ASCII sign, another letter, half of it or nothing."""
    ends = ["", " ", "\t", "\x1f", "\x7f", "\x85", "\xa0", " ", "!", "~", "a", "é", "ꀠ", "\U0001f600", "\x00"]
    made = [f"{a}{m}{b}" for a in ends for b in ends for m in ("", "x", " x ", "é")] + [None]
    df = rows("c string", *[(m,) for m in made])
    slow = F.nullif(F.btrim("c", F.lit(text.WHITE_SPACE)), F.lit(""))
    assert df.where(~text.clean(F.col("c")).eqNullSafe(slow)).count() == 0


def test_plain_text_is_not_looked_up_in_the_list(spark, rows):
    plan = rows("c string", ("x",)).select(text.clean(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # only the other branch trims


def test_messages_are_collected_by_compiled_code(spark, rows):
    df = rows("a string, b string", ("x", None), (None, None), ("x", "y"))
    done = df.select(text.errors(F.col("a"), F.col("b")).alias("e"))
    assert "lambda" not in done._jdf.queryExecution().executedPlan().toString()
    assert [r.e for r in done.collect()] == [["x"], [], ["x", "y"]]
    assert done.schema["e"].dataType.simpleString() == "array<string>"


@pytest.mark.parametrize("made", [
    lambda rows: settled(rows("a string, b string", ("x", "y")), ["a"]),
    lambda rows: filings.bulk_records(rows("filing_period string, member string, line_no bigint, cells map<string,string>",
                                           ("2000-Q1", "DERIV_TRANS", 0, {"ACCESSION_NUMBER": "1"})))])
def test_wide_rules_are_split_into_methods_the_jvm_compiles(spark, rows, made):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")  # what a session has that sets nothing
    try:
        made(rows)
        assert int(spark.conf.get(name)) == 8000
    finally:
        spark.conf.set(name, before)

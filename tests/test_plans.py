"""The plans the operators are written for."""

import datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import settle
from tidemark.operators import access, asof, audit, research, sinks
from tidemark.plans import reading, study
from tidemark.sources import filing_index, ownership


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, rows, tmp_path):
    day = datetime.date(2024, 1, 2)
    df = rows("source string, accession_number string, ticker string, transaction_date date, filing_date date, "
              "transaction_code string, raw_payload string, record_hash string, filing_period string",
              ("SEC", "a", "A", day, day, "P", "{}", "h", "2024-Q1"), ("SEC", "b", "B", day, day, "S", "{}", "i", "2023-Q4"))
    path = str(tmp_path / "t")
    schemas.append(df, schemas.INSIDER_TRANSACTIONS, path)
    return schemas.read(spark, schemas.INSIDER_TRANSACTIONS, path)


def test_filters_and_columns_reach_the_scan(spark, rows, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = access.query_transactions(stored(spark, rows, tmp_path), tickers="a", filing_start_date="2024-01-01", ordered=False)
    text = plan(df.where(F.col("filing_period") == "2024-Q1").select("accession_number"))
    assert "PartitionFilters: [isnotnull(filing_period" in text
    assert "EqualTo(ticker,A)" in text and "GreaterThanOrEqual(filing_date,2024-01-01)" in text
    assert "raw_payload" not in text.split("ReadSchema")[1]


def test_as_of_lookup_is_one_shuffle_and_no_join(rows):
    day = datetime.date(2024, 1, 2)
    series = rows("symbol string, price_date date, px double", ("A", day, 1.0))
    probes = rows("symbol string, probe_date date", ("A", day))
    text = plan(asof.observations_after(series, probes, [1, 6, 11]))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_top_k_does_not_sort_everything(rows):
    text = plan(access.newest(rows("k string, d date", ("a", None)), ["d"], "k"))
    assert "TakeOrderedAndProject" in text


def test_a_load_reads_only_its_partitions_of_the_target(spark, rows, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "p")
    ddl = "symbol string, price_date date, close double, source string, record_hash string, price_year int"
    old = [("A", datetime.date(y, 1, 2), 1.0, "s", "h", y) for y in (2020, 2021, 2022)]
    schemas.append(rows(ddl, *old), schemas.MARKET_PRICES, path)
    batch = rows(ddl, ("A", datetime.date(2021, 1, 2), 1.0, "s", "h", 2021), ("B", datetime.date(2021, 3, 4), 1.0, "s", "h", 2021))
    stored = sinks.stored_for(spark, batch, schemas.MARKET_PRICES, path)
    text = plan(sinks.classify(batch.withColumn("index", F.lit(1)), stored.select("symbol", "price_date", "source", "record_hash"),
                               ["symbol", "price_date", "source"], "record_hash", "index"))
    assert "PartitionFilters: [isnotnull(price_year" in text and "price_year#" in text and "= 2021)" in text
    assert "LeftSemi" in text
    assert stored.count() == 1


def accessions(rows, n, years):
    ddl = "source string, accession_number string, record_hash string, filing_period string"
    return rows(ddl, *[("SEC", f"0000000001-{y:02d}-{k:06d}", f"h{k}", f"20{y:02d}-Q1") for y in years for k in range(n)])


def bytes_read(df):
    df.collect()
    found = [0]

    def walk(node):
        if node.metrics().contains("filesSize"):
            found[0] += node.metrics().apply("filesSize").value()
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        children = node.children()
        for c in [*inner, *[children.apply(k) for k in range(children.size())]]:
            walk(c)

    walk(df._jdf.queryExecution().executedPlan())
    return found[0]


def test_a_batch_of_transactions_reads_only_the_ranges_of_its_keys(spark, rows, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    table, path = schemas.INSIDER_TRANSACTIONS, str(tmp_path / "t")
    schemas.append(accessions(rows, 100, range(15, 25)), table, path)
    read = {}
    for name, batch in (("one key", accessions(rows, 1, [20])), ("a year", accessions(rows, 100, [20])),
                        ("two years", accessions(rows, 100, [20, 21]))):
        batch = schemas.ranged(batch, table)
        known = sinks.stored_for(spark, batch, table, path)
        text = plan(known)
        assert "PartitionFilters: [" in text and "key_range" in text.split("PartitionFilters: [")[1].split("]")[0]
        read[name] = bytes_read(known.select(*table.key))
        assert known.join(batch, list(table.key), "left_semi").count() == batch.count()
    whole = bytes_read(schemas.read(spark, table, path).select(*table.key))
    assert read["one key"] * 100 < whole and read["a year"] * 9 < whole and 1.8 < read["two years"] / read["a year"] < 2.2


def test_outcomes_across_quarters_of_one_key(spark, rows, tmp_path):
    """A key that comes again under another quarter is still a duplicate."""
    table, path = schemas.INSIDER_TRANSACTIONS, str(tmp_path / "t")
    day = datetime.datetime(2024, 1, 1)
    first = accessions(rows, 3, [20]).withColumn("index", F.col("record_hash"))
    assert {r.outcome for r in sinks.store(spark, first, table, path, "index", day).collect()} == {"INSERTED"}
    again = first.withColumn("filing_period", F.lit("2031-Q4"))
    assert {r.outcome for r in sinks.store(spark, again, table, path, "index", day).collect()} == {"DUPLICATE"}
    odd = rows("source string, accession_number string, record_hash string, filing_period string, index string",
               ("SEC", "", "h", "2020-Q1", "1"), ("SEC", "no year", "h", None, "2"))
    assert {r.outcome for r in sinks.store(spark, odd, table, path, "index", day).collect()} == {"INSERTED"}
    assert schemas.read(spark, table, path).where("key_range LIKE 'none-%'").count() == 2


def test_lookup_by_key_reads_one_range(spark, rows, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path, files = str(tmp_path / "events"), []
    for n in (200, 2000):  # ten times the rows
        made = spark.range(n).select(F.concat(F.lit(f"key{n}-"), "id").alias("event_key"), F.lit("event_return").alias("event_type"))
        schemas.append(made, schemas.RESEARCH_EVENTS, f"{path}{n}")
        found = access.result_by_key(schemas.read(spark, schemas.RESEARCH_EVENTS, f"{path}{n}"), f"key{n}-7")
        assert "key_range" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
        assert found.count() == 1
        files.append(len(found.inputFiles()))
    stored = schemas.read(spark, schemas.SIGNALS, str(tmp_path / "none"))
    assert access.signal_by_key(stored, " k ").count() == 0


def test_bucketed_prices_stay_where_they_are(spark, rows):
    day = datetime.date(2024, 1, 2)
    made = [(f"S{k}", day + datetime.timedelta(days=i), "s", float(k + i + 1)) for k in range(30) for i in range(5)]
    prices = rows("symbol string, price_date date, source string, close double", *made)
    probes = rows("symbol string, probe_date date", *[(f"S{k}", day) for k in range(31)])
    stored = asof.store_bucketed(prices, "prices", 4)
    found = asof.observations_after(asof.price_series(stored), probes, [1, 4], buckets=4)
    text = plan(found)
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text  # the probes' own
    want = asof.observations_after(asof.price_series(prices), probes, [1, 4])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_audit_scans_each_table_once(spark, rows, tmp_path):
    for table in (schemas.MARKET_PRICES, schemas.PROVENANCE, schemas.SIGNALS, schemas.INSIDER_TRANSACTIONS, schemas.CORPORATE_ACTIONS):
        schemas.append(spark.createDataFrame([], table.schema).drop("key_range"), table, str(tmp_path / table.name))
    tables = {t: schemas.read(spark, schemas.TABLES[t], str(tmp_path / t)) for t in (
        "market_prices", "provenance", "signals", "insider_transactions", "corporate_actions")}
    tables["trade_runs"] = rows("run_id string, mode string")
    text = plan(audit.audit_tables(spark, tables))
    # prices are read for their values, and for nothing but their hashes where provenance is compared with them
    assert text.count("FileScan parquet") == 6
    assert sum("ReadSchema: struct<record_hash:string>" in line for line in text.splitlines()) == 3


def test_a_batch_is_dealt_once(spark, rows, tmp_path, monkeypatch):
    """All rows of a key are staged in one file; its new rows are chosen, and stored, without another shuffle by key."""
    table, path, work = schemas.MARKET_PRICES, str(tmp_path / "t"), str(tmp_path / "w")
    ddl = "index int, symbol string, price_date date, close double, source string, record_hash string, price_year int, outcome string"
    made = [(k, f"S{k % 7}", datetime.date(2020, 1, 2), 1.0, "s", f"{k % 2:064x}", 2020, "REJECTED" if k % 11 == 0 else None) for k in range(200)]
    (tmp_path / "w" / "batch").mkdir(parents=True)
    (tmp_path / "w" / "batch" / "part-of-a-lost-attempt.parquet").write_text("")
    seen = []
    append = schemas.append
    monkeypatch.setattr(schemas, "append", lambda df, *a: (seen.append(plan(df)), append(df, *a)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            sinks.store(spark, rows(ddl, *made).repartition(5), table, path, "index", datetime.datetime(2024, 1, 1), work)
            work = str(tmp_path / "again")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("Exchange" not in text for text in seen)
    files = spark.read.parquet(str(tmp_path / "w" / "batch")).where("outcome IS NULL").groupBy("symbol").agg(
        F.countDistinct("_metadata.file_name").alias("files"))
    assert {r.files for r in files.collect()} == {1}
    counts = {r.outcome: r["count"] for r in spark.read.parquet(str(tmp_path / "w" / "outcomes")).groupBy("outcome").count().collect()}
    assert counts["INSERTED"] == 7 and counts["REJECTED"] == 19 and sum(counts.values()) == 200
    assert schemas.read(spark, table, path).count() == 7


def test_a_key_with_a_missing_part_is_not_stored(spark, rows, tmp_path):
    table, path = schemas.INSIDER_TRANSACTIONS, str(tmp_path / "t")
    batch = rows("source string, accession_number string, record_hash string, filing_period string, index int",
                 ("SEC", None, "h", "2020-Q1", 1), ("SEC", None, "h", "2020-Q1", 2), ("SEC", "a-20-1", "h", "2020-Q1", 3))
    got = sinks.store(spark, batch, table, path, "index", datetime.datetime(2024, 1, 1)).collect()
    assert {r["index"]: r.outcome for r in got} == {1: "CONFLICT", 2: "CONFLICT", 3: "INSERTED"}


def test_parsed_text_is_parsed_once(spark, rows):
    """Rules and filters read a document's parsed columns; none of them repeats the parser, and no generator works it out."""
    docs = rows("accession_number string, doc string", ("a", "<ownershipDocument><nonDerivativeTable/></ownershipDocument>"))
    found = ownership.xml_transactions(ownership.parse_xml(docs, "doc"), ["accession_number"])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_xml(") == 1
    assert [line for line in text.splitlines() if "Generate inline" in line and "from_xml(" in line] == []


def test_settled_columns_are_worked_out_below_the_generator(rows):
    df = rows("k int, t string", (1, " a "), (2, None)).selectExpr("k", "upper(trim(t)) AS t")
    got = settle.settled(df, ["k"])
    text = got.where("t = 'A'")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("upper(") == 1 and all("upper(" not in line for line in text.splitlines() if "Generate" in line)
    assert sorted(map(tuple, got.collect())) == [(1, "A"), (2, None)]


def test_a_filing_index_is_parsed_once(rows):
    """Neither the filter on its columns nor the one that Spark derives from the generator repeats the parser."""
    doc = '{"accessionNumber": ["a"], "filingDate": ["2024-01-02"], "form": ["4"], "primaryDocument": ["d"]}'
    found = filing_index.rows(rows("k int, doc string", (1, doc), (2, "[1]")), "doc")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(StructField(filings") == 1
    assert sorted((r.k, r.accession_number, r.error) for r in found.collect()) == [(1, "a", None), (2, None, filing_index.UNREADABLE)]


def test_the_metadata_of_a_json_document_is_parsed_once(rows):
    docs = [('{"form": 4, "accessionNumber": " a ", "x": {"form": "no"}}', "4", "a", "d"), (' {"formType": "5", "form": " "}', "5", "i", "d"),
            ('{"filedDate": null, "filingDate": "2024-01-02"}', "f", "i", "2024-01-02"), ('[{"form": "4"}]', "f", "i", "d"),
            ("no document", "f", "i", "d"), (None, "f", "i", "d")]
    made = rows("doc string, form string, accession string, filed string", *[(d[0], "f", "i", "d") for d in docs])
    found = ownership.json_metadata(made, "doc", "form", "accession", "filed")
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(") == 1 and "get_json_object(" not in text
    assert found.columns == made.columns and [tuple(r) for r in found.collect()] == [tuple(d) for d in docs]


def test_events_are_looked_up_without_reading_the_filings_for_salts(rows):
    """Filings are read for the probes and for the join; a fingerprint travels as its bytes and comes back as it was."""
    day = datetime.date(2024, 1, 2)
    filings = rows("accession_number string, record_hash string, ticker string, filing_date date, form_type string, is_amendment boolean, "
                   "date_of_orig_submission date", *[(f"a{k}", h, "A", day, "4", False, None) for k, h in enumerate(("ab" * 32, "AB" * 32, "h", None))])
    series = rows("symbol string, price_date date, px double", *[("A", day + datetime.timedelta(days=k), 1.0 + k) for k in range(4)])
    out = research.prepare_events(filings, series, 1)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in text and "unhex(record_hash" in text
    assert sorted((r.accession_number, r.record_hash, r.reason) for r in out.collect()) == [
        ("a0", "ab" * 32, None), ("a1", "AB" * 32, None), ("a2", "h", None), ("a3", None, None)]
    signals = rows("signal_key string, symbol string, signal_date date, signal_price double", ("s", "A", day, 1.0))
    judged = research.evaluate_signals(signals, series, [1, 3])
    assert "_salt" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.evaluation_periods, r.outcome_price) for r in judged.collect()) == [(1, 2.0), (3, 4.0)]


def test_results_that_are_stored_once_are_not_staged_first(spark, rows, monkeypatch):
    staged = []
    monkeypatch.setattr(reading, "_research_events", lambda *a: rows("event_key string", ("k",)))
    monkeypatch.setattr(reading, "stage", lambda df, label: staged.append(label) or df)
    monkeypatch.setattr(sinks, "store", lambda spark, events, *a: events)
    reading._stored_events(spark, "", (1,))
    assert staged == []
    reading._stored_events(spark, "", (1, 2))
    assert staged == ["results"]


def test_prices_have_as_many_buckets_as_the_session_deals_to(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(study.asof, "store_bucketed", lambda prices, label, buckets: seen.append(buckets) or prices)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for wanted in (5, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
            study.bucketed_event_returns(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [5, 23]


def test_results_are_not_staged_with_their_key_twice(rows):
    made = reading._indexed(rows("event_key string", ("backtest:run-1:A|2020-01-02|1|h",)))
    assert made.schema["index"].dataType.simpleString() == "bigint"


def test_provenance_is_appended_as_bytes(spark, rows, tmp_path, monkeypatch):
    """Both of its fingerprints; texts that are none come through."""
    made = rows("record_type string, record_id string, source string, checksum string",
                ("t", "ab" * 32, "s", "ab" * 32), ("t", "AB" * 32, "s", "x"), ("t", None, "s", None), ("u", "cd" * 32, "s", "y"))
    packed, real = [], schemas.hashing.packed
    monkeypatch.setattr(schemas.hashing, "packed", lambda df, *columns: packed.extend(columns) or real(df, *columns))
    path = str(tmp_path / "p")
    schemas.append(made, schemas.PROVENANCE, path)
    assert [c for c in packed if c] == ["record_id", "checksum"]
    got = schemas.read(spark, schemas.PROVENANCE, path).select(*made.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, made.collect()))


def test_bars_and_returns_are_made_once_for_all_results(spark, monkeypatch):
    """Every kind of result looks the same bars up, which lie in buckets by symbol; trades are made of the returns."""
    made, studied = [], []
    prices, returns = reading.views.prices, reading.research.event_returns
    monkeypatch.setattr(reading.views, "prices", lambda *a: made.append(1) or prices(*a))
    monkeypatch.setattr(reading.research, "event_returns", lambda *a: studied.append(1) or returns(*a))
    kinds = {r.event_type: r["count"] for r in reading._research_events(spark, "/root/testdata/sf0.001").groupBy("event_type").count().collect()}
    assert (len(made), len(studied)) == (1, 1)
    assert set(kinds) == {"event_return", "event_study_summary", "signal_outcome", "backtest", "backtest_trade"}
    assert kinds["event_return"] == kinds["backtest_trade"] > 0 and kinds["backtest"] == 1

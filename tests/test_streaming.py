"""The stateful import against the same deliveries loaded in one batch."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import changes, sinks
from tidemark.streaming import quarters

NOW = datetime.datetime(2024, 1, 1)
SCHEMA = "source string, accession_number string, record_hash string, ticker string, good boolean, filing_period string"
PRICES = "symbol string, price_date date, close double, source string, record_hash string, price_year int, filing_period string"


def judge(rows):
    return rows.withColumns({"errors": F.when(F.col("good"), F.array().cast("array<string>")).otherwise(F.array(F.lit("bad"))),
                             "outcome": F.when(~F.col("good"), "SKIPPED")})


def row(k, quarter="2020-Q1", good=True, year=20):
    return ("SEC", f"0000000001-{year}-{k:06d}", f"h{k}", f"T{k}", good, quarter)


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        folder, table, outcomes, state = (str(tmp_path / n) for n in ("in", "table", "outcomes", "state"))

        def deliver(self, *values):
            spark.createDataFrame(list(values), SCHEMA).coalesce(1).write.mode("append").partitionBy("filing_period").parquet(self.folder)

        def run(self, checkpoint="c", **more):
            query = quarters.land(spark, self.folder, SCHEMA, judge, schemas.INSIDER_TRANSACTIONS, self.table, self.outcomes,
                                  str(tmp_path / checkpoint), NOW, **{"files_per_batch": 1} | more)
            query.awaitTermination()

        def counts(self):
            found = spark.read.parquet(self.outcomes).groupBy("outcome").count().collect()
            return {r.outcome: r["count"] for r in found}

        def stored(self):
            return sorted(r.record_hash for r in schemas.read(spark, schemas.INSIDER_TRANSACTIONS, self.table).collect())

    return Place()


def test_repeated_late_and_invalid_rows(place):
    place.deliver(row(1), row(1), row(2), row(3, good=False))
    place.run()
    assert place.counts() == {"INSERTED": 2, "DUPLICATE": 1, "SKIPPED": 1} and place.stored() == ["h1", "h2"]
    place.deliver(row(2), row(4), row(1, "2021-Q1"))  # late, new, and again under another quarter
    place.run()
    assert place.counts() == {"INSERTED": 3, "DUPLICATE": 3, "SKIPPED": 1} and place.stored() == ["h1", "h2", "h4"]
    place.run()  # nothing has come
    assert place.counts() == {"INSERTED": 3, "DUPLICATE": 3, "SKIPPED": 1}
    place.deliver(row(5, good=False))  # a file without a candidate is counted too
    place.run()
    assert place.counts()["SKIPPED"] == 2


def test_the_table_is_not_read(place, monkeypatch):
    place.deliver(row(1), row(2))
    monkeypatch.setattr(schemas, "read", lambda *a: (_ for _ in ()).throw(AssertionError("read")))
    place.run()
    place.deliver(row(1), row(3))
    place.run()
    monkeypatch.undo()
    assert place.counts() == {"INSERTED": 3, "DUPLICATE": 1} and place.stored() == ["h1", "h2", "h3"]


def test_replay_after_a_failure(place, monkeypatch):
    place.deliver(row(1), row(1), row(2))
    real = schemas.append
    for fail_after in (False, True):  # lost before and after rows reached the table
        def lost(*args, after=fail_after):
            if after:
                real(*args)
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(schemas, "append", lost)
            with pytest.raises(StreamingQueryException):
                place.run()
    place.run()
    assert place.counts() == {"INSERTED": 2, "DUPLICATE": 1} and place.stored() == ["h1", "h2"]


def test_new_checkpoint_over_a_table_with_rows(spark, place):
    place.deliver(row(1), row(2))
    place.run()
    known = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, place.table)
    place.outcomes += "-again"
    place.run("other", known=known)
    assert place.counts() == {"DUPLICATE": 2} and place.stored() == ["h1", "h2"]
    place.deliver(row(2), row(3))
    place.run("other", known=known)
    assert place.counts() == {"DUPLICATE": 3, "INSERTED": 1}


def test_resume_by_completed_quarter(spark, place):
    manifest = spark.createDataFrame([("2020-Q1", 3), ("2020-Q2", 2), ("2020-Q3", 5)], "period string, rows bigint")
    place.deliver(row(1), row(2), row(3, good=False), row(4, "2020-Q2"))
    place.run()
    quarters.record_quarters(spark, place.outcomes, manifest, place.state, NOW, 1)

    def state():
        found = changes.current(spark, schemas.INGESTION_STATE, place.state, "completed_at").collect()
        return {r.period: (r.status, r.records_parsed, r.records_inserted, r.duplicates_count, r.invalid_count) for r in found}

    assert state() == {"2020-Q1": ("COMPLETED", 3, 2, 0, 1), "2020-Q2": ("PARTIAL", 1, 1, 0, 0)}
    done = quarters.done_quarters(spark, place.state)
    assert done == ["2020-Q1"] and quarters.done_quarters(spark, place.state, force=True) == []
    place.deliver(row(9), row(4, "2020-Q2"), row(5, "2020-Q2"))
    place.run(skip=done)
    quarters.record_quarters(spark, place.outcomes, manifest, place.state, NOW + datetime.timedelta(days=1), 2)
    assert state() == {"2020-Q1": ("COMPLETED", 3, 2, 0, 1), "2020-Q2": ("COMPLETED", 3, 2, 1, 0)}
    assert "h9" not in place.stored()


def test_conflicts_and_first_row_by_place(spark, tmp_path):
    day = datetime.date(2020, 1, 2)
    plain = lambda rows: rows.withColumn("outcome", F.lit(None).cast("string"))
    folder = str(tmp_path / "in")
    for values in ([("A", 1.0, "x"), ("A", 2.0, "y"), ("A", 1.0, "x")], [("A", 2.0, "y"), ("A", 1.0, "x"), ("B", 1.0, "x")]):
        spark.createDataFrame([(s, day, c, "e", h, 2020, "2020-Q1") for s, c, h in values], PRICES).coalesce(1).write.mode(
            "append").partitionBy("filing_period").parquet(folder)
        quarters.land(spark, folder, PRICES, plain, schemas.MARKET_PRICES, str(tmp_path / "t"), str(tmp_path / "o"), str(tmp_path / "c"),
                      NOW).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).orderBy("batch_id", "_row").collect()
    assert [r.outcome for r in got] == ["INSERTED", "CONFLICT", "DUPLICATE", "CONFLICT", "DUPLICATE", "INSERTED"]
    assert {(r.symbol, r.close) for r in schemas.read(spark, schemas.MARKET_PRICES, str(tmp_path / "t")).collect()} == {("A", 1.0), ("B", 1.0)}


def test_outcomes_equal_those_of_one_batch(spark, place, tmp_path):
    made = [row(k % 37, f"2020-Q{k % 3 + 1}", good=k % 11 != 0) for k in range(300)]
    for k in range(0, 300, 100):
        place.deliver(*made[k:k + 100])
    place.run(files_per_batch=4)
    batch = judge(spark.createDataFrame(made, SCHEMA)).drop("good").withColumn("index", F.monotonically_increasing_id())
    whole = sinks.store(spark, batch, schemas.INSIDER_TRANSACTIONS, str(tmp_path / "whole"), "index", NOW)
    assert place.counts() == {r.outcome: r["rows"] for r in sinks.outcome_counts(whole).collect()}
    assert place.stored() == sorted(r.record_hash for r in schemas.read(spark, schemas.INSIDER_TRANSACTIONS, str(tmp_path / "whole")).collect())


def test_keys_do_not_pass_through_python(place, monkeypatch):
    made, real = [], quarters.rulings
    monkeypatch.setattr(quarters, "rulings", lambda *args: made.append(real(*args)) or made[-1])
    place.deliver(row(1), row(2))
    place.run()
    plan = made[0]._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan and "PySpark" not in plan


def test_a_batch_adds_one_file_to_a_range(place, tmp_path):
    for k in range(0, 160, 40):
        place.deliver(*[row(n) for n in range(k, k + 40)])
    place.run(files_per_batch=4)
    assert place.counts() == {"INSERTED": 160}
    folders = [p.parent for p in (tmp_path / "table").rglob("*.parquet")]
    assert len(folders) == len(set(folders)) > 1


def test_replay_after_the_rulings(place, monkeypatch):
    """The state knows the batch's keys already when its outcomes are made."""
    place.deliver(row(1), row(1), row(2, good=False))
    with monkeypatch.context() as m:
        m.setattr(quarters, "_outcomes", lambda *args: 1 / 0)
        with pytest.raises(StreamingQueryException):
            place.run()
    place.run()
    assert place.counts() == {"INSERTED": 1, "DUPLICATE": 1, "SKIPPED": 1} and place.stored() == ["h1"]


def test_new_rows_are_chosen_without_decided_ones_and_with_fingerprints_as_bytes(spark, tmp_path, monkeypatch):
    """What a batch appends is looked for among its open rows only; hexadecimal and other fingerprints come through."""
    seen, real = [], quarters.hashing.packed
    monkeypatch.setattr(quarters.hashing, "packed", lambda df, *columns: seen.append((df.count(), columns)) or real(df, *columns))
    ddl = "source string, accession_number string, record_hash string, filing_period string, outcome string"
    made = [("SEC", "0000000001-20-1", "ab" * 32, "2020-Q1", None), ("SEC", "0000000001-20-2", "plain", "2020-Q1", None),
            ("SEC", "0000000001-20-3", "cd" * 32, "2020-Q1", "SKIPPED")]
    given = spark.createDataFrame(made, ddl)
    given.write.partitionBy("filing_period").parquet(str(tmp_path / "in"))
    folders = [str(tmp_path / n) for n in ("table", "outcomes", "checkpoint")]
    quarters.land(spark, str(tmp_path / "in"), given.schema, lambda rows: rows, schemas.INSIDER_TRANSACTIONS, *folders,
                  datetime.datetime(2024, 1, 1)).awaitTermination()
    stored = schemas.read(spark, schemas.INSIDER_TRANSACTIONS, folders[0])
    assert {r.record_hash for r in stored.collect()} == {"ab" * 32, "plain"}
    assert (2, ("record_hash",)) in seen

"""Archives read in place: rows, pruned columns, pushed filters, members that must stay closed."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.plans import landing
from tidemark.sources import archive_source, archives

FILES = {"submission.TSV": " ACCESSION_NUMBER\tFORM \nA1\t 4 \nA2\n\t3\n",
         "DERIV_TRANS.tsv": "ACCESSION_NUMBER\tTRANS_CODE\nA1\tP\textra\nA2\tS\n\nA3\t\n"}


def archive(folder, period, files=FILES):
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / f"{period}.zip", "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return folder / f"{period}.zip"


def spoil(path, member):
    """Overwrite a member's bytes, so that whoever reads it fails."""
    with zipfile.ZipFile(path) as z:
        info = z.getinfo(member)
    with open(path, "r+b") as f:
        f.seek(info.header_offset)
        f.write(b"XXXX")


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path / "in", "2023-q1")
    archive(tmp_path / "in", "2023-q2")
    return tmp_path / "in"


def test_equals_landed_rows(spark, folder):
    listing = spark.createDataFrame([(f"2023-Q{k}", str(folder / f"2023-q{k}.zip")) for k in (1, 2)], "period string, zip_path string")
    want = sorted(map(str, archives.expand(listing).collect()))
    for path in (str(folder), f"file://{folder}", f"file:{folder}"):
        assert sorted(map(str, archive_source.read(spark, path).collect())) == want
    assert len(want) == 10
    whole = spark.read.format("quarter_archives").load(str(folder))
    assert whole.schema == archives.expand(listing).schema and sorted(map(str, whole.collect())) == want


def test_columns_and_missing_cells(spark, folder):
    rows = archive_source.read(spark, str(folder), "ACCESSION_NUMBER string, FORM string", ("2023-q1",))
    got = sorted(map(tuple, rows.where("FORM IS NOT NULL").collect()))
    assert got == [("2023-Q1", "SUBMISSION", 0, "A1", "4"), ("2023-Q1", "SUBMISSION", 1, "A2", "")]
    assert sorted(r.ACCESSION_NUMBER for r in rows.where("FORM IS NULL").collect()) == ["A1", "A2", "A3"]
    assert archive_source.read(spark, str(folder), "NO_SUCH string").where("NO_SUCH IS NOT NULL").count() == 0
    for bad, message in (({"schema": "FORM int"}, "is string"), ({"member": "OTHER"}, "no member OTHER")):
        reader = spark.read.format("quarter_archives").option("member", bad.get("member", "submission"))
        with pytest.raises(Exception, match=message):
            reader.schema(bad.get("schema", "FORM string")).load(str(folder)).collect()


def test_filters_keep_members_and_archives_closed(spark, folder):
    spoil(folder / "2023-q1.zip", "submission.TSV")
    spoil(folder / "2023-q2.zip", "submission.TSV")
    spoil(folder / "2023-q2.zip", "DERIV_TRANS.tsv")
    columns = "ACCESSION_NUMBER string, TRANS_CODE string"
    with pytest.raises(Exception, match="Bad magic number"):
        archive_source.read(spark, str(folder), columns).collect()
    one = archive_source.read(spark, str(folder), columns, ("2023-Q1",)).where("member = 'DERIV_TRANS'")
    assert one.rdd.getNumPartitions() == 1
    assert sorted(r.ACCESSION_NUMBER for r in one.collect()) == ["A1", "A2", "A3"]
    assert [r.ACCESSION_NUMBER for r in one.where(F.col("TRANS_CODE").isin("P", "X")).collect()] == ["A1"]


def test_one_frame_used_twice(spark, folder):
    rows = archive_source.read(spark, str(folder))
    both = rows.where("member = 'SUBMISSION'").groupBy("filing_period").count().unionByName(
        rows.where("member = 'DERIV_TRANS'").groupBy("filing_period").count())
    assert sorted(map(tuple, both.collect())) == [("2023-Q1", 2), ("2023-Q1", 3), ("2023-Q2", 2), ("2023-Q2", 3)]


def test_empty_folder(spark, tmp_path):
    assert archive_source.read(spark, str(tmp_path)).count() == 0


def test_a_short_list_of_archives_is_spread_over_tasks(spark, tmp_path):
    """Adaptive execution must not put all archives into one task because their list is small."""
    for k in range(12):
        with zipfile.ZipFile(tmp_path / f"P{k}.zip", "w") as z:
            z.writestr("FOOTNOTES.tsv", "ACCESSION_NUMBER\tFOOTNOTE_TXT\n" + f"a{k}\tx\n" * 20)
    listed = spark.createDataFrame([(f"P{k}", str(tmp_path / f"P{k}.zip")) for k in range(12)], "period string, zip_path string")
    rows = archives.expand(listed).withColumn("task", F.spark_partition_id())
    assert rows.count() == 240 and rows.select("task").distinct().count() > 1
    archives.land(listed, str(tmp_path / "landed"))
    assert len(list((tmp_path / "landed" / "member=FOOTNOTES").glob("*.parquet"))) > 1


def test_lines_are_read_as_columns(tmp_path):
    """Short, long and blank lines, a name that comes twice, white space and signs that need quotes."""
    text = (' ACCESSION_NUMBER \tA\tB\tA\n1\tx\n\n2\ta\t b \t"c\td"\tmore\n\tno\tno\tno\n3\t"say ""so"""\t\xa0\t"two\nlines"\n')
    with zipfile.ZipFile(tmp_path / "2000-Q1.zip", "w") as z:
        z.writestr("deriv_trans.TSV", text)
    found, = archives.member_lines(str(tmp_path / "2000-Q1.zip"), "DERIV_TRANS")
    assert found.numbers == [0, 2, 3, 4] and found.column("C") is None
    assert [dict(c) for c in found.having("ACCESSION_NUMBER").cells().to_pylist()] == [
        {"ACCESSION_NUMBER": "1", "A": "", "B": ""}, {"ACCESSION_NUMBER": "2", "A": "c\td", "B": "b"},
        {"ACCESSION_NUMBER": "3", "A": "two\nlines", "B": ""}]


def test_written_lines_are_read_as_they_were(spark, rows, tmp_path):
    cells = {"ACCESSION_NUMBER": "1", "FOOTNOTE_TXT": 'a "quoted"\tand\nbroken\\ "text'}
    line = rows("member string, cells map<string,string>", ("FOOTNOTES", cells)).select(landing._line()).first()[0]
    with zipfile.ZipFile(tmp_path / "2000-Q1.zip", "w") as z:
        z.writestr("FOOTNOTES.tsv", f"ACCESSION_NUMBER\tFOOTNOTE_TXT\n{line}\n")
    found, = archives.member_lines(str(tmp_path / "2000-Q1.zip"), "FOOTNOTES")
    assert [dict(c) for c in found.cells().to_pylist()] == [cells]

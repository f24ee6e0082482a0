"""Filing indexes: column-oriented JSON documents to one row per filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.settle import settled
from tidemark.sources.envelopes import as_object

# Column names of an index, best first.
COLUMNS = {
    "accession_number": ("accessionNumber", "accession_number", "accession"),
    "document_name": ("primaryDocument", "primary_document", "primaryDocumentName", "primary_document_name",
                      "documentName", "document_name"),
    "form_type": ("form", "formType", "form_type"),
    "filing_date": ("filingDate", "filing_date", "filedDate"),
}
REQUIRED = ("accessionNumber", "filingDate", "form", "primaryDocument")
_NAMES = [n for names in COLUMNS.values() for n in names]
_LISTS = ", ".join(f"{n}: array<string>" for n in _NAMES)
SCHEMA = (f"struct<filings: struct<recent: struct<{_LISTS}>, files: array<map<string,string>>>, {_LISTS}>")


UNREADABLE = "Filing index is not a JSON object."


def _zip(prefix: str) -> Column:
    """Index columns side by side; a short column is padded with nulls."""
    empty = F.array().cast("array<string>")
    return F.arrays_zip(*[F.coalesce(F.col(f"{prefix}.{n}"), empty).alias(n) for n in _NAMES])


def rows(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """One row per filing of a main document (``filings.recent``) or a continuation document (columns
    at top level), in document order (``position``); the first non-blank alias of each column counts.

    A document that is no JSON object gives one row without position whose ``error`` says so."""
    keep = keep or [c for c in df.columns if c != column]
    parsed = df.withColumn("_doc", F.from_json(column, SCHEMA))
    broken = as_object(F.col(column)).isNull()
    # Settled, or the filter below and the one that Spark derives from the generator parse the document again.
    staged = settled(parsed.select(*keep, broken.alias("_broken"), _zip("_doc.filings.recent").alias("_recent"), _zip("_doc").alias("_top"), *[
        F.col(f"_doc.{n}").isNotNull().alias(f"_has_{n}") for n in REQUIRED]), keep)
    usable = F.col(f"_has_{REQUIRED[0]}")
    for n in REQUIRED[1:]:
        usable = usable | F.col(f"_has_{n}")
    chosen = F.when(F.size("_recent") > 0, F.col("_recent")).when(usable, F.col("_top"))
    exploded = staged.where(F.col("_broken") | (F.size(chosen) > 0)).select(
        *keep, "_broken", F.posexplode_outer(F.when(~F.col("_broken"), chosen)).alias("position", "_row"))
    return exploded.select(*keep, "position", *[
        text.first_nonblank(*[F.col(f"_row.{n}") for n in names]).alias(field) for field, names in COLUMNS.items()],
        F.when(F.col("_broken"), F.lit(UNREADABLE)).alias("error"))


def continuation_files(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Names of continuation files; a name that could leave its folder stops the job."""
    keep = keep or [c for c in df.columns if c != column]
    files = df.withColumn("_doc", F.from_json(column, SCHEMA)).select(
        *keep, F.posexplode("_doc.filings.files").alias("position", "_file"))
    name = text.clean(F.coalesce(F.element_at("_file", "name"), F.element_at("_file", "filename")))
    staged = files.select(*keep, "position", name.alias("file_name")).where(F.col("file_name").isNotNull())
    unsafe = F.col("file_name").rlike(r"[/\\]|\.\.")
    refused = F.raise_error(F.concat(F.lit("Continuation file name contains an unsafe path: "), F.col("file_name")))
    return staged.withColumn("file_name", F.when(unsafe, refused.cast("string")).otherwise(F.col("file_name")))


def insider_filings(index: DataFrame, order: list[str]) -> DataFrame:
    """Insider forms once per accession and document: the first in ``order``. ``error`` names what an
    eligible row lacks; rows of documents that could not be read stay, each by itself, with their error."""
    given = F.col("error") if "error" in index.columns else F.lit(None).cast("string")
    index = index.withColumn("error", given)
    unread = index.where(F.col("error").isNotNull())
    eligible = index.where(F.col("error").isNull() & text.is_insider_form(F.col("form_type"))).drop("error")
    error = F.coalesce(*[
        F.when(F.col(c).isNull(), F.lit(f"Eligible insider filing has no {c}."))
        for c in ("accession_number", "document_name", "form_type", "filing_date")])
    key = ["accession_number", "document_name"]
    others = [c for c in eligible.columns if c not in key]
    first = eligible.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*key, "_row.*").withColumn("error", error).unionByName(unread)

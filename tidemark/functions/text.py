"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def clean(c: Column) -> Column:
    """Trim every kind of white space; blank becomes null (Spark ``trim`` strips spaces only).

    Trimming looks every end character up in the whole list, so texts that begin and end with an ASCII character other
    than white space, which most do, pass by their first and last byte, and as they are not blank, without another look.
    """
    c = c.cast("string")
    first = (c >= "!") & (c < "\x7f")
    last = F.substring(c.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(first & last, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit("")))


def symbol(c: Column) -> Column:
    return F.upper(clean(c))


def first_present(*cols: Column) -> Column:
    """First non-null value; zero and blank count as present."""
    return F.coalesce(*cols)


def first_nonblank(*cols: Column) -> Column:
    """First value with text in it, trimmed."""
    return F.coalesce(*[clean(c) for c in cols])


def required_error(c: Column, field: str) -> Column:
    """``'<field> is required.'`` when the text is null or blank, else null."""
    return F.when(clean(c).isNull(), F.lit(f"{field} is required."))


def errors(*checks: Column) -> Column:
    """Array of the non-null messages, in the order given. Flattened, as Spark compiles that and interprets a filter."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(m.isNotNull(), F.array(m)).otherwise(none) for m in checks]))


def cik(c: Column) -> Column:
    """Digits padded to ten; anything else, and longer digit runs, pass unchanged."""
    text = clean(c)
    return F.when(text.rlike(r"^\d{1,9}$"), F.lpad(text, 10, "0")).otherwise(text)


def cik_error(c: Column) -> Column:
    text = clean(c)
    return F.when(text.isNull(), F.lit("CIK is required.")).when(
        ~text.rlike(r"^\d+$"), F.lit("CIK must contain digits only.")
    )


# The insider forms, the transaction codes and the two-letter indicators.
INSIDER_FORMS = ("3", "4", "5", "3/A", "4/A", "5/A")
TRANSACTION_CODES = ("P", "S", "A", "D", "F", "I", "M", "C", "E", "H", "O", "X", "G", "L", "W", "Z", "J", "K", "U")
ACQUIRED_DISPOSED = ("A", "D")
OWNERSHIP_TYPES = ("D", "I")
RECORD_SIDES = ("BUY", "SELL", "PURCHASE", "SALE")


def is_insider_form(c: Column) -> Column:
    return F.coalesce(F.upper(clean(c)).isin(*INSIDER_FORMS), F.lit(False))


def form_or_default(row_form: Column, document_type: Column | None = None) -> Column:
    """The row's own form, else the filing's document type, else ``'4'``."""
    found = [F.nullif(c, F.lit("")) for c in (row_form, document_type) if c is not None]
    return F.coalesce(*found, F.lit("4"))


def amendment_at_parse(original_date: Column, document_type: Column) -> Column:
    """Landing rule: an original-submission date is present, or the document type ends in /A."""
    has_date = F.coalesce(original_date, F.lit("")) != ""
    return has_date | F.coalesce(document_type.endswith("/A"), F.lit(False))


def amendment_on_read(flag: Column, form: Column) -> Column:
    """Reading rule: the stored flag; when it is null, /A anywhere in the form."""
    return F.coalesce(flag.cast("boolean"), form.contains("/A"), F.lit(False))


def amendment_for_research(flag: Column, form: Column, original_date: Column) -> Column:
    """Research rule: the flag, or /A in the form, or an original-submission date."""
    in_form = F.upper(F.coalesce(form, F.lit("4"))).contains("/A")
    has_date = F.coalesce(original_date.cast("string"), F.lit("")) != ""
    return F.coalesce(flag, F.lit(False)) | in_form | has_date


# The regulator's public addresses.
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data"
DATASET_BASE = "https://www.sec.gov/files/structureddata/data/insider-transactions-data-sets"


def _cik_folder(issuer_cik: Column) -> Column:
    text = F.coalesce(issuer_cik, F.lit(""))
    unpadded = F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0"))
    return F.when(text.rlike(r"^\d+$"), unpadded).when(text == "", F.lit("0")).otherwise(text)


def filing_url(given: Column, issuer_cik: Column, accession: Column) -> Column:
    """The URL given, else the filing's text file built from unpadded CIK and accession."""
    built = F.concat(
        F.lit(f"{ARCHIVE_BASE}/"), _cik_folder(issuer_cik), F.lit("/"),
        F.regexp_replace(accession, "-", ""), F.lit("/"), accession, F.lit(".txt"),
    )
    return F.coalesce(F.nullif(given, F.lit("")), built)


def document_url(issuer_cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(
        F.lit(f"{ARCHIVE_BASE}/"), _cik_folder(issuer_cik), F.lit("/"),
        F.regexp_replace(accession, "-", ""), F.lit("/"), document,
    )


def dataset_url(period: Column) -> Column:
    """Quarter ``YYYY-Qn`` to the address of its quarterly archive."""
    return F.concat(F.lit(f"{DATASET_BASE}/"), F.lower(F.regexp_replace(period, "-", "")), F.lit("_form345.zip"))

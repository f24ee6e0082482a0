"""Ownership-form documents, XML or JSON, to one row per transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import numbers, text
from tidemark.functions.settle import settled

_V = "struct<value: string, _VALUE: string>"
_TRANSACTION = f"""struct<securityTitle: {_V}, transactionDate: {_V},
  transactionCoding: struct<transactionFormType: string, transactionCode: {_V}>,
  transactionAmounts: struct<transactionShares: {_V}, transactionPricePerShare: {_V}>,
  ownershipNature: struct<directOrIndirectOwnership: {_V}>>"""
_OWNER = "struct<rptOwnerName: string, rptOwnerCik: string, reportingOwnerId: struct<rptOwnerName: string, rptOwnerCik: string>>"
XML_SCHEMA = f"""struct<documentType: string, periodOfReport: string,
  issuer: struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>, reportingOwner: array<{_OWNER}>,
  nonDerivativeTable: struct<nonDerivativeTransaction: array<{_TRANSACTION}>>,
  derivativeTable: struct<derivativeTransaction: array<{_TRANSACTION}>>, _corrupt_record: string>"""
UNREADABLE = "Ownership document cannot be read."


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Landed XML files: one row per document with its ``path``."""
    return spark.read.format("xml").option("rowTag", "ownershipDocument").schema(
        T.DataType.fromDDL(XML_SCHEMA)).load(path).withColumn(
        "path", F.col("_metadata.file_path"))


def parse_xml(df: DataFrame, column: str) -> DataFrame:
    """Documents held as text: the same columns next to the others. A document is parsed once, whatever is asked of it."""
    options = {"rowTag": "ownershipDocument", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    others = [c for c in df.columns if c != column]
    parsed = settled(df.select(*others, F.from_xml(column, XML_SCHEMA, options).alias("_doc")), others)
    return parsed.select(*others, "_doc.*")


def _either(path: str) -> Column:
    return text.first_nonblank(F.col(f"{path}.value"), F.col(f"{path}._VALUE"))


def xml_transactions(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Raw transaction fields of parsed XML documents; the first reporting owner is the insider.

    A document that could not be read gives one row without position whose ``document_error`` says so.
    """
    empty = F.array().cast(f"array<{_TRANSACTION}>")
    both = F.concat(F.coalesce("nonDerivativeTable.nonDerivativeTransaction", empty),
                    F.coalesce("derivativeTable.derivativeTransaction", empty))
    owner = F.get("reportingOwner", 0)
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in docs.columns else F.lit(False)
    rows = docs.withColumn("_broken", broken).where(F.col("_broken") | (F.size(both) > 0)).select(
        *keep, F.when(F.col("_broken"), F.lit(UNREADABLE)).alias("document_error"),
        text.clean(F.col("issuer.issuerName")).alias("issuer_name"),
        text.first_nonblank(owner["rptOwnerName"], owner["reportingOwnerId"]["rptOwnerName"]).alias("insider_name"),
        text.first_nonblank(owner["rptOwnerCik"], owner["reportingOwnerId"]["rptOwnerCik"]).alias("insider_cik"),
        F.posexplode_outer(F.when(~F.col("_broken"), both)).alias("position", "t"))
    return rows.select(
        *keep, "document_error", "position", "issuer_name", "insider_name", "insider_cik",
        _either("t.transactionCoding.transactionCode").alias("transaction_code"),
        _either("t.transactionDate").alias("transaction_date"),
        _either("t.transactionAmounts.transactionShares").alias("shares"),
        _either("t.transactionAmounts.transactionPricePerShare").alias("price"),
        _either("t.ownershipNature.directOrIndirectOwnership").alias("ownership_type"),
        _either("t.securityTitle").alias("security_title"), F.lit(None).cast("string").alias("transaction_type"))


# The names under which a JSON document holds its transactions and their fields, best first.
TABLES = ("nonDerivativeTable.nonDerivativeTransaction", "derivativeTable.derivativeTransaction")
CONTAINERS = {
    "transactions": ("transactions", "transaction", "items"),
    "nonDerivativeTransactions": ("transactions", "transaction", "items", "nonDerivativeTransaction"),
    "derivativeTransactions": ("transactions", "transaction", "items", "derivativeTransaction"),
}
SINGLES = ("transaction", "nonDerivativeTransaction", "derivativeTransaction")
JSON_FIELDS = {
    "transaction_code": ("transactionCode", "transaction_code", "code", "transactionCoding.transactionCode"),
    "transaction_date": ("transactionDate", "transaction_date", "date"),
    "shares": ("shares", "transactionShares", "transaction_shares", "amount", "transactionAmounts.transactionShares"),
    "price": ("transactionPricePerShare", "transactionPrice", "transaction_price", "price",
              "transactionAmounts.transactionPricePerShare"),
    "ownership_type": ("ownershipType", "ownership_type", "directOrIndirectOwnership", "direct_indirect",
                       "ownershipNature.directOrIndirectOwnership"),
    "security_title": ("securityTitle", "security_title", "security"),
    "transaction_type": ("transactionType", "transaction_type"),
}

_TABLES_JSON = "nonDerivativeTable: struct<nonDerivativeTransaction: string>, derivativeTable: struct<derivativeTransaction: string>"
_HEAD_JSON = "issuer: struct<issuerName: string, name: string>, reportingOwner: string"
_DOC_JSON = (f"struct<{_TABLES_JSON}, {_HEAD_JSON}, issuerName: string, ownershipDocument: struct<{_TABLES_JSON}, {_HEAD_JSON}>, "
             + ", ".join(f"{n}: string" for n in (*CONTAINERS, *SINGLES)) + ">")
_OWNER_JSON = "struct<rptOwnerName: string, reportingOwnerName: string, rptOwnerCik: string, reportingOwnerCik: string>"


def _fields_schema() -> str:
    """Every field name as text; dotted names become one level of nesting."""
    flat = dict.fromkeys(n for names in JSON_FIELDS.values() for n in names if "." not in n)
    nested: dict[str, list[str]] = {}
    for names in JSON_FIELDS.values():
        for n in names:
            if "." in n:
                outer, inner = n.split(".")
                nested.setdefault(outer, []).append(inner)
    parts = [f"{n}: string" for n in flat]
    parts += [f"{o}: struct<{', '.join(f'{i}: string' for i in inner)}>" for o, inner in nested.items()]
    return f"struct<{', '.join(parts)}>"


def _unwrapped(c: Column) -> Column:
    """``{"value": x}`` counts as ``x``."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.value")).otherwise(c)


def _objects(c: Column, single: bool = True) -> Column:
    """JSON text of a list, or of one object, as a list of object texts."""
    one = F.when(c.startswith("{"), F.array(c)) if single else F.lit(None).cast("array<string>")
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), one, F.array().cast("array<string>"))


def json_transactions(docs: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The same fields from JSON documents; elements that are no objects are left out."""
    parsed = docs.withColumn("_doc", F.from_json(column, _DOC_JSON))
    roots = ("_doc", "_doc.ownershipDocument")
    lists = [_objects(F.col(f"{r}.{t}")) for r in reversed(roots) for t in TABLES]
    for name, inner in CONTAINERS.items():
        body = F.col(f"_doc.{name}")
        lists.append(_objects(body, single=False))
        held = F.from_json(F.when(body.startswith("{"), body), f"struct<{', '.join(f'{i}: string' for i in inner)}>")
        lists += [_objects(held[i]) for i in inner]
    lists += [_objects(F.col(f"_doc.{n}")) for n in SINGLES]
    owner_text = F.coalesce(F.col("_doc.reportingOwner"), F.col("_doc.ownershipDocument.reportingOwner"))
    heads = parsed.withColumn("_owner", F.from_json(F.get(_objects(owner_text), 0), _OWNER_JSON))
    # A filter is interpreted, and so is what it is given unless that is settled.
    found = settled(heads.select(
        *keep, text.first_nonblank(F.col("_doc.issuer.issuerName"), F.col("_doc.issuer.name"), F.col("_doc.issuerName"),
                                   F.col("_doc.ownershipDocument.issuer.issuerName")).alias("issuer_name"),
        text.first_nonblank(F.col("_owner.rptOwnerName"), F.col("_owner.reportingOwnerName")).alias("insider_name"),
        text.first_nonblank(F.col("_owner.rptOwnerCik"), F.col("_owner.reportingOwnerCik")).alias("insider_cik"),
        F.concat(*lists).alias("_found")), keep)
    objects = F.filter("_found", lambda x: x.startswith("{"))
    rows = found.select(*keep, "issuer_name", "insider_name", "insider_cik", F.posexplode(objects).alias("position", "_raw"))
    typed_rows = rows.withColumn("_t", F.from_json("_raw", _fields_schema()))
    return settled(typed_rows.select(*keep, "position", "issuer_name", "insider_name", "insider_cik", *[
        text.first_nonblank(*[_unwrapped(F.col(f"_t.{n}")) for n in names]).alias(field)
        for field, names in JSON_FIELDS.items()]), [*keep, "position"])


def json_metadata(docs: DataFrame, column: str, form: str, accession: str, filed: str) -> DataFrame:
    """Form, accession and filing date: the document's own win over the index row's.

    A document is parsed once for all of them; one that is no JSON object has none.
    """
    names = {form: ("form", "formType", "form_type"), accession: ("accessionNumber", "accession_number", "accession"),
             filed: ("filingDate", "filing_date", "filedDate")}
    schema = ", ".join(f"{n}: string" for given in names.values() for n in given)
    whole = F.when(F.col(column).rlike(r"^\s*\{"), F.col(column))
    given = docs.withColumn("_own", F.from_json(whole, f"struct<{schema}>"))
    return given.withColumns({
        field: F.coalesce(text.first_nonblank(*[F.col(f"_own.{n}") for n in own]), F.col(field))
        for field, own in names.items()}).drop("_own")


def typed(rows: DataFrame, source: str = "SEC") -> DataFrame:
    """Raw transaction fields to typed rows.

    Needs ``issuer_cik, accession_number, form_type, filing_date`` next to the fields; ``error`` holds
    the first rule broken.
    """
    named = rows.withColumns({
        "form_type": F.upper(text.clean(F.col("form_type"))), "issuer_cik": text.clean(F.col("issuer_cik")),
        "accession_number": text.clean(F.col("accession_number")), "filing_date": text.clean(F.col("filing_date")),
        "_shares": numbers.parsed(numbers.strict_text(F.col("shares"))),
        "_price": numbers.parsed(numbers.strict_text(F.col("price"))),
    })
    error = F.coalesce(
        F.when(F.col("issuer_cik").isNull(), F.lit("issuer_cik is required.")),
        F.when(~F.col("issuer_cik").rlike(r"^\d+$"), F.lit("issuer_cik must contain digits only.")),
        F.when(F.col("accession_number").isNull(), F.lit("accession_number is required.")),
        F.when(F.col("form_type").isNull(), F.lit("Form type is required.")),
        F.when(~F.col("form_type").isin(*text.INSIDER_FORMS),
               F.concat(F.lit("Unsupported insider form: "), F.col("form_type"))),
        F.when(F.col("shares").isNotNull() & F.col("_shares").isNull(), F.lit("shares must be numeric.")),
        F.when(F.col("price").isNotNull() & F.col("_price").isNull(), F.lit("price must be numeric.")),
    )
    return named.withColumns({
        "source": F.lit(source), "issuer_cik": text.cik(F.col("issuer_cik")), "shares": F.col("_shares"),
        "price": F.col("_price"), "error": error,
    }).drop("_shares", "_price")

"""Expected against accepted record ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def reconcile_ids(expected: DataFrame, accepted: DataFrame, column: str = "record_id") -> DataFrame:
    """One row per distinct id with its status.

    ``status`` is MATCHED, MISSING (expected only) or UNEXPECTED (accepted only); ``is_duplicate``
    marks ids accepted more than once. Blank ids have status BLANK: the comparison is then invalid.
    """
    sides = expected.select(text.clean(F.col(column)).alias("record_id"), F.lit(1).alias("e"), F.lit(0).alias("a"))
    sides = sides.unionByName(
        accepted.select(text.clean(F.col(column)).alias("record_id"), F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    counts = sides.groupBy("record_id").agg(F.sum("e").alias("expected_count"), F.sum("a").alias("accepted_count"))
    status = (
        F.when(F.col("record_id").isNull(), "BLANK")
        .when(F.col("accepted_count") == 0, "MISSING")
        .when(F.col("expected_count") == 0, "UNEXPECTED")
        .otherwise("MATCHED")
    )
    return counts.withColumn("status", status).withColumn("is_duplicate", F.col("accepted_count") > 1)


def reconciliation_summary(ids: DataFrame) -> DataFrame:
    """Totals of :func:`reconcile_ids`; raw counts include repeats."""
    def having(condition):
        return F.count_if(condition)

    status = F.col("status")
    return ids.agg(
        F.coalesce(F.sum("expected_count"), F.lit(0)).alias("expected_count"),
        F.coalesce(F.sum("accepted_count"), F.lit(0)).alias("accepted_count"),
        having(status == "MATCHED").alias("matched_count"), having(status == "MISSING").alias("missing_count"),
        having(status == "UNEXPECTED").alias("unexpected_count"), having(F.col("is_duplicate")).alias("duplicate_count"),
        having(status == "BLANK").alias("blank_count"),
    ).withColumn(
        "complete",
        (F.col("missing_count") + F.col("unexpected_count") + F.col("duplicate_count") + F.col("blank_count")) == 0,
    )


def require_complete(summary: DataFrame) -> DataFrame:
    """The summary itself, or an error when its row is read and the comparison is not complete."""
    problem = F.concat(
        F.lit("Reconciliation is incomplete: missing="), F.col("missing_count").cast("string"),
        F.lit(", unexpected="), F.col("unexpected_count").cast("string"),
        F.lit(", duplicates="), F.col("duplicate_count").cast("string"), F.lit("."),
    )
    checked = F.when(F.col("complete"), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return summary.withColumn("complete", checked)

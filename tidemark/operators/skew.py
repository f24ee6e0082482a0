"""Lookups that survive a key holding a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 0.005  # a key with more than this share of the rows is hot, so there are at most 200
ROWS_PER_SALT = 5_000_000  # what one reducer takes of a hot key


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join where null keys match each other; the left side's key columns are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition: Column = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in on])


def hot_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    """Keys above :data:`HOT_SHARE` of the rows (no more than ``1 / HOT_SHARE``) that fill more than one reducer,
    with as many ``_salts`` as their own count fills."""
    total = counts.agg(F.sum("_rows")).scalar()
    hot = (F.col("_rows") > total * F.lit(HOT_SHARE)) & (F.col("_rows") > ROWS_PER_SALT)
    return counts.where(hot).select(*on, F.ceil(F.col("_rows") / ROWS_PER_SALT).cast("int").alias("_salts"))


def _salt(df: DataFrame, salts: Column) -> Column:
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*hashable) + F.spark_partition_id(), salts).cast("int")


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None = None,
                  how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key.

    Without ``counts`` it is a plain join: a small right side is broadcast by its size, and AQE splits a partition
    that grew too large, rows without a key included. ``counts`` may pass rows per key (``_rows``) that are at hand
    anyway; rows of a hot key are then spread over as many reducers as its count asks for, and only that key's single
    right row is copied to them. The salt depends on the row's own content and input partition only, so a task that
    is run again after a lost executor sends its rows to the same reducers. The broadcast list of hot keys is bounded
    by the share that defines it.
    """
    if counts is None:
        return left.join(right, on, how)
    hot = hot_keys(counts, on)
    spread = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), _salt(left, F.col("_salts"))).otherwise(F.lit(0))).drop("_salts")
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")

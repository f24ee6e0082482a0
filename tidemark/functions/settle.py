"""A place in the plan where expressions end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import small_methods


def settled(df: DataFrame, keep: list[str]) -> DataFrame:
    """All columns but ``keep`` computed here, once.

    The optimizer may copy a column's expression into every later filter and rule that names it. It
    does not look through a generator, so parsed text stays parsed once per row. The work itself is left to the
    projection below: a generator that is too wide to be compiled would interpret it, and repeat what is common to
    several columns. An outer generator, of one row here, gives no filter that would repeat it either.
    """
    small_methods(df.sparkSession)
    made = [c for c in df.columns if c not in keep]
    held = df.select(*keep, F.array(F.struct(*made)).alias("_settled"))
    return held.select(*keep, F.inline_outer("_settled")).select(*df.columns)

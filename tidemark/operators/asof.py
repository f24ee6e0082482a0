"""Point-in-time price lookups.

Everything here is one shuffle by symbol. Prices and probes are put into one frame, sorted newest
first, and ``lag … IGNORE NULLS`` counts price observations past the probes in between: for a probe
the first lag is the first price strictly later than the probe's date, the ``k``-th lag the ``k``-th.
A symbol's group holds one row per trading day and per distinct probe day, so it stays bounded by
the calendar however many filings the symbol has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import fresh_dir

#: A session that reads buckets by symbol deals nothing of them again for a join by symbol and more.
IN_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def price_series(prices: DataFrame, series: str = "close", source_priority: Iterable[str] = ()) -> DataFrame:
    """One row per symbol and date from raw or adjusted closes, never a mix of both.

    Rows without the chosen price are dropped. Several sources on a date collapse to one: the first
    in ``source_priority``, then the first by name.
    """
    order = list(source_priority)
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("source") == name, F.lit(i)).otherwise(rank)
    place = F.struct(rank, "source")
    px = F.col(series)
    return (
        prices.where(px.isNotNull())
        .groupBy("symbol", "price_date")
        .agg(F.min_by(px, place).alias("px"))
    )


def store_bucketed(prices: DataFrame, label: str, buckets: int) -> DataFrame:
    """Prices in a table of buckets by symbol, each sorted by symbol and date, below the shared folder.

    Its rows are dealt once, when they are stored; a lookup that is told the number of buckets shuffles probes only.
    The table's own name for the symbol differs, as a union keeps the layout of a renamed column only.
    """
    name = f"{label}_{uuid.uuid4().hex}"
    prices.withColumnRenamed("symbol", "of_symbol").repartition(buckets, "of_symbol").write.option(
        "path", fresh_dir(prices.sparkSession, label)).option("compression", "zstd").bucketBy(buckets, "of_symbol").sortBy(
        "of_symbol", "price_date").saveAsTable(name)
    return prices.sparkSession.table(name).withColumnRenamed("of_symbol", "symbol")


def observations_after(series: DataFrame, probes: DataFrame, offsets: Iterable[int], buckets: int | None = None) -> DataFrame:
    """The ``k``-th observation strictly after each probe date, for every ``k`` in ``offsets``.

    ``buckets`` is the number of buckets by symbol that the series is stored in: probes are then dealt the same way and
    the series stays where it is.

    ``series`` is ``(symbol, price_date, px)``, ``probes`` has ``symbol``, ``probe_date`` and any
    other columns. Adds ``later`` (observations after the date), ``min_px`` (lowest price of the
    whole series, null without one) and ``obs_<k>`` structs ``(date, px)``, null past the end.
    """
    extra = [c for c in probes.columns if c not in ("symbol", "probe_date")]
    observed = series.select(
        "symbol", F.col("price_date").alias("probe_date"), F.lit(1).alias("_kind"),
        F.struct(F.col("price_date").alias("date"), "px").alias("_obs"),
    )
    asked = probes.select("symbol", "probe_date", F.lit(0).alias("_kind"), *extra)
    if buckets:
        asked = asked.repartition(buckets, "symbol")
    both = observed.unionByName(asked, allowMissingColumns=True)
    over = "OVER (PARTITION BY symbol ORDER BY probe_date DESC, _kind)"
    found = {f"obs_{k}": F.expr(f"lag(_obs, {int(k)}) IGNORE NULLS {over}") for k in sorted(set(offsets))}
    running = W.partitionBy("symbol").orderBy(F.col("probe_date").desc(), "_kind").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return (
        both.withColumns({
            **found,
            "later": F.count("_obs").over(running),
            "min_px": F.min("_obs.px").over(W.partitionBy("symbol")),
        })
        .where(F.col("_kind") == 0)
        .drop("_kind", "_obs")
    )


def ordinals(series: DataFrame) -> DataFrame:
    """Position of each observation in its symbol's series and the series length."""
    by_symbol = W.partitionBy("symbol")
    return series.withColumns({
        "ordinal": F.row_number().over(by_symbol.orderBy("price_date")),
        "series_length": F.count(F.lit(1)).over(by_symbol),
    })


def adjacent_returns(series: DataFrame) -> DataFrame:
    """Fraction return of each observation over the one before it, dated at the later one.

    Rounded to 12 places, which turns the binary neighbour of an exact 5 % into 0.05.
    """
    before = F.lag("px").over(W.partitionBy("symbol").orderBy("price_date"))
    return (
        series.withColumn("_before", before)
        .where(F.col("_before").isNotNull())
        .select("symbol", F.col("price_date").alias("date"),
                F.bround(F.try_divide(F.col("px"), F.col("_before")) - 1.0, 12).alias("return"))
    )

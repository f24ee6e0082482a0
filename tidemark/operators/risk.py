"""Exposure and order checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import skew


@dataclass(frozen=True)
class Limits:
    max_position_value: float
    max_total_exposure: float
    max_order_value: float
    max_open_positions: int = 10

    def __post_init__(self) -> None:
        for name in ("max_position_value", "max_total_exposure", "max_order_value"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero.")
        if self.max_open_positions < 1:
            raise ValueError("max_open_positions must be at least 1.")


def _valued(positions: DataFrame) -> DataFrame:
    """Position values; a quantity or price that is not positive stops the job, as no total is right."""
    ok = (F.col("quantity") > 0) & (F.col("reference_price") > 0)
    value = F.when(ok, F.col("quantity") * F.col("reference_price")).otherwise(
        F.raise_error(F.lit("quantity and reference_price must be greater than zero.")).cast("double"))
    return positions.select(text.symbol(F.col("symbol")).alias("symbol"), value.alias("value"))


def exposure(positions: DataFrame) -> DataFrame:
    """Total exposure and number of open positions (rows, not distinct symbols)."""
    return _valued(positions).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_exposure"), F.count("value").alias("open_positions"))


def check_orders(orders: DataFrame, positions: DataFrame, limits: Limits) -> DataFrame:
    """Every order judged on its own against the same positions; ``reasons`` says what it breaks."""
    valued = _valued(positions)
    held = valued.groupBy("symbol").agg(F.sum("value").alias("_held"))
    totals = exposure(positions)
    ok = (F.col("quantity") > 0) & (F.col("reference_price") > 0)
    priced = orders.withColumn("symbol", text.symbol(F.col("symbol"))).withColumn(
        "order_value", F.when(ok, F.col("quantity") * F.col("reference_price")))
    joined = skew.salted_lookup(priced, held, ["symbol"]).withColumns({
        "existing_exposure": totals.select("total_exposure").scalar(),
        "_open": totals.select("open_positions").scalar(),
    })
    value = F.col("order_value")
    opens = F.col("_open") + F.when(F.col("_held").isNull(), 1).otherwise(0)
    reasons = text.errors(
        F.when(F.col("symbol").isNull(), F.lit("symbol cannot be empty.")),
        F.when(value.isNull(), F.lit("quantity and reference_price must be greater than zero.")),
        F.when(value > limits.max_order_value, F.lit("Order value exceeds the maximum order-value limit.")),
        F.when(F.coalesce(F.col("_held"), F.lit(0.0)) + value > limits.max_position_value,
               F.lit("Projected position value exceeds the maximum position-value limit.")),
        F.when(F.col("existing_exposure") + value > limits.max_total_exposure,
               F.lit("Projected total exposure exceeds the maximum total-exposure limit.")),
        F.when(opens > limits.max_open_positions,
               F.lit("Projected open-position count exceeds the configured limit.")),
    )
    return joined.withColumns({"projected_exposure": F.col("existing_exposure") + value, "reasons": reasons}).withColumn(
        "approved", F.size("reasons") == 0).drop("_held", "_open")

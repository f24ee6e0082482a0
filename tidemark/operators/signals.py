"""Signal decisions, creation, classification and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.operators import skew


@dataclass(frozen=True)
class Criteria:
    """Inclusive thresholds a study summary must reach."""

    minimum_event_count: int = 30
    minimum_positive_event_rate_pct: float = 55.0
    minimum_mean_return_pct: float = 0.0

    def __post_init__(self) -> None:
        if self.minimum_event_count < 1:
            raise ValueError("minimum_event_count must be at least 1.")


def decide(summaries: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Adds ``reasons`` (what falls short, in rule order) and ``qualified``."""
    n, rate, mean = F.col("event_count"), F.col("positive_event_rate_pct"), F.col("mean_return_pct")
    reasons = text.errors(
        F.when(n < criteria.minimum_event_count, F.lit("Insufficient event count.")),
        F.when(rate.isNull(), F.lit("Positive-event rate is unavailable."))
        .when(rate < criteria.minimum_positive_event_rate_pct,
              F.lit("Positive-event rate is below the required threshold.")),
        F.when(mean.isNull(), F.lit("Mean return is unavailable."))
        .when(mean < criteria.minimum_mean_return_pct, F.lit("Mean return is below the required threshold.")),
    )
    return summaries.withColumn("reasons", reasons).withColumn("qualified", F.size("reasons") == 0)


def create_signals(summaries: DataFrame, signal_date: str, signal_type: str, methodology: str,
                   criteria: Criteria = Criteria()) -> DataFrame:
    """One signal per qualified summary row of ``(symbol, horizon_days, …)``."""
    for name, value in (("signal_date", signal_date), ("signal_type", signal_type),
                        ("methodology_version", methodology)):
        if not value.strip():
            raise ValueError(f"{name} cannot be empty.")
    day, kind, version = F.lit(signal_date.strip()), F.lit(signal_type.strip()), F.lit(methodology.strip())
    symbol = text.clean(F.col("symbol"))
    rationale = F.format_string(
        "Qualified from event-study research. Events=%d; positive_rate=%.4f%%; mean_return=%.4f%%; "
        "horizon=%d observations.",
        F.col("event_count"), F.col("positive_event_rate_pct"), F.col("mean_return_pct"), F.col("horizon_days"),
    )
    return decide(summaries, criteria).where(F.col("qualified")).select(
        hashing.signal_key(symbol, day, kind, version, F.col("horizon_days"), F.col("event_count")).alias("signal_key"),
        symbol.alias("symbol"), day.alias("signal_date"), kind.alias("signal_type"),
        (F.col("positive_event_rate_pct") + F.col("mean_return_pct")).alias("score"),
        rationale.alias("rationale"), version.alias("methodology_version"),
    )


def to_record(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in column ``record``, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def symbol_stats(returns: DataFrame) -> DataFrame:
    """Return count, positive rate as a fraction and mean per symbol; 0.0 where there is no return."""
    r = F.col("return")
    n = F.count(r)
    positive = F.sum(F.when(r > 0, 1).otherwise(0))
    return returns.groupBy("symbol").agg(
        n.alias("return_count"),
        F.coalesce(positive / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("positive_rate"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_return"),
    )


def classify(returns: DataFrame, minimum_event_count: int = 30, minimum_positive_rate: float = 0.55,
             minimum_mean_return: float = 0.0) -> DataFrame:
    """INSUFFICIENT_DATA, SIGNAL or NO_SIGNAL per symbol."""
    if minimum_event_count < 1:
        raise ValueError("minimum_event_count must be at least 1.")
    good = (F.col("positive_rate") >= minimum_positive_rate) & (F.col("mean_return") >= minimum_mean_return)
    return symbol_stats(returns).withColumn(
        "signal",
        F.when(F.col("return_count") < minimum_event_count, "INSUFFICIENT_DATA").when(good, "SIGNAL").otherwise(
            "NO_SIGNAL"),
    )


def later_repeats(df: DataFrame, key: str, index: str) -> DataFrame:
    """Adds ``is_repeat``: another row with the same key has a smaller ``index``."""
    firsts = df.groupBy(key).agg(F.min(index).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    marked = skew.salted_lookup(df, firsts.drop("_rows"), [key], firsts.select(key, "_rows"))
    return marked.withColumn("is_repeat", F.col(index) > F.col("_first")).drop("_first")


def validate_signals(signals: DataFrame, index: str = "input_index") -> DataFrame:
    """Adds ``errors``: blank fields, and keys already seen at a smaller index."""
    fields = ("signal_key", "symbol", "signal_date", "signal_type", "methodology_version")
    blanks = [F.when(text.clean(F.col(f)).isNull(), F.lit(f"{f} is empty.")) for f in fields]
    # A null key must still meet itself in the lookup.
    keyed = signals.withColumn("signal_key", F.coalesce("signal_key", F.lit("")))
    marked = later_repeats(keyed, "signal_key", index)
    repeat = F.when(F.col("is_repeat"), F.lit("signal_key is duplicated."))
    return marked.withColumn("errors", text.errors(*blanks, repeat)).drop("is_repeat")

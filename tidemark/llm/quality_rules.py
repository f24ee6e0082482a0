"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches.

Base rules are fixed: too few words, or too many words in repeated five-word windows. Three rates then get fences
from the corpus itself: symbols among word characters, repeated lines among lines, characters per word. The sketch
of a rate is the number of documents in each of its integer steps (a histogram of fixed steps, so its quantiles
are exact to one step and two sketches merge by adding counts). Counting is aggregated before the shuffle, so a
source with a third of all rows costs no more than any other. Steps of ``EXACT`` or more are taken together by their
leading binary digits, to one part in a thousand, so a sketch of any range has few rows and no quartile is clipped.

A fence lies ``REACH`` times the middle half's width (or the rate's least width, if that is more) beyond the middle
half. The quartiles of a language and source are drawn towards those of its language, as if ``PRIOR`` documents of the
language's own quartiles were among its own, and those of a language towards those of all documents: a group's own
documents count the more the more there are, at every size. Fences are joined back on language and source, null being
a value of its own; the fence table is staged, so the planner broadcasts it only while its files are small.

Only DataFrame functions are used. Defined results: null, empty and blank texts have no words and fail the base
rules; repeated rows are judged one by one; no rows give no rows; columns of other names pass through ``accepted``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

EXACT = 2048
PRIOR = 50
#: rate: (steps a unit, least width of the middle half in steps, reach below, reach above); 0: no fence on that side.
RATES = {
    "symbols": (1000, 10, 0, 3),
    "lines": (1000, 150, 0, 3),
    "length": (10, 5, 12, 12),
}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row."""
    return F.transform(F.array(value), then)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the given ascending places."""
    return F.aggregate(
        F.transform(starts, lambda x, j: F.when(
            j + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, j + 1) - x)).otherwise(F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x)


def _repeated_places(windows: Column) -> Column:
    """Places of windows that occur twice or more: equal ones are neighbours once sorted."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(placed, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                 | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"]))),
        lambda x: x["i"])))


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)]))
    repeats = _let(hashes, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(
        _repeated_places(w), _covered)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, repeats).otherwise(F.lit(0)).cast("bigint")


def repeat_words(text: Column) -> Column:
    """Words inside five-word windows found twice or more in the text.

    Windows are compared by a 64-bit hash of their five words, within one text.
    """
    return _let(_words(text), _repeat_words)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def cheap_statistics(text: Column) -> dict[str, Column]:
    """Counts that the rates are made of."""
    filled = F.coalesce(text, F.lit(""))
    count = _let(_lines(filled), lambda x: F.struct(
        F.size(x).cast("bigint").alias("all"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("repeated")))
    return {
        "n_words": F.regexp_count(filled, F.lit(WORD)).cast("bigint"),
        "word_chars": F.length(_without(filled, SPACES)).cast("bigint"),
        "n_symbols": (F.length(filled) - F.length(_without(filled, SYMBOLS))).cast("bigint"),
        "lines": count,
    }


def rates(frame: DataFrame) -> DataFrame:
    """Integer steps of each rate, null for a text without words."""
    def steps(name: str, above: str, below: str) -> Column:
        return F.when(F.col("n_words") > 0, F.expr(f"({RATES[name][0]} * {above}) div {below}"))

    return frame.withColumns({
        "r_symbols": steps("symbols", "n_symbols", "word_chars"),
        "r_lines": steps("lines", "n_dup_lines", "n_lines"),
        "r_length": steps("length", "word_chars", "n_words"),
    })


def _beyond(step: Column) -> Column:
    """Binary digits of a step beyond those that are kept; none below ``EXACT``."""
    return F.greatest(F.length(F.bin(step)) - F.lit(EXACT.bit_length() - 1), F.lit(0))


def _coarse(step: Column) -> Column:
    """The smallest step that is taken together with ``step``."""
    return F.call_function("shiftleft", F.call_function("shiftright", step, _beyond(step)), _beyond(step))


def _last(step: Column) -> Column:
    """The largest step that is taken together with ``step``."""
    return step + F.call_function("shiftleft", F.lit(1).cast("bigint"), _beyond(step)) - 1


def sketches(frame: DataFrame) -> DataFrame:
    """Documents per language, source, rate and step."""
    entries = F.array(*[F.struct(F.lit(name).alias("rate"), _coarse(F.col(f"r_{name}")).alias("step")) for name in RATES])
    return frame.where("n_words > 0").select("lang", "source", F.explode(entries).alias("e")).groupBy(
        "lang", "source", F.col("e.rate").alias("rate"), F.col("e.step").alias("step")).agg(F.count("*").alias("docs"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """One sketch per value of ``keys`` and rate: counts of the same step are added."""
    return sketch.groupBy(*keys, "rate", "step").agg(F.sum("docs").alias("docs"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per key and rate: documents, lower and upper quartile in steps."""
    run = Window.partitionBy(*keys, "rate").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "rate")
    ranked = sketch.withColumn("upto", F.sum("docs").over(run)).withColumn("n", F.sum("docs").over(whole))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("n").alias("n"), F.min(F.when(F.expr("4 * upto >= n"), F.col("step"))).alias("q1"),
        _last(F.min(F.when(F.expr("4 * upto >= 3 * n"), F.col("step")))).alias("q3"))


def _drawn(own: str, towards: str, quartile: str) -> Column:
    """A quartile of ``own`` with ``PRIOR`` documents of the one it is drawn towards, in whole steps."""
    return F.expr(f"({own}.n * {own}.{quartile} + {PRIOR} * {towards}.{quartile}) div ({own}.n + {PRIOR})")


LIMITS = tuple(f"{name}_{side}" for name, (_, _, lo, hi) in RATES.items() for side, on in (("lo", lo), ("hi", hi)) if on)


def fence_table(frame: DataFrame) -> DataFrame:
    """Fences of every language and source of ``frame`` (with its rates), staged."""
    fine = stage(sketches(frame), "quality-sketches")
    every, lang, source = quartiles(merged(fine)).alias("a"), quartiles(merged(fine, "lang"), "lang").alias("l"), quartiles(
        fine, "lang", "source").alias("s")
    langs = lang.join(every, F.col("l.rate") == F.col("a.rate")).select(
        "l.lang", "l.rate", *[_drawn("l", "a", q).alias(q) for q in ("q1", "q3")]).alias("d")
    drawn = source.join(langs, F.col("s.lang").eqNullSafe(F.col("d.lang")) & (F.col("s.rate") == F.col("d.rate"))).select(
        F.col("s.lang").alias("f_lang"), F.col("s.source").alias("f_source"), "s.rate", *[_drawn("s", "d", q).alias(q) for q in ("q1", "q3")])
    out = []
    for name, (_, least, below, above) in RATES.items():
        width = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        own = F.col("rate") == name
        if below:
            out.append(F.max(F.when(own, F.col("q1") - below * width)).alias(f"{name}_lo"))
        if above:
            out.append(F.max(F.when(own, F.col("q3") + above * width)).alias(f"{name}_hi"))
    return stage(drawn.groupBy("f_lang", "f_source").agg(*out), "fences")


def _with_statistics(docs: DataFrame, *more: Column) -> DataFrame:
    base = docs.select(*more, F.col("lang"), F.col("source"), F.col("text"))
    found = base.withColumns(cheap_statistics(F.col("text")))
    return rates(found.withColumns({"n_lines": F.col("lines.all"), "n_dup_lines": F.col("lines.repeated")}).drop("lines"))


def judged(docs: DataFrame, *more: Column) -> DataFrame:
    """Statistics and verdicts per row of ``docs`` (text, lang, source), after the columns ``more``."""
    limits = fence_table(_with_statistics(docs))
    full = _with_statistics(docs, *more).withColumn("n_repeat_words", repeat_words(F.coalesce("text", F.lit(""))))
    full = full.withColumn("base_failed", F.expr(
        f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))
    joined = full.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")),
                       "left")
    inside = F.lit(True)
    for x in LIMITS:
        name, side = x.split("_")
        inside = inside & (F.col(f"r_{name}") >= F.col(x) if side == "lo" else F.col(f"r_{name}") <= F.col(x))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept."""
    return judged(docs, F.col("doc_id")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judged(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")).where("kept").select(
        "whole_row.*")

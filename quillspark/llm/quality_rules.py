"""Quality rules: one threshold table compiled into a single native projection.

Every figure is a Catalyst expression over the text, so the scan, the figures and the verdict are one
map-only stage: no shuffle, no Python, memory bounded by one document.

Defined results: a null text counts as empty (all figures 0, ``base_failed``); rows with a null ``doc_id``
and repeated rows are judged like any other row, each on its own; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Very frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au dans de des du en est et la le les par pas pour que qui sur un une "
    "das der die ein eine für ist mit nicht und von zu "
    "al asi con del el es los las no para por se su y"
).split()
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """A figure must lie within [low, high]; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are compared by multiplication, so no rounding and no division by zero.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.3),
    Rule("upper_ratio", "n_upper_words", "n_words", None, 0.6),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice (window identity: XXH64)."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return let(
        F.sort_array(windows),
        lambda s: F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                        ),
                        lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                    )
                )
            )
        ),
    ).cast("long")


def _verdict(rules: tuple[Rule, ...]) -> Column:
    checks = [F.lit(True)]
    for r in rules:
        num, den = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        if r.low is not None:
            checks.append(num >= den * F.lit(float(r.low)))
        if r.high is not None:
            checks.append(num <= den * F.lit(float(r.high)))
    return reduce(lambda a, b: a & b, checks)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the figures, base_failed and kept, one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    figures = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, F.size(w)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))).cast("long").alias("n_upper_words"),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    base = docs.select("doc_id", figures.alias("f"), lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    flat = base.select(
        "doc_id", "f.n_words", "f.word_chars", "n_symbols", "l.n_dup_lines", "f.n_repeat_words",
        "f.n_stop_words", "f.n_upper_words", "l.n_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & _verdict(rules))

"""Quality rules: a threshold table compiled into column expressions, with no user functions.

Measures are built from the text alone, row by row, so the plan has no shuffle. Words are runs
of anything but space, tab, LF, VT, FF and CR. A 3-word window is identified by a 64-bit hash.

Defined results: a null or empty text has no words, every count is 0 and it fails the base
rule; other columns of the input, also ones named like a measure, are kept out of the way by
``assess`` returning only the key and its measures.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be at by this from an not or have but "
    "der die das und von den ist mit zu des im sich auf für nicht ein eine als auch dem "
    "le la les de des et un une en du que est pour dans qui sur au par pas avec "
    "el los las y que se del por con una su para es lo como al"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range it must lie in; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        value, parts = F.col(self.measure), []
        if self.least is not None:
            parts.append(value < F.lit(self.least))
        if self.most is not None:
            parts.append(value > F.lit(self.most))
        found = parts[0] if parts else F.lit(False)
        for part in parts[1:]:
            found = found | part
        return F.coalesce(found, F.lit(False))


# The method's thresholds. A measure without a base (no words, no lines) is null and breaks nothing.
RULES = (
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("marks", "mark_ratio", most=0.3),
    Rule("word_length", "mean_word_length", least=2.0, most=16.0),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("copied_lines", "dup_line_ratio", most=0.5),
    Rule("letters", "letter_ratio", least=0.5),
)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, counts and ratios."""
    body = F.col("_text")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("_key", "_text", words_of(body).alias("_words"))
    rows = rows.select(
        "_key",
        F.size("_words").cast("long").alias("n_words"),
        _without(body, SPACES).cast("long").alias("word_chars"),
        F.length(body).cast("long").alias("n_chars"),
        (F.length(body) - _without(body, SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[!?|#$%&*=~^<>]")).cast("long").alias("n_marks"),
        F.regexp_count(body, F.lit("[\\p{L}\\p{N}]")).cast("long").alias("n_letters"),
        F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("_words") >= 3,
            F.slice(
                F.transform(
                    "_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
                ),
                F.lit(1),
                F.size("_words") - 2,
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_windows"),
    )
    # Only texts that repeat a window at all are sorted: equal windows then stand side by side.
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    rows = rows.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda x, k: x["h"].eqNullSafe(F.get("_sorted", k + 1)["h"])
                    | x["h"].eqNullSafe(F.get("_sorted", k - 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform("_starts", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - at, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    counted = rows.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_chars",
        "n_symbols",
        "n_marks",
        "n_letters",
        "n_stop_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return counted.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_length"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_marks", "n_words").alias("mark_ratio"),
        _ratio("n_letters", "word_chars").alias("letter_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def base_failed() -> Column:
    """Too short, or more than half of the words stand in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """Measures with ``base_failed``, the names of the broken ``rules`` and ``kept``."""
    broken = F.array_compact(F.array(*[F.when(rule.broken(), F.lit(rule.name)) for rule in rules]))
    return (
        measures(docs, key, text)
        .withColumn("base_failed", base_failed())
        .withColumn("broken_rules", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, whole and with all their columns.

    The row travels beside its measures in one struct, so nothing is joined back. The observed count keeps
    the optimiser from moving the filter below the measures, where its condition would repeat them all.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    verdict = assess(whole, "row", "text", rules)
    seen = verdict.select("row", "kept").observe(f"assessed-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return seen.filter("kept").select("row.*")

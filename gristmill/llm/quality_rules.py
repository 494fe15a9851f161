"""Quality rules: a table of thresholds, compiled into SQL expressions over measures of a text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts

# White space between words, and the symbols that are counted.
SPACE = r"[\\x20\\x09-\\x0D]+"
NO_SYMBOL = "[^#*$%&|<>]+"

# Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is it that for was on with as be by at this are from not or an "
    "le la les des du de un une et en que qui dans pour par est sur au avec "
    "el los las del y se su con una al lo para es "
    "der die das und ist von den mit auf für ein eine im zu sich dem nicht"
).split()


class Measure(NamedTuple):
    name: str
    expression: str


class Rule(NamedTuple):
    """A text passes when low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


# Ratios that the rules look at, over the counted columns. Empty texts have 0 everywhere.
MEASURES = (
    Measure("mean_word_length", "word_chars / greatest(n_words, 1)"),
    Measure("symbol_ratio", "n_symbols / greatest(n_words, 1)"),
    Measure("stop_word_ratio", "n_stop_words / greatest(n_words, 1)"),
    Measure("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)"),
    Measure("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)"),
    Measure("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)"),
    Measure("words_per_line", "n_words / greatest(n_lines, 1)"),
)

RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_length", 2.5, 10),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.04, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def measure_texts(docs: DataFrame) -> DataFrame:
    """Counts of every text, one row per input row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
    n_bullet_lines, n_ellipsis_lines. A missing text counts as empty, which gives 0 everywhere.
    A word is compared as written, stop words in lower case. Other columns are left out.
    """
    texts = keyed_texts(docs)
    # Arrays are made in a step of their own, so that each is computed once per row.
    split = texts.select(
        "doc_id",
        "text",
        F.expr(rf"filter(split(text, '{SPACE}'), w -> w != '')").alias("words"),
        F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    stop_words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    windows = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr("length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NO_SYMBOL, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(words, w -> lower(w) in ({stop_words})))").cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("size(filter(lines, l -> ltrim(l) rlike '^[-*•]'))").cast("long").alias("n_bullet_lines"),
        F.expr("size(filter(lines, l -> rtrim(l) rlike '(\\\\.\\\\.\\\\.|…)$'))").cast("long").alias("n_ellipsis_lines"),
        F.expr(
            "CASE WHEN size(words) < 3 THEN array() ELSE zip_with(words, zip_with(slice(words, 2, size(words)), "
            "slice(words, 3, size(words)), (b, c) -> CASE WHEN c IS NOT NULL THEN struct(b, c) END), "
            "(a, t) -> CASE WHEN t IS NOT NULL THEN xxhash64(a, t.b, t.c) END) END"
        ).alias("padded"),
    )
    windows = windows.withColumn("windows", F.array_compact("padded")).drop("padded")
    # Lambdas here look at nothing but their own arguments: if the optimizer moves these expressions into
    # a filter, an array is computed anew a few times per row, not once per element.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    in_order = F.when(repeated, F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))"))
    ordered = windows.withColumn("in_order", in_order).drop("windows")
    # Equal windows stand next to each other; both of such a pair are repeated ones.
    pairs = "zip_with(in_order, slice(in_order, 2, size(in_order)), (s, t) -> CASE WHEN s.h = t.h THEN array(s.i, t.i) END)"
    places = ordered.withColumn(
        "places", F.expr(f"sort_array(array_distinct(flatten(filter({pairs}, p -> p IS NOT NULL))))")
    ).drop("in_order")
    # Each such window covers three words, fewer when the next one starts before its end.
    covered = "zip_with(places, slice(places, 2, size(places)), (p, q) -> least(3, coalesce(q, p + 3) - p))"
    repeats = F.coalesce(F.expr(f"aggregate({covered}, 0, (a, x) -> a + x)"), F.lit(0)).cast("long")
    return places.withColumn("n_repeat_words", repeats).drop("places")


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The counts with their ratios and `failed`, the names of the rules that a text does not pass."""
    rated = measured.withColumns({m.name: F.expr(m.expression) for m in MEASURES})
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        broken.append(F.when(out, F.lit(rule.measure)))
    return rated.withColumn("failed", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, failed and kept.

    base_failed: fewer than 50 words, or more than half of them in three-word windows that occur
    twice or more. kept: neither base_failed nor any rule broken. Cases: see measure_texts.
    """
    judged = judge(measure_texts(docs), rules)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", base_failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))

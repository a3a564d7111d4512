"""Quality rules: a threshold table compiled into one projection of built-in expressions (no user functions, no shuffle).

Words are ``[^\\x20\\x09-\\x0D]+``. ``measures`` holds the base counts and the ratios; ``RULES`` is the threshold table; and
``compile_rules`` turns it into one Boolean column and one list of the rules that failed.

Three-word windows are compared by a 64-bit hash within one document: the windows are sorted by (hash, place), equal
neighbours are repeated, and the words that they cover are summed from the gaps between their places. This takes
n log n steps for n words, so that very long documents pass too.

Defined results: null text has no words; a document without words fails on length and has ratios of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages, in lower case.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "a", "is", "it", "for", "on", "was", "as"],
    "fr": ["de", "la", "le", "et", "les", "des", "que", "un", "une", "est", "en", "qui", "dans", "pour", "du", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "ein", "eine", "im"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
}


@dataclass(frozen=True)
class Rule:
    """A measure and the range in which a document is kept; a bound of None is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table of the method.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)


def word_array(text: Column) -> Column:
    """The words of a text, as an array."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (any columns but the added ones) with the base counts and ratios; the steps stay apart so that none is computed twice."""
    own = {n: fresh(docs, n) for n in ("t", "w", "l", "stop", "bullet", "dots", "h", "p")}
    step = docs.withColumn(own["t"], F.coalesce(F.col(text).cast("string"), F.lit("")))
    step = step.withColumns({own["w"]: word_array(F.col(own["t"])), own["l"]: F.filter(F.split(own["t"], "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    step = step.withColumns(
        {
            "n_words": F.size(own["w"]).cast("long"),
            "word_chars": F.length(F.translate(own["t"], BLANKS, "")).cast("long"),
            "n_symbols": (F.length(own["t"]) - F.length(F.translate(own["t"], SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(own["l"]).cast("long"),
            "n_dup_lines": (F.size(own["l"]) - F.size(F.array_distinct(own["l"]))).cast("long"),
            own["stop"]: F.size(F.filter(own["w"], lambda x: F.lower(x).isin(sorted({w for words in STOP_WORDS.values() for w in words})))),
            own["bullet"]: F.size(F.filter(own["l"], lambda x: F.btrim(x, F.lit(BLANKS)).rlike(r"^[-*•]"))),
            own["dots"]: F.size(F.filter(own["l"], lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
            own["h"]: F.when(F.size(own["w"]) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(own["w"]) - 3), lambda i: F.struct(F.xxhash64(F.get(own["w"], i), F.get(own["w"], i + 1), F.get(own["w"], i + 2)).alias("h"), i.alias("i"))))),
        }
    )
    beside = lambda x, j: F.coalesce(F.get(own["h"], j)["h"] == x["h"], F.lit(False))
    step = step.withColumn(own["p"], F.sort_array(F.transform(F.filter(own["h"], lambda x, j: beside(x, j - 1) | beside(x, j + 1)), lambda x: x["i"])))
    gaps = F.aggregate(F.transform(own["p"], lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(own["p"], j - 1)))), F.lit(0), lambda a, b: a + b)
    step = step.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    step = step.withColumns({"mean_word_length": part("word_chars", "n_words"), "symbol_ratio": part("n_symbols", "n_words"), "stop_word_ratio": part(own["stop"], "n_words"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "bullet_line_ratio": part(own["bullet"], "n_lines"), "ellipsis_line_ratio": part(own["dots"], "n_lines")})
    return step.drop(*own.values())


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The threshold table as (kept, names of the rules that failed)."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.measure) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.measure) > r.most)
        broken.append(F.when(bad, F.lit(r.name)))
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return F.size(failed) == 0, failed


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with measures, base_failed, kept and failed_rules. Columns of docs whose names are added here are replaced."""
    ok, failed = compile_rules(rules)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumns({"kept": ~F.col("base_failed") & ok, "failed_rules": failed})

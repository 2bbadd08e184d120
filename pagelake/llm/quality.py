"""Quality rules: a table of thresholds compiled into one projection of ratios, without user functions.

``measures`` turns a text into counts (words, symbols, stop words, lines, repeated words), ``RATIOS`` names what rules may
bound, and ``compile_rules`` makes of a table of rules (rule, measure, low, high) one list of the rules that a row
breaks. All of it is one map-side projection; no row moves and a document's cost is that of sorting its words at most.

A null text counts as empty: no words, hence below the least number of words. Every row is judged by its own text, so
repeated rows, ties and null ids get the verdict of their text. A ratio whose base is zero is null and breaks no rule. An
empty table of rules breaks nothing. Further columns of the documents come through under any name but that of a column
the operator writes, which it replaces.

Repeated windows are found by 64-bit hashes of eight words; equal hashes are compared word by word with their neighbour
in hash order.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS, WORD, BLANKS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Signs that are left out of words before they are compared with stop words.
SIGNS = ".,;:!?\"'()"
#: Frequent function words of the languages the corpus is meant to hold.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from",
    "de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec", "qui", "pas", "sur", "au",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als",
    "el", "y", "los", "las", "se", "del", "por", "con", "no", "una", "su", "para", "es", "al", "lo",
]


class Rule(NamedTuple):
    """A measure and the bounds it has to stay in; a null bound is none."""

    rule: str
    measure: str
    low: float | None
    high: float | None


#: What the contract fixes.
BASE = [Rule("few_words", "n_words", 20, None), Rule("repeated_words", "repeat_ratio", None, 0.3)]
RULES = [
    Rule("word_length", "mean_word", 3.0, 10.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("words_without_letter", "letter_ratio", 0.8, None),
    Rule("stop_words", "stop_ratio", 0.05, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("listed_lines", "bullet_ratio", None, 0.9),
    Rule("cut_lines", "ellipsis_ratio", None, 0.3),
    Rule("exclamations", "shout_ratio", None, 0.5),
]
#: Ratios the rules may bound besides the counts: numerator, denominator.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "letter_ratio": ("n_letter_words", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"), "shout_ratio": ("n_shouts", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_ratio": ("n_bullet_lines", "n_lines"), "ellipsis_ratio": ("n_ellipsis_lines", "n_lines"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_stop_words", "n_shouts", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _size(a: Column, keep=None) -> Column:
    return F.size(F.filter(a, keep) if keep else a).cast("bigint")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in ``words``."""
    last = F.size(words) - WINDOW
    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def same(a, b):
        text = lambda at: F.slice(words, at["p"] + 1, WINDOW)
        return F.coalesce((a["h"] == b["h"]) & (text(a) == text(b)), F.lit(False))

    def starts(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(ordered, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(x, F.get(s, i + 1)) | same(F.get(s, i - 1), x), x["p"])), lambda p: p.isNotNull()))
        return F.sort_array(twice)

    def covered(h):
        reach = lambda q: F.transform(q, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(let(starts(h), reach), F.lit(0).cast("bigint"), lambda n, x: n + x)

    # Most texts repeat no window: a hash set tells.
    return F.when(last < 0, F.lit(0).cast("bigint")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))))


def measures(text: Column) -> Column:
    """Struct of the counts of ``COUNTS``."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w):
        return [
            _size(w).alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            repeat_words(w).alias("n_repeat_words"),
            _size(w, lambda x: x.rlike(r"\p{L}")).alias("n_letter_words"),
            _size(F.split(F.lower(F.translate(t, SIGNS, "")), SEPARATORS), lambda x: x.isin(STOP_WORDS)).alias("n_stop_words"),
            _size(w, lambda x: x.endswith("!")).alias("n_shouts"),
        ]

    def of_lines(lines):
        return [
            _size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _size(lines, lambda x: x.rlike("^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
            _size(lines, lambda x: x.rlike("([.]{3}|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
        ]

    split = F.filter(F.split(t, SEPARATORS), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(split, lambda w: let(lines, lambda x: F.struct(*of_words(w), *of_lines(x))))


def _measure(m: Column, name: str) -> Column:
    if name in RATIOS:
        over, under = RATIOS[name]
        return m[over] / F.nullif(m[under], F.lit(0))
    if name not in COUNTS:
        raise ValueError(f"unknown measure {name!r}")
    return m[name]


def compile_rules(m: Column, rules: Iterable[Rule]) -> Column:
    """Names of the rules that the measures ``m`` break, in the order of the table."""
    broken = []
    for r in rules:
        x = _measure(m, r.measure)
        out = F.lit(False)
        if r.low is not None:
            out = out | (x < F.lit(float(r.low)))
        if r.high is not None:
            out = out | (x > F.lit(float(r.high)))
        broken.append(F.when(F.coalesce(out, F.lit(False)), F.lit(r.rule)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def rules_of(table: DataFrame, at_most: int = 1000) -> list[Rule]:
    """Rules of a table with columns rule, measure, low, high, in the order of their names; more than ``at_most`` are refused."""
    rows = table.select("rule", "measure", F.col("low").cast("double"), F.col("high").cast("double")).orderBy("rule", "measure").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} rules")
    return [Rule(*r) for r in rows]


def judge(docs: DataFrame, rules: Iterable[Rule] = RULES, base: Iterable[Rule] = BASE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with all counts, base_failed, broken (names of broken rules) and kept."""
    own = [*COUNTS, "base_failed", "broken", "kept"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    m = F.col("__m")
    measured = docs.select(*kept, measures(F.col(text)).alias("__m"))
    failed = measured.select(*kept, "__m", compile_rules(m, base).alias("__base"), compile_rules(m, rules).alias("__own"))
    return failed.select(
        *kept, *[m[c].alias(c) for c in COUNTS], (F.size("__base") > 0).alias("base_failed"), F.concat("__base", "__own").alias("broken"),
        ((F.size("__base") == 0) & (F.size("__own") == 0)).alias("kept"),
    )

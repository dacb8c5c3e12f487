"""Operator 1: quality rules, compiled from a table of thresholds into one projection of built-in functions.

A rule names a metric, whether its bound is a floor or a ceiling, and the least number of words at which the
metric means anything. Metrics are Spark expressions over the text alone; no user functions, no shuffle.

Defined cases: a null text has no words (all counts 0, base_failed); an empty text likewise; very long texts cost
n log n in their words and only where windows repeat; repeated rows are judged alike; extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import fresh, let

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that it with as for was on be at by this are from or "
    "der die und in den von zu das mit sich des ist ein eine auf nicht dem im für "
    "de la les et des le un une dans est pour que qui sur par au avec "
    "el los y en las del se una con por su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    metric: str
    bound: float
    ceiling: bool = True
    from_words: int = 0

    def passes(self, value: Column, words: Column) -> Column:
        held = value <= F.lit(self.bound) if self.ceiling else value >= F.lit(self.bound)
        return held if not self.from_words else (words < self.from_words) | held


RULES = (
    Rule("mean_word_chars", 2.0, ceiling=False),
    Rule("mean_word_chars", 16.0),
    Rule("symbols_per_word", 0.10),
    Rule("upper_share", 0.40, from_words=10),
    Rule("stop_word_share", 0.02, ceiling=False, from_words=50),
    Rule("dup_line_share", 0.50, from_words=50),
)


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window found twice or more. Sorting (hash, start) puts equal windows side by side."""

    def starts(pairs: Column) -> Column:
        same = lambda p, q: F.get(pairs, p)["h"] == F.get(pairs, q)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(at, lambda j: F.get(pairs, j)["i"]))

    def covered(found: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, s: F.struct((acc["n"] + s + window - F.greatest(s, acc["end"])).cast("bigint").alias("n"), (s + window).alias("end"))
        return F.aggregate(found, zero, step)["n"]

    def over(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, let(pairs, lambda p: covered(starts(p)))).otherwise(F.lit(0).cast("bigint"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) > window, let(hashes, over)).otherwise(F.lit(0).cast("bigint"))


def _measures(text: Column) -> Column:
    """One struct of counts, its arrays bound once per row."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    upper = "".join(map(chr, range(65, 91)))

    def struct(w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w, WINDOW).alias("n_repeat_words"),
            F.size(F.filter(w, lambda v: F.lower(v).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
            (F.char_length(text) - F.char_length(F.translate(text, upper, ""))).cast("bigint").alias("n_upper"),
        )

    return let(words, lambda w: let(lines, lambda x: struct(w, x)))


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    words = m["n_words"]
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    metrics = {
        "mean_word_chars": ratio(m["word_chars"], words),
        "symbols_per_word": ratio(m["n_symbols"], words),
        "upper_share": ratio(m["n_upper"], m["word_chars"]),
        "stop_word_share": ratio(m["n_stop_words"], words),
        "dup_line_share": ratio(m["n_dup_lines"], m["n_lines"]),
        "repeat_share": ratio(m["n_repeat_words"], words),
        "n_words": words,
    }
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes(metrics[rule.metric], words)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str | None = None) -> DataFrame:
    """Every row of docs with a struct column behind the others: the counts, base_failed and kept. It is called `quality`, with underscores behind it
    if docs have such a column; a column named by `out` is replaced."""
    out = out or next(fresh(docs, "quality"))
    counts = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_stop_words n_upper".split()

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in counts], failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))

    return docs.withColumn(out, let(_measures(F.col(f"`{text}`")), judged))

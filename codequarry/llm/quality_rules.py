"""Quality rules: a threshold table compiled into one projection over whole texts, without user functions.

A text is measured once (lengths, symbols, stop words, lines, repeated three-word windows), each rule
of the table compares one ratio with its bounds, and the verdicts are ordinary Boolean columns. No row
is shuffled; nothing leaves the JVM.

Defined results: a null or blank text has no words and fails the base rule; ratios of a text without
words are 0; very long texts are measured whole; equal rows get equal verdicts; an empty table gives
an empty result; other columns are carried along untouched by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Carried, let, pick, words_of

# Frequent function words of the four languages that the stop-word rule knows.
STOP_WORDS = {
    "en": [
        "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by", "this", "are", "at", "from",
    ],
    "de": [
        "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein",
        "eine", "als",
    ],
    "fr": [
        "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "par", "dans", "qui", "avec", "pas", "sur",
        "au",
    ],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "su", "una", "para", "es", "al", "lo"],
}


SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. A rule passes while low <= measure <= high; a missing bound doesn't bind.
RULES = (
    Rule("length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.1, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4),
    Rule("capitals", "capital_word_ratio", None, 0.6),
)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text, each counted once.

    The windows' 64-bit hashes are sorted with their places, so equal windows become neighbours: the
    cost grows as n log n for one very long text too. Two different windows of one text share a hash
    with a probability below 1e-10 for a million words.
    """
    last = F.size(words) - 3
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def twice(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
        )

    places = F.sort_array(F.transform(let(F.sort_array(window), twice), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda state, place: F.struct(place.alias("last"), (state["n"] + F.least(F.lit(3), place - state["last"])).alias("n")),
        lambda state: state["n"],
    )
    return F.when(last >= 0, covered).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> list[Column]:
    """All counts of one text. Lines are \\n-split and count if they hold a word."""
    whole = F.coalesce(text, F.lit(""))
    # Stop words count as whole words between white space and punctuation, whatever their case.
    stops = r"(?iu)(?<![^\x20\x09-\x0D\p{Punct}])(?:" + "|".join(sorted({w for group in STOP_WORDS.values() for w in group})) + r")(?![^\x20\x09-\x0D\p{Punct}])"

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n"), repeated_words(words).alias("repeated"))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("dup")
        )

    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return [
        let(words_of(text), of_words).alias("w"),
        F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(whole, F.lit(stops)).cast("bigint").alias("n_stop"),
        F.regexp_count(whole, F.lit(r"(?<![\p{L}])\p{Lu}{2,}(?![\p{L}])")).cast("bigint").alias("n_capital"),
    ]


def verdict(rules: tuple[Rule, ...] = RULES, measure: Callable[[str], Column] = F.col) -> list[Column]:
    """One Boolean column per rule of the table, over the ratios that `measure` finds by name."""
    columns = []
    for rule in rules:
        passes = F.lit(True)
        if rule.low is not None:
            passes = passes & (measure(rule.measure) >= F.lit(rule.low))
        if rule.high is not None:
            passes = passes & (measure(rule.measure) <= F.lit(rule.high))
        columns.append(passes.alias(f"ok_{rule.name}"))
    return columns


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id with every count, ratio and rule verdict, the base verdict and `kept`."""
    return _assess(pick(docs, "doc_id", "text"), ["doc_id"], "text", rules)


RATIOS = ("mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "capital_word_ratio")


def _ratios(field: Callable[[str], Column]) -> list[Column]:
    """The measures of the threshold table from the counts that `field` finds by name."""
    ratio = lambda part, of: F.when(of > 0, part / of).otherwise(F.lit(0.0))
    words, lines = field("w")["n"], field("l")
    values = (
        ratio(field("word_chars"), words), ratio(field("n_symbols"), words), ratio(field("n_stop"), words), ratio(lines["dup"], lines["n"]),
        ratio(field("n_capital"), words),
    )
    return [value.alias(name) for value, name in zip(values, RATIOS, strict=True)]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _assess(df: DataFrame, carry: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    counted = df.select(*carry, *measures(F.col(text)))
    rated = counted.select(
        *carry, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"),
        *_ratios(F.col),
    )
    judged = rated.select("*", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), *verdict(rules))
    kept = ~F.col("base_failed")
    for rule in rules:
        kept = kept & F.col(f"ok_{rule.name}")
    return judged.withColumn("kept", kept)


def passes(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The verdict as one expression that measures a text once, wherever the optimizer puts it."""

    def judge(counts: Column) -> Column:
        def all_rules(ratios: Column) -> Column:
            kept = ~base_failed(counts["w"]["n"], counts["w"]["repeated"])
            for passed in verdict(rules, lambda name: ratios[name]):
                kept = kept & passed
            return kept

        return let(F.struct(*_ratios(lambda name: counts[name])), all_rules)

    return let(F.struct(*measures(text)), judge)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that every rule lets pass, with all their columns."""
    frame = Carried(docs)
    return frame.back(frame.df.filter(passes(frame.col("text"), rules)))

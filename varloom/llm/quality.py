"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of running text in English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the and of to in that is for it with as was on be by this are from or an at "
    "der die das und zu den mit sich des auf ist dem nicht ein eine als von für "
    "de la le et les des en un une du que est pour dans qui par "
    "el los y del se las con su al lo como más una por"
).split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _n_repeat(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text.

    The windows are sorted with their places, so equal ones meet: n log n in the text's length, all in its own row.
    """

    def after_sort(s: Column) -> Column:
        equal = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
        start = F.struct(F.lit(-9).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, F.slice(words, F.lit(3), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform(F.slice(triples, F.lit(1), F.size(words) - 2), lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(F.sort_array(placed), after_sort))


@dataclass(frozen=True)
class Rule:
    """rejects: of the columns text, words, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words; true to reject."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda c: c["n_words"] < 50),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
)
#: Thresholds of public web-text filters, in whole numbers so that any engine agrees on them.
RULES = (
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("word_length", lambda c: (c["word_chars"] < 3 * c["n_words"]) | (c["word_chars"] > 10 * c["n_words"])),
    Rule("repeated_lines", lambda c: 100 * c["n_dup_lines"] > 50 * c["n_lines"]),
    Rule("not_words", lambda c: 100 * F.size(F.filter(c["words"], lambda w: w.rlike("\\p{L}"))) < 70 * c["n_words"]),
    Rule("stop_words", lambda c: F.size(F.filter(c["words"], lambda w: F.lower(w).isin(STOP_WORDS))) < 2),
)


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty), words and the counts that rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    staged = staged.select(
        "id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), SPACE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _n_repeat(F.col("words")).alias("n_repeat_words"),
    )
    return staged.select(
        "id",
        "text",
        "words",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


#: How often each row of the sample is put to each rule, so that a rule's time stands out from a job's.
TIMED = 10
_COLUMNS = ("text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def rank_rules(sample: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules with their seconds over the sample and their share of rejections, most rejections per second first.

    sample must be small (a few thousand rows): its counts are written once, and each rule runs over TIMED copies of its
    rows, in rounds that take all rules by turns; the least time counts, less that of a rule that rejects nothing.
    """
    table = written(with_counts(sample, id_col, text_col), "quality-sample")
    many = table.select(*_COLUMNS, F.explode(F.sequence(F.lit(1), F.lit(TIMED))).alias("copy"))
    cols = {c: F.col(c) for c in _COLUMNS}
    tried = [F.lit(False), *(F.coalesce(r.rejects(cols), F.lit(False)) for r in rules)]
    seconds, share = [float("inf")] * len(tried), [0.0] * len(tried)
    for _ in range(2):
        for i, x in enumerate(tried):
            t = time.perf_counter()
            share[i] = many.agg(F.avg(x.cast("double"))).first()[0] or 0.0
            seconds[i] = min(seconds[i], time.perf_counter() - t)
    discard(table)
    ranked = [(r, max(s - seconds[0], 1e-3), x) for r, s, x in zip(rules, seconds[1:], share[1:])]
    return sorted(ranked, key=lambda x: -x[2] / x[1])


def quality_cascade(docs: DataFrame, sample: DataFrame, *, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every whole text.

    One row per input row: the id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (a
    base rule rejects), kept (no rule rejects) and rejected_by (the first rule in cascade order that did, null if
    kept). The rules after the base ones stand in a CASE in the order that rank_rules finds on the sample, so a cheap
    rule that rejects much spares the others; the order changes cost and rejected_by, never kept. A null text counts as
    empty and fails the base. Null ids and repeated rows stay as they are; other columns are ignored. Map-only, native.
    """
    ranked = rank_rules(sample, rules, id_col, text_col)
    counted = with_counts(docs, id_col, text_col)
    cols = {c: F.col(c) for c in _COLUMNS}
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | r.rejects(cols)
    verdict = F.when(base_failed, F.lit("base"))
    for r, _, _ in ranked:
        verdict = verdict.when(F.coalesce(r.rejects(cols), F.lit(False)), F.lit(r.name))
    out = counted.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), verdict.alias("rejected_by"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")

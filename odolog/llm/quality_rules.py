"""Quality rules as a short-circuit cascade (operator 10).

A rule rejects a document. Every rule's cost (seconds) and selectivity (share rejected) are estimated
on a bounded sample, and the rules run in the order of rejections per second: a document that a
cheap, sharp rule rejects never reaches an expensive one. The order changes the cost only; the
verdict is that of all rules together, so it does not depend on the sample.

Everything is a column expression: one scan, no shuffle. The expressions cover whole texts.

Defined results: a null text counts as empty (no words, rejected by ``few_words``); an empty table
gives an empty result; repeated rows are judged one by one; other columns of the input are ignored.
Windows of eight words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import SPACE, let, word_array
from odolog.session import durable

WINDOW = 8  # words of a window that counts as repeated


@dataclass(frozen=True)
class Doc:
    """What rules look at. Each member is an expression; those a rule does not use are not computed."""

    text: Column
    words: Column
    n_words: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], Column]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    share: float

    @property
    def rank(self) -> float:
        return self.share / max(self.seconds, 1e-3)


def _length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def n_symbols(text: Column) -> Column:
    return _length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _window_hashes(words: Column) -> Column:
    def hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(WINDOW))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def _covered(h: Column) -> Column:
    """Words under windows that occur at least twice, from the windows' hashes."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - F.lit(1)), F.get(s, k + F.lit(1))
            return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

        starts = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + F.lit(1)) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    return let(pairs, twice)


def n_repeat_words(words: Column) -> Column:
    """Words in windows of eight that are found twice or more. Only documents with a repeated
    window pay for the sort that finds where."""
    some = let(
        _window_hashes(words),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(F.size(words) > F.lit(WINDOW), some).otherwise(F.lit(0).cast("long"))


def describe(text: Column, words: Column) -> Doc:
    """Members as expressions over a text and its words."""
    return Doc(
        text, words, F.size(words).cast("long"), n_symbols(text), n_dup_lines(text), n_repeat_words(words)
    )


def _capitals(doc: Doc) -> Column:
    capitals = _length(F.regexp_replace(doc.text, r"\P{Lu}+", ""))
    letters = _length(F.regexp_replace(doc.text, r"\P{L}+", ""))
    return (letters >= 20) & (10 * capitals > 6 * letters)


def _few_distinct(doc: Doc) -> Column:
    return (doc.n_words >= 50) & (10 * F.size(F.array_distinct(doc.words)) < doc.n_words)


#: The base rules come first; the thresholds of the others leave plain prose, lists and poems alone.
RULES = [
    Rule("few_words", lambda d: d.n_words < 20),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > F.size(lines_with_words(d.text))),
    Rule("capitals", _capitals),
    Rule("few_distinct_words", _few_distinct),
]


def cascade(doc: Doc, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null. Later rules are not evaluated then."""
    out = F.when(rules[0].rejects(doc), F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects(doc), F.lit(rule.name))
    return out


def failed_rule(text: Column, rules: list[Rule]) -> Column:
    """The cascade over a raw text; its words are split once."""
    whole = F.coalesce(text, F.lit(""))
    return let(word_array(whole), lambda words: cascade(describe(whole, words), rules))


def measure(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 400) -> list[Measured]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows, best rule first."""
    rules = rules or RULES
    # rows of all tasks, copies no more than other rows; a threshold leaves about twice as many as wanted to choose from
    span = 1 << 40
    spread = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(span))
    hashed = docs.select(F.col(text).alias("text")).withColumn("_h", spread)
    below = min(span, 2 * sample_rows * span // max(1, docs.count()))
    sample = durable(hashed.filter(F.col("_h") < below).orderBy("_h").limit(sample_rows).select("text"))
    column = F.col("text")
    seconds = []
    rejected = []
    for rule in [Rule("none", lambda d: F.isnull(d.text)), *rules]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(failed_rule(column, [rule]).isNotNull())).first()[0]
        seconds.append(time.perf_counter() - began)
        rejected.append(n)
    rows = max(1, sample.count())
    found = [Measured(r, max(0.0, s - seconds[0]), n / rows) for r, s, n in zip(rules, seconds[1:], rejected[1:])]
    return sorted(found, key=lambda m: -m.rank)


def ordered_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> list[Rule]:
    return [m.rule for m in measure(docs, text, rules)]


def keep_clean(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The documents no rule rejects, with their columns."""
    return docs.filter(failed_rule(F.col(text), ordered_rules(docs, text, rules)).isNull())


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Per document the base counts, ``base_failed`` and ``kept`` (no rule rejects)."""
    order = ordered_rules(docs, text, rules)
    whole = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            n_repeat_words(words).alias("n_repeat_words"),
        )

    rows = docs.select(
        F.col(key), whole.alias("_text"), let(word_array(whole), counts).alias("_c"),
        n_symbols(whole).alias("n_symbols"), n_dup_lines(whole).alias("n_dup_lines"),
    )
    doc = Doc(
        F.col("_text"), word_array(F.col("_text")), F.col("_c.n_words"), F.col("n_symbols"),
        F.col("n_dup_lines"), F.col("_c.n_repeat_words"),
    )
    base = (doc.n_words < 20) | (100 * doc.n_repeat_words > 30 * doc.n_words)
    return rows.select(
        key, doc.n_words.alias("n_words"), F.col("_c.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        doc.n_repeat_words.alias("n_repeat_words"), base.alias("base_failed"),
        (~base & cascade(doc, order).isNull()).alias("kept"),
    )

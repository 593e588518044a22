"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. The cost of a rule and the share of rows it rejects are estimated on a
sample, and the rules then run in descending order of rejections per unit of cost: a row leaves at its first
rejecting rule and the dearer ones are never evaluated for it. The order has no influence on which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import IN_WORD, free_name, words
from parcelspark.session import stage

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`rejects(text, found)` is a boolean column, true where the text, whose words are `found`, has to go."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_full(text), F.lit(SYMBOLS)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(_full(text), "\n"), lambda x: x.rlike(IN_WORD))


def n_dup_lines(text: Column) -> Column:
    lines = worded_lines(text)
    return F.when(F.contains(_full(text), F.lit("\n")), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(
        F.lit(0)
    ).cast("long")


def n_repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; `found` is the array of words.

    Windows are 64-bit hashes. Where all differ the answer is 0. Otherwise they are sorted next to their starts, which
    puts equal ones side by side; the starts with an equal neighbour, sorted again, each add the words up to the next
    such start, three at most. n log n for any length.
    """
    count = F.size(found)
    starts = F.when(count >= 3, F.sequence(F.lit(0), count - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))

    def twins(windows: Column) -> Column:
        same = lambda x, k: F.get(windows, k)["h"].eqNullSafe(x["h"])
        repeated = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = bound(bound(windows, twins), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated)

    return bound(hashes, counted).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as the argument of a lambda, instead of at every mention."""
    return F.get(F.transform(F.array(value), use), 0)


def symbol_heavy(share: float = 0.1) -> Rule:
    return Rule("symbols", lambda text, found: n_symbols(text) > share * F.greatest(F.size(found), F.lit(1)))


def duplicate_lines(share: float = 0.5) -> Rule:
    return Rule(
        "duplicate_lines",
        lambda text, found: n_dup_lines(text) > share * F.greatest(F.size(worded_lines(text)), F.lit(1)),
    )


def word_length(low: float = 2.5, high: float = 12.0) -> Rule:
    return Rule(
        "word_length",
        lambda text, found: (F.size(found) > 0) & ~(word_chars(found) / F.greatest(F.size(found), F.lit(1))).between(low, high),
    )


def few_distinct_words(share: float = 0.1, least_words: int = 50) -> Rule:
    return Rule(
        "few_distinct_words",
        lambda text, found: (F.size(found) >= least_words)
        & (F.size(F.array_distinct(found)) < share * F.size(found)),
    )


def table_rows(share: float = 0.5) -> Rule:
    """Lines with three bars or more are rows of a table, not prose."""

    def rejects(text: Column, found: Column) -> Column:
        lines = worded_lines(text)
        rows = F.filter(lines, lambda x: F.regexp_count(x, F.lit("[|]")) >= 3)
        return F.contains(_full(text), F.lit("|")) & (F.size(rows) > share * F.greatest(F.size(lines), F.lit(1)))

    return Rule("table_rows", rejects)


def default_rules() -> list[Rule]:
    return [few_distinct_words(), duplicate_lines(), table_rows(), word_length(), symbol_heavy()]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000, seed: int = 7) -> list[Estimate]:
    """Measured seconds and rejected share of each rule on a sample of about `sample_rows` rows, best rank first."""
    rows = docs.count()
    picked = docs.select(F.col("text").cast("string").alias("text"))
    if rows > sample_rows:
        picked = picked.sample(fraction=sample_rows / rows, seed=seed)
    picked = stage(picked.withColumn("found", words(F.col("text"))), "quality-sample")
    measured = []
    for rule in rules:
        hit = F.coalesce(rule.rejects(F.col("text"), F.col("found")), F.lit(False))
        begun = time.perf_counter()
        share = picked.agg(F.avg(hit.cast("double"))).first()[0]
        measured.append(Estimate(rule, float(share or 0.0), time.perf_counter() - begun))
    return sorted(measured, key=lambda e: (-e.rank, e.rule.name))


def cascade(text: Column, found: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the text, else null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects(text, found), F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The documents with `rejected_by`: the first rejecting rule in the estimated order, null for kept rows.

    Null and empty texts count as texts without words; no default rule rejects them. Repeated rows are judged alike,
    an empty table stays empty. A new column whose name is taken gets underscores in front.
    """
    ordered = [e.rule for e in estimate(docs, rules or default_rules(), sample_rows)]
    found = free_name(docs, "found")
    split = docs.withColumn(found, words(F.col("text")))
    verdict = cascade(F.col("text"), F.col(f"`{found}`"), ordered)
    return split.withColumn(free_name(docs, "rejected_by"), verdict).drop(found)

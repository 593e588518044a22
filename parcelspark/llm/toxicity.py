"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, look-alike letters of other scripts, digits and signs standing for letters), the
lexicon is matched in one Aho-Corasick pass, hits inside exception phrases are dropped, and the sum of the weights is
divided by a slowly growing function of the length. A logistic curve turns that into a score between 0 and 1.

Lexicon, weights, exceptions and curve are learned from labelled rows. The labelled sample has a fixed bound
(`per_class` documents of each label, those with the smallest hash of their id); everything that is collected belongs
to this sample or to its candidate terms, whose number is bounded by the sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import free_name

PREFIXES = range(4, 8)  # lengths of the word beginnings that may become terms
THRESHOLD = 0.3

# Letters of Cyrillic and Greek that look like Latin ones (fixed values).
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "ѐ": "è", "ё": "ë", "ї": "ï",
}
# Digits and signs that stand for letters inside a word (fixed values).
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LETTERS = str.maketrans({**LOOK_ALIKE, "l": "i", "|": " ", "​": "", "‌": "", "‍": "", "\xad": ""})
_STAND_INS = str.maketrans({**STAND_IN})
# A sign stands for a letter only between letters or digits, so "!!" after a word is none. One run, never tried again.
_RUN = re.compile(r"(?:[^\W_]|(?<=\w)[@$!](?=\w))+")
_TOKEN = re.compile(r"[^\W_]+")
_STANDS = re.compile("[0-9@$!]")
_ALPHA = re.compile(r"[^\W\d_]")


def _letters(m: re.Match) -> str:
    token = m[0]
    return token.translate(_STAND_INS) if _STANDS.search(token) and _ALPHA.search(token) else token


def fold(text: str) -> str:
    """Words in lower case with look-alikes and stand-ins undone, one space around each.

    l, 1 and i fall together, so that a stand-in for either letter meets both.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _RUN.sub(_letters, text.lower()) if _STANDS.search(text) else text.lower()
    return " " + " ".join(_TOKEN.findall(text.translate(_LETTERS))) + " "


def candidate_terms(folded: str) -> set[str]:
    """Whole words (" word ") and beginnings of words (" wor")."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


@dataclass
class Model:
    """weights: folded term to log-odds; exceptions: folded phrases in which a hit does not count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = -4.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for term in {*self.weights, *self.exceptions}:
            found.add_word(term, (len(term), self.weights.get(term), term in self.exceptions))
        found.make_automaton()
        return found

    def probability(self, evidence: float) -> float:
        z = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def evidence(folded: str, matcher: ahocorasick.Automaton | None) -> float:
    """Weights of the words hit, the largest term of a word counting, over 1 + log(1 + words / 200)."""
    if matcher is None:
        return 0.0
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight, is_exception) in matcher.iter(folded):
        start = end - length + 1
        if is_exception:  # found in the order of their ends: overlapping ones become one
            while excused and excused[-1][1] >= start:
                start_of, _ = excused.pop()
                start = min(start, start_of)
            excused.append((start, end))
            start = end - length + 1
        if weight is not None:
            hits[start] = max(weight, hits.get(start, -math.inf))
    total = sum(w for s, w in hits.items() if not _inside(s, excused))
    return total / (1 + math.log1p(folded.count(" ") / 200))


def _inside(place: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a place lies in one of the spans, which ascend and do not overlap."""
    at = bisect_right(spans, place, key=lambda span: span[0]) - 1
    return at >= 0 and place < spans[at][1]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic of at most `per_class` documents a label; rows held out are never among them."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    # At most 2 x per_class rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 3000, cover: int = 3) -> Model:
    """Fit a model on a bounded labelled sample; without labels of both kinds the model finds nothing.

    Terms are chosen greedily: the one found in most toxic documents that have not met `cover` terms yet, provided it is
    rare in the others. Near copies of one toxic text therefore do not bring all their words into the lexicon.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, per_class).cache()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        sample.unpersist()
        return Model()

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for term in candidate_terms(fold(text)):
                    seen[term][toxic] += 1
            # A term met in clean texts alone cannot enter; its clean count matters only beside a toxic one.
            yield pd.DataFrame([(t, c, x) for t, (c, x) in seen.items()], columns=["term", "clean", "toxic"])

    least = max(2, n_toxic // 300)
    counts = (
        sample.mapInPandas(count_terms, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= least) & (F.col("toxic") * n_clean >= 8 * (F.col("clean") + 0.5) * n_toxic))
    )
    odds = {
        r["term"]: math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
        for r in counts.collect()
    }
    wanted = spark.sparkContext.broadcast(frozenset(odds))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (int(d), int(x), sorted(candidate_terms(fold(t)) & wanted.value))
                for d, t, x in zip(pdf["doc_id"], pdf["text"], pdf["toxic"])
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "terms"])

    held = sample.mapInPandas(present, "doc_id long, toxic int, terms array<string>").where("toxic = 1").collect()
    weights = choose_terms([list(r["terms"]) for r in held], odds, least, cover)
    model = Model(weights)
    if weights:
        matcher = spark.sparkContext.broadcast(dict(weights))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = Model(matcher.value).automaton()
            for pdf in batches:
                rows = []
                for text, toxic in zip(pdf["text"], pdf["toxic"]):
                    folded = fold(text)
                    rows.append((int(toxic), evidence(folded, found), phrases(folded, found)))
                yield pd.DataFrame(rows, columns=["toxic", "evidence", "phrases"])

        seen = sample.mapInPandas(measure, "toxic int, evidence double, phrases array<string>").collect()
        model.exceptions = learn_exceptions([(r["toxic"], list(r["phrases"])) for r in seen])
        x = np.array([r["evidence"] for r in seen])
        y = np.array([r["toxic"] for r in seen], dtype=float)
        model.slope, model.offset = fit_curve(x, y)
    sample.unpersist()
    return model


def choose_terms(docs: list[list[str]], odds: dict[str, float], least: int, cover: int) -> dict[str, float]:
    """Greedy cover of the toxic documents of the sample."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, terms in enumerate(docs):
        for t in terms:
            at[t].append(i)
    open_ = np.full(len(docs), cover)
    gain = {t: len(rows) for t, rows in at.items()}
    chosen: dict[str, float] = {}
    while gain:
        # Longer terms win ties: they are the more specific of terms found in the same documents.
        best = max(gain, key=lambda t: (gain[t], odds[t], len(t), t))
        now = int((open_[at[best]] > 0).sum())
        if now < least:
            del gain[best]
        elif now < gain[best]:
            gain[best] = now  # stale; look again
        else:
            chosen[best] = odds[best]
            open_[at[best]] -= 1
            del gain[best]
    return chosen


def phrases(folded: str, matcher: ahocorasick.Automaton) -> list[str]:
    """The hits with the word before, and with the word after."""
    out = set()
    for end, (length, _, _) in matcher.iter(folded):
        start = end - length + 1
        before = folded.rfind(" ", 0, start) if start else -1
        close = folded.find(" ", start + 1)
        after = folded.find(" ", close + 1)
        if before >= 0:
            out.add(folded[before : close + 1])
        if after >= 0:
            out.add(folded[start : after + 1])
    return sorted(out)


def learn_exceptions(seen: list[tuple[int, list[str]]], least: int = 3) -> frozenset[str]:
    """Phrases around a hit met in `least` clean documents and in no toxic one."""
    clean = Counter(p for toxic, found in seen if not toxic for p in found)
    toxic = {p for is_toxic, found in seen if is_toxic for p in found}
    return frozenset(p for p, n in clean.items() if n >= least and p not in toxic)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps; the slope never falls below a small positive value."""
    a, b = 1.0, -2.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1 for each text; null and empty texts get the score of no hit."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.automaton()
        for texts in batches:
            yield texts.map(lambda t: model.probability(evidence(fold(t), matcher))).astype("float64")

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `toxicity` between 0 and 1; all rows and columns stay."""
    return docs.withColumn(free_name(docs, "toxicity"), score_column(F.col("text"), model))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    name = free_name(docs, "toxicity")
    scored = docs.withColumn(name, score_column(F.col("text"), model))
    return scored.where(F.col(f"`{name}`") < threshold).drop(name)

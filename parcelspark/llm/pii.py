"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Four kinds have a fixed definition (email, ip, card, phone) and always count once their own test passes. The other
kinds start from a base score; a passed checksum (mod-97 for IBANs) raises it, typical words shortly before the span
raise it, words of another meaning lower it, and spans of at least `THRESHOLD` are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
CONTEXT = 40  # characters before a span that are searched for context words

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only; starting inside it could not match where its start does not.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")

# Base score, helpful context, harmful context.
SCORED = {
    "iban": (0.3, re.compile(r"iban|account|konto|compte|cuenta|bank", re.I), None),
    "ssn": (0.3, re.compile(r"\bssn\b|social|security|tax", re.I), re.compile(r"part|order|serial|version", re.I)),
    "secret": (
        0.25,
        re.compile(r"token|secret|api[ _-]?key|password|passwd|bearer|credential", re.I),
        re.compile(r"commit|checksum|sha[0-9]|md5|digest|uuid", re.I),
    ),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part runs back from each @, never into the match before; one pass, whatever the length of a run."""
    free = 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        start = at
        while domain and start > free and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", domain.end() if domain and start < at else at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def evidence(kind: str, value: str) -> float:
    """What the span itself says, added to the base score; below -1 it is not of this kind at all."""
    if kind == "iban":
        compact = value.replace(" ", "")
        return 0.5 if 15 <= len(compact) <= 34 and mod97(compact) else -9.0
    if kind == "ssn":
        return 0.1 if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" else -9.0
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return 0.2 if mixed and entropy(value) >= 3.0 else -9.0


def scored_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the further kinds that reach the threshold and do not overlap a base span."""
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("secret", SECRET)):
        base, helps, harms = SCORED[kind]
        for m in pattern.finditer(text):
            score = base + evidence(kind, m[0])
            if score <= 0:
                continue
            before = text[max(0, m.start() - CONTEXT) : m.start()]
            score += 0.35 * bool(helps.search(before)) - 0.35 * bool(harms and harms.search(before))
            if score >= THRESHOLD and not any(s < m.end() and m.start() < e for s, e in taken):
                yield kind, m.start(), m.end(), round(score, 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; positions in code points. Base spans score 1 when confirmed."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, s, e, 1.0) for k in BASE_KINDS for s, e in base[k]]
    return out + list(scored_spans(text, [(s, e) for _, s, e, _ in out]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span gives way to its kind in brackets; overlapping spans to the first one's."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def span_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)])

    return spans(F.coalesce(text.cast("string"), F.lit("")))


def detect(docs: DataFrame) -> DataFrame:
    """The documents with their spans in `pii_spans`; null and empty texts have none. All columns and rows stay."""
    return docs.withColumn(free_name(docs, "pii_spans"), span_column(F.col("text")))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind, n_chars kept in step. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, find_spans(t)) if t else t)

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and span lists: the columns of the registered query."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def summary(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find_spans(t)
            named = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
            counts = Counter(k for k, *_ in spans)
            base = ",".join(n for n, (k, *_) in zip(named, spans) if k in BASE_KINDS)
            rows.append(
                [counts[k] for k in BASE_KINDS] + [hashlib.sha256(base.encode()).hexdigest(), ",".join(named)]
            )
        columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        return pd.DataFrame(rows, columns=columns)

    found = docs.select(F.col("doc_id"), summary(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    return found.select("doc_id", "s.*")

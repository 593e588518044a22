"""Collocations against counting by hand, with colliding fingerprints, full bit tables and odd rows."""

import collections
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import collocations

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, n long, phrase string, size string, a int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least=30, pct=80, top=2000):
    total, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    longer = collections.Counter()
    for (lang, p), n in f.items():
        if n >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], n)
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if a < least or len(p) < 2 or 100 * longer[lang, p] >= pct * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
        )
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, own in found.items()
        for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])
    )


def got(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("least, pct, top", [(30, 80, 2000), (4, 50, 37)])
def test_whole_table(docs, least, pct, top):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    expected = by_hand(rows, least, pct, top)
    assert expected and got(docs.repartition(3), least=least, covered_pct=pct, top=top) == expected


def test_a_full_bit_table_loses_nothing(docs, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BITS", 64)
    assert got(docs, bits=256) == got(docs)


def counted(frame, sizes, allowed=None):
    """Phrases with their numbers as one task counts and reads them."""
    parts = pd.concat(list(collocations._count(sizes, allowed)(iter([frame]))))
    rows = parts.groupby(["print", "check"], as_index=False).agg({"n": "sum", "row": "min"})
    runs = [rows[rows["row"] == r][["print", "check", "n"]].to_dict("records") for r in frame["row"]]
    (read,) = collocations._materialise(iter([frame.assign(runs=runs)]))
    return {(r.lang, r.phrase): r.n for r in read.itertuples()}, rows, runs


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    text = "the Red house, a red house; the red house. a blue house, the red house"
    frame = pd.DataFrame({"text": [text, "the red house"], "lang": ["en", "fr"], "row": [0, 1]})
    monkeypatch.setattr(collocations.Batch, "prints", lambda b, at, size: np.full(len(at), 7, np.uint64))
    found, rows, _ = counted(frame, [2])
    assert set(rows["print"]) == {7} and found == {
        ("en", "the red"): 3, ("en", "red house"): 4, ("en", "a red"): 1, ("en", "a blue"): 1, ("en", "blue house"): 1,
        ("fr", "the red"): 1, ("fr", "red house"): 1,
    }


def test_a_text_is_held_against_its_fingerprint():
    frame = pd.DataFrame({"text": ["one two three"], "lang": ["en"], "row": [0]})
    found, _, runs = counted(frame, [2])
    assert found == {("en", "one two"): 1, ("en", "two three"): 1}
    with pytest.raises(ValueError):
        list(collocations._materialise(iter([frame.assign(text="one too three", runs=runs)])))


def test_small_batches_and_texts_longer_than_one(monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_BYTES", 40)
    monkeypatch.setattr(collocations, "HELD", 64)
    texts = ["one two three four, one two three! " * 9, "x" * 500 + " one two three four", "a é É b " * 30]
    frame = pd.DataFrame({"text": texts, "lang": "en", "row": range(3)})
    assert len(list(collocations.batches(iter([frame])))) > 3
    found, _, _ = counted(frame, [0, 1, 3])
    assert found["en", "one two three"] == 19 and found["en", "a é É"] == 30 and ("en", "two three one") not in found
    assert found["en", "one"] == 19 and found["en", ""] == sum(len(re.findall("[^ .,!]+", t)) for t in texts)


def test_odd_rows(spark):
    said = "Good Morning to you all. good\tmorning  to you,all\x0bGOOD morning É é"
    texts = [(1, said, "en")] * 20 + [(None, said, None)] * 12 + [(2, None, "en"), (3, "", None), (4, " \t. ;", "xx")]
    texts += [(5, "tief im Wald " * 40, "und"), (6, "a" * 200_000, "en"), (7, "ein Baum " * 10, "de")]
    rows = [(i, t, lang, 5, "p", "s", 1) for i, t, lang in texts]
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = by_hand([(t, lang) for _, t, lang in texts], least=12, pct=101)
    assert {r[0] for r in expected} == {"en", "und"}
    assert got(frame, least=12, covered_pct=101) == expected
    assert got(frame, least=12) == by_hand([(t, lang) for _, t, lang in texts], least=12)
    assert got(frame.limit(0)) == []


def test_counts_beyond_64_bit_products(spark, monkeypatch):
    n = 4_000_000_000_000_000
    counts = [("en", 0, "", 9 * n), ("en", 1, "a", n + 7), ("en", 1, "b", n), ("en", 2, "a b", n - 1)]
    frame = spark.createDataFrame(counts, "lang string, size int, phrase string, n long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *_: frame)
    row = collocations.collocations(spark.range(0).select(F.lit("").alias("text"))).collect()
    assert [tuple(r) for r in row] == [("en", 1, "a b", n - 1, n + 7, n, 9 * n, 2_000_000 * (n - 1) // (2 * n + 7))]

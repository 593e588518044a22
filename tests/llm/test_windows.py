"""Window packing: whole ids against the plain tokenizer, full windows, proportions, odd rows."""

import collections
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parcelspark.llm import queries, tokens, windows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, source string, queue string, part int, n string, ids string, before double"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.place_of("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_plain_tokenizer(plain):
    texts = [
        "Café ſtraße İstanbul ΟΔΟΣ été <|endoftext|> it's IT'S!'s don't x's9's", "a\x1cb\x85c　d e f", "漢字 𝒳 １２ ½ ǅ ŉx",
        "é x ́a ṩ", "", None, " \n\t ", "ÿ Ÿ Œ×÷ŵ'LL '' 'd'", "x" * 3000, "\x00 \x7f \x01a", "ﬁ Ω K",
    ]
    ids, counts = tokens.encoder("word_bpe_49k.json").encode(pa.array(texts), 2)
    expected = [plain(t) for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_other_vocabularies_are_read_text_by_text():
    encoder = tokens.Encoder("byte_bpe_50k.json")
    ids, counts = encoder.encode(pa.array(["Two  words", None]), 7)
    expected = encoder.tokenizer.encode("Two  words", add_special_tokens=False).ids
    assert not encoder.by_word and ids.tolist() == [*expected, 7, 7] and counts.tolist() == [len(expected) + 1, 1]


def held(rows, capacity):
    """Checks documents and sequences; tokens per (sequence, source)."""
    sequences, mixed = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        mixed[r["sequence_id"], r["source"]] += r["length"]
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == capacity if number < len(sequences) - 1 else at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return mixed


@pytest.mark.parametrize("span", [256, 3])
def test_every_id_in_one_piece(spark, plain, span):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(5)
    rows = windows.pack(docs, span=span).collect()
    mixed = held(rows, 4096)
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["start"]] = r
    totals = collections.Counter()
    for d in docs.collect():
        ids, got = plain(d["text"]), pieces.pop(d["doc_id"])
        raw = b"".join(got[s]["ids"] for s in sorted(got))
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert sorted(got) == np.cumsum([0] + [got[s]["length"] for s in sorted(got)])[:-1].tolist()
        assert {r["doc_tokens"] for r in got.values()} == {len(ids)}
        totals[d["source"]] += len(ids)
    assert not pieces
    # Every window holds each source in the proportion of the corpus, as far as whole credits go.
    whole = sum(totals.values())
    for s in range(len({k for k, _ in mixed}) - 1):
        for source, n in totals.items():
            assert abs(mixed[s, source] - 4096 * n / whole) <= 4 * windows.LEAST


def test_query(spark, plain):
    rows = queries.op13_windows(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sum(r["length"] for r in rows) == sum(len(plain(t)) for t in texts.values())
    for r in rows[::7]:
        ids = plain(texts[r["doc_id"]])
        cut = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(cut) and r["doc_tokens"] == len(ids)


def test_target_weights_hold_until_a_source_runs_dry(spark):
    rows = [(i, "wort " * (40 + i % 50), "ab"[i % 2]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = windows.pack(docs, capacity=512, weights={"a": 3.0, "b": 1.0}, span=16).collect()
    mixed = held(got, 512)
    of_a = sum(n for (_, s), n in mixed.items() if s == "a")
    # In the partition in which it runs dry, a source is spread over all windows.
    for s in range(int(of_a / 384) // 16 * 16):
        assert abs(mixed[s, "a"] - 384) <= windows.LEAST
    with pytest.raises(ValueError):
        windows.pack(docs, weights={"a": 0.0})


def test_serve_carries_credit():
    queued = np.array([100_000, 900, 7, 0])
    taken = windows.serve(queued, queued.astype(float), 100, 1010, least=8)
    assert (taken.sum(axis=0) == queued).all() and (taken[:1009].sum(axis=1) == 100).all() and taken[1009].sum() == 7
    ideal = np.outer(np.arange(1, 1011), queued / queued.sum() * 100)
    assert np.abs(np.cumsum(taken, axis=0) - ideal)[:1000].max() < 16
    assert windows.serve(np.zeros(0), np.zeros(0), 10, 0).shape == (0, 0)


def test_the_plan_stays_small(monkeypatch):
    monkeypatch.setattr(windows, "CELLS", 64)
    plan = windows.Plan([100_000, 50_000, 3], [100_000.0, 50_000.0, 3.0], 16, 2)
    assert plan.shares.size <= 64 + 3 and (plan.shares.sum(axis=0) == [100_000, 50_000, 3]).all()


def test_odd_rows(spark):
    long = " ".join(f"long{i}" for i in range(30_000))
    texts = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "c", None), (4, long, ""), (5, " \n", "=")]
    docs = spark.createDataFrame([(d, t, s, "q", 1, "n", "i", 0.5) for d, t, s in texts], SCHEMA)
    got = windows.pack(docs, capacity=64, span=4).collect()
    held(got, 64)
    by = collections.Counter()
    for r in got:
        by[r["doc_id"], r["source"]] += r["length"]
    assert by[1, "x"] == 6 and by[2, "x"] == 1 and by[3, None] == 1 and by[None, None] == 2 and by[5, "="] == 1
    assert windows.pack(docs.limit(0)).collect() == []

"""Near-duplicates by weighted Jaccard similarity of five-word shingle multisets.

BagMinHash signatures are banded; documents that share a band are candidates, and every candidate pair that decides a
class is verified on the true multisets. Groups of thousands of near copies must not be expanded into all pairs:

- texts with the same words are one member, settled by an aggregate;
- inside a bucket everybody is compared with one leader, the member that shares most buckets with others, which in a
  group of edited copies is the common original; this links nearly all of a group at the cost of its size;
- what a leader did not join is not given up: buckets that still hold different classes are compared in blocks, on the
  true multisets and inside the task, which gives back only links that join classes.

A class is a connected component of verified links. With 24 bands of 4 registers a pair at similarity 0.8 is missed by
the banding with a probability of 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.bagminhash import GAMMA, band_keys, short_form, signatures
from parcelspark.llm.common import free_name, with_row_names
from parcelspark.llm.wordhash import batches, mix, run_hashes, word_hashes
from parcelspark.session import stage

SHINGLE = 5
BANDS, ROWS = 24, 4
BLOCK = 512  # members of a bucket that one task compares with as many others
COLUMNS = 4096  # elements of one matrix product

SKETCH = "row_id long, doc_order long, doc_id long, k1 long, k2 long, n long, sig binary"


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, text) of the distinct shingles of each text; texts of fewer words are one shingle."""
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    at = np.flatnonzero(pos + SHINGLE <= counts[doc])
    h, d = run_hashes(words, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64), doc[at]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.cumsum(counts) - counts
        whole = np.concatenate([run_hashes(words[first[i] : first[i] + counts[i]], int(counts[i])) for i in short])
        h, d = np.concatenate([h, mix(whole + counts[short].astype(np.uint64))]), np.concatenate([d, short])
    if not len(h):
        return h, np.zeros(0, dtype=np.int64), d
    by = np.lexsort((h, d))
    h, d = h[by], d[by]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    return h[new], np.diff(np.concatenate([new, [len(h)]])), d[new]


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for start, texts in batches(list(pdf["text"])):
            own = pdf.iloc[start : start + len(texts)]
            words, counts = word_hashes(texts)
            h, c, d = shingle_sets(words, counts)
            sig = short_form(signatures(h, c, d, len(texts), BANDS * ROWS))
            # Two keys of the word sequence: texts that have both in common have the same words.
            ends = np.cumsum(counts)
            keys = [_sequence_keys(words, ends - counts, ends, salt) for salt in (1, 2)]
            out.append(
                pd.DataFrame(
                    {
                        "row_id": own["row_id"].to_numpy(),
                        "doc_order": own["doc_order"].to_numpy(),
                        "doc_id": own["doc_id"].array,
                        "k1": keys[0],
                        "k2": keys[1],
                        "n": np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64)),
                        "sig": [s.tobytes() for s in sig],
                    }
                )
            )
        if out:
            yield pd.concat(out)


def _sequence_keys(words: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each text's words in their order: sums of words mixed with their positions."""
    pos = np.arange(len(words), dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words ^ mix(pos + np.uint64(salt << 40))), dtype=np.uint64)])
        return mix(sums[last] - sums[first] + (last - first).astype(np.uint64)).view(np.int64)


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        short = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1)
        keys = band_keys(short, ROWS)
        yield pd.DataFrame(
            {
                "bucket": keys.view(np.int64).ravel(),
                "row_id": np.repeat(pdf["row_id"].to_numpy(), keys.shape[1]),
                "n": np.repeat(pdf["n"].to_numpy(), keys.shape[1]),
            }
        )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            # A leader comes back in many rows of a frame: every text is cut once.
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for ids, texts in ((pdf["a"], pdf["text_a"]), (pdf["b"], pdf["text_b"])):
                fresh = {int(i): t for i, t in zip(ids, texts) if int(i) not in sets}
                names = list(fresh)
                for start, raw in batches([fresh[i] for i in names]):
                    h, c, d = shingle_sets(*word_hashes(raw))
                    edges = np.searchsorted(d, np.arange(len(raw) + 1))
                    for i in range(len(raw)):
                        sets[names[start + i]] = (h[edges[i] : edges[i + 1]], c[edges[i] : edges[i + 1]])
            close = [similarity(sets[int(a)], sets[int(b)]) >= threshold for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[np.array(close, dtype=bool), ["a", "b"]]

    return run


def _elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The multisets as sorted sets: the k-th copy of a shingle is an element of its own."""
    for pdf in frames:
        for start, raw in batches(list(pdf["text"])):
            h, c, d = shingle_sets(*word_hashes(raw))
            copy = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            with np.errstate(over="ignore"):
                e, d = mix(np.repeat(h, c) + copy.astype(np.uint64) * GAMMA), np.repeat(d, c)
            edges = np.searchsorted(d, np.arange(len(raw) + 1))
            own = pdf.iloc[start : start + len(raw)]
            packed = [e[x:y].tobytes() for x, y in zip(edges, edges[1:])]
            yield pd.DataFrame({"row_id": own["row_id"].array, "label": own["label"].array, "elements": packed})


def _across(threshold: float):
    """Links between different classes in a pair of blocks of a bucket; enough of them to join what belongs together.

    Common elements of all pairs come from products of 0/1 matrices over the elements that both sides have.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        same = int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0])
        left = pdf if same else pdf[pdf["side"] == 0]
        right = pdf if same else pdf[pdf["side"] == 1]
        if pdf["label"].nunique() < 2 or not len(left) or not len(right):
            return none
        (e1, d1, n1), (e2, d2, n2) = (_flat(x["elements"]) for x in (left, right))
        both = np.intersect1d(e1, e2)
        if same:  # an element of one text alone is common to nothing
            values, times = np.unique(e1, return_counts=True)
            both = values[times > 1]
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        at1, at2 = np.searchsorted(both, e1), np.searchsorted(both, e2)
        for first in range(0, len(both), COLUMNS):
            sides = []
            for e, d, at, n in ((e1, d1, at1, len(left)), (e2, d2, at2, len(right))):
                own = np.flatnonzero((at >= first) & (at < min(first + COLUMNS, len(both))))
                own = own[both[at[own]] == e[own]]
                m = np.zeros((n, COLUMNS), dtype=np.float32)
                m[d[own], at[own] - first] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
        # Products of 0/1 values are whole numbers, exact up to 2 ** 24.
        close = common >= threshold * (n1[:, None] + n2[None, :] - common) - 1e-9
        l1, l2 = left["label"].to_numpy(), right["label"].to_numpy()
        x, y = np.nonzero(close & (l1[:, None] != l2[None, :]))
        joined: dict[int, int] = {}

        def find(v: int) -> int:
            while joined.setdefault(v, v) != v:
                joined[v] = joined[joined[v]]
                v = joined[v]
            return v

        out = []
        r1, r2 = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        for i, j in zip(x, y):
            p, q = find(int(l1[i])), find(int(l2[j]))
            if p != q:
                joined[p] = q
                out.append((int(r1[i]), int(r2[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64") if out else none

    return run


def _flat(packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, text of each, number of elements of each text)."""
    n = np.array([len(x) // 8 for x in packed], dtype=np.int64)
    return np.frombuffer(b"".join(packed), dtype=np.uint64), np.repeat(np.arange(len(n)), n), n


def across_classes(entries: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes. entries: bucket, row_id, size; members: row_id, label, text.

    A bucket is compared in pairs of blocks of at most about BLOCK members; nothing but links leaves a task.
    """
    sets = members.mapInPandas(_elements, "row_id long, label long, elements binary")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (
        entries.withColumn("own", F.pmod(F.xxhash64("row_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "bucket",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "row_id",
        )
    )
    placed = placed.join(sets, "row_id")
    return placed.groupBy("bucket", "i", "j").applyInPandas(_across(threshold), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    met = pairs.join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b")
    return met.select("a", "b", "text_a", "text_b").mapInPandas(_verify(threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, by label propagation with pointer jumping."""
    links = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        best = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "m").alias("low")
        )
        best = stage(best, "labels")
        jump = best.select(F.col("node").alias("via"), F.col("low").alias("lower"))
        moved = best.join(jump, best["low"] == jump["via"], "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("label"), F.col("label").alias("old")
        )
        moved = stage(moved, "labels")
        if moved.where("label <> old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def classes(docs: DataFrame, threshold: float = 0.8, row_name: str | None = None) -> DataFrame:
    """row_id, doc_id, kept_row, class_id, class_size of every document row.

    class_id is the smallest doc_id of the class (null only if all are null), kept_row the row that stands for it: the
    one with that id, the first in the table among equal ids. Texts with the same words are always one class, also those
    of fewer than five words, which have one shingle. Null, empty and blank texts have no shingles: each is a class of
    its own. row_id names the row of the table, in the order of its files; `row_name` is a column that holds such
    names already. An empty table gives no rows; extra columns are left out.
    """
    if row_name is None:
        docs, row_name = with_row_names(docs.select("doc_id", "text"), "row_id"), "row_id"
    rows = docs.select(
        F.col(row_name).alias("row_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_order"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    sketch = stage(rows.mapInPandas(_sketch, SKETCH), "neardup-sketch")
    worded = sketch.where("n > 0")

    # Rows with the words of an earlier row follow that row; all others are members.
    firsts = worded.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_order", "row_id")).alias("first"), F.count(F.lit(1)).alias("c")
    )
    firsts = firsts.where("c > 1").select("k1", "k2", F.col("first.row_id").alias("member"))
    copies = worded.select("k1", "k2", "row_id").join(firsts, ["k1", "k2"]).where("row_id <> member")
    copies = stage(copies.select("row_id", "member"), "neardup-copies")
    members = worded.join(copies.select("row_id"), "row_id", "left_anti")

    entries = members.select("row_id", "n", "sig").mapInPandas(_bands, "bucket long, row_id long, n long")
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(entries.join(sizes, "bucket"), "neardup-buckets")
    degrees = shared.groupBy("row_id").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degrees, "row_id")
    leaders = ranked.groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("row_id")).alias("order"), F.col("n").alias("leader_n"))).alias("best")
    )
    leaders = leaders.select("bucket", (-F.col("best.order")).alias("leader"), "best.leader_n")
    fits = F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n")
    pairs = shared.join(leaders, "bucket").where((F.col("row_id") != F.col("leader")) & fits)
    pairs = pairs.select(F.col("row_id").alias("a"), F.col("leader").alias("b")).distinct()

    candidates = shared.select("row_id").distinct()
    texts = stage(rows.select("row_id", "text").join(candidates, "row_id"), "neardup-texts")
    links = stage(verified(pairs, texts, threshold), "neardup-links")
    labels = components(links)

    # Buckets with members of different classes: there all members are compared, in blocks.
    open_ = shared.join(labels.select(F.col("node").alias("row_id"), "label"), "row_id", "left")
    open_ = open_.select("bucket", "row_id", "size", F.coalesce("label", "row_id").alias("label"))
    split = open_.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    open_ = stage(open_.join(split.select("bucket"), "bucket"), "neardup-open")
    again = texts.join(open_.select("row_id", "label").distinct(), "row_id")
    more = stage(across_classes(open_.select("bucket", "row_id", "size"), again, threshold), "neardup-more")
    labels = components(links.unionByName(more))

    named = sketch.select("row_id", "doc_order", "doc_id").join(copies, "row_id", "left")
    named = named.withColumn("member", F.coalesce("member", "row_id"))
    named = named.join(labels, F.col("member") == F.col("node"), "left")
    named = named.withColumn("label", F.coalesce("label", "member")).select("row_id", "doc_order", "doc_id", "label")
    heads = named.groupBy("label").agg(
        F.min(F.struct("doc_order", "row_id", "doc_id")).alias("head"), F.count(F.lit(1)).alias("class_size")
    )
    return named.join(heads, "label").select(
        "row_id", "doc_id", F.col("head.row_id").alias("kept_row"), F.col("head.doc_id").alias("class_id"), "class_size"
    )


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, with its own columns: the one with the smallest id."""
    row = free_name(docs, "row_id")
    numbered = with_row_names(docs, row)
    gone = classes(numbered, threshold, row).where("row_id <> kept_row").select("row_id")
    return numbered.join(gone.withColumnRenamed("row_id", row), row, "left_anti").drop(row)

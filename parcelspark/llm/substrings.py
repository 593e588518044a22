"""Removal of repeated runs of words, found with difference-cover anchors.

A window is `window` consecutive words of one document. Positions whose number modulo a period v is in a difference
cover D carry an anchor: the hash of the next window - v + 1 words. For any two positions some shift below v puts both
on cover positions, so two equal windows share an equal, equally placed anchor inside them, although only |D| of v
positions are hashed.

1. Anchors are dealt by hash; an anchor that occurs once cannot lie in a repeated window and is forgotten.
2. Around the others the match is extended: all windows that contain a repeated anchor are hashed in full and dealt by
   hash. The earliest occurrence of a window stays, all later ones are removed.

Both exchanges carry packed arrays, one row per writing task and target. Equal hashes are first settled inside the
writing task, which sends on one of them only; so a passage that a third of all documents share arrives at most once
from each writing task. Exact copies of a text are settled beforehand by an aggregate on the text's hashes, and only the
first of them takes part in the second step. Rows are named by their number in this scan of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.wordhash import batches, mix, run_hashes, word_hashes
from parcelspark.llm.common import with_row_names
from parcelspark.session import parallelism

# Perfect difference sets by period (fixed values): every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LEAST_ANCHOR = 8  # words of an anchor where the window allows it
FLUSH = 1_500_000  # hashes a writing task settles at a time


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of LEAST_ANCHOR words, or of half a short window."""
    least = min(LEAST_ANCHOR, (window + 1) // 2)
    period = max(v for v in COVERS if window - v + 1 >= least)
    return period, COVERS[period]


PACKED = (
    "target int, wide boolean, h binary, doc binary, pos binary, known_doc binary, known_pos binary, "
    "rows binary, orders binary"
)
FOUND = "bucket int, rows binary, counts binary, places binary"
PLACES = "row_id long, places array<int>"


class Settling:
    """Hashes with their places, gathered in a writing task and packed by target.

    A place is a document, by its index since the last flush, and a word position. Of equal hashes the earliest is sent;
    the later ones, and with `all_of_them` the earliest too, are known to be repeated and travel without their hash.
    """

    def __init__(self, targets: int, all_of_them: bool) -> None:
        self.targets, self.all_of_them = targets, all_of_them
        self.clear()

    def clear(self) -> None:
        self.rows: list[np.ndarray] = []
        self.orders: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_rows = self.n = 0

    def add(self, rows: np.ndarray, orders: np.ndarray, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((h, (doc + self.n_rows).astype(np.uint32), pos.astype(np.uint32)))
        self.rows.append(rows)
        self.orders.append(orders)
        self.n_rows += len(rows)
        self.n += len(h)

    def flush(self) -> pd.DataFrame:
        rows, orders = np.concatenate(self.rows), np.concatenate(self.orders)
        h, doc, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.clear()
        # Documents in their order, so that an index also compares them.
        place = np.lexsort((rows, orders))
        rank = np.empty(len(rows), dtype=np.uint32)
        rank[place] = np.arange(len(rows), dtype=np.uint32)
        rows, orders, doc = rows[place], orders[place], rank[doc]

        by_hash = np.lexsort((pos, doc, h))
        h, doc, pos = h[by_hash], doc[by_hash], pos[by_hash]
        later = np.zeros(len(h), dtype=bool)
        later[1:] = h[1:] == h[:-1]
        known = later.copy()
        if self.all_of_them:
            known[:-1] |= later[1:]

        targets = np.uint64(self.targets)
        send = _by_target((h % targets).astype(np.int64), doc, pos, ~later)
        told = _by_target((doc % np.uint32(self.targets)).astype(np.int64), doc, pos, known)
        out = []
        for t in sorted({*send, *told}):
            new, old = send.get(t, _NONE), told.get(t, _NONE)
            both = np.concatenate([new, old])
            used = np.unique(doc[both])
            # Two bytes do for most places.
            wide = bool(len(used) > 0xFFFF or pos[both].max() > 0xFFFF)
            number = np.uint32 if wide else np.uint16
            packed = [h[new].tobytes()]
            for part in (new, old):
                packed.append(np.searchsorted(used, doc[part]).astype(number).tobytes())
                packed.append(pos[part].astype(number).tobytes())
            out.append((t, wide, *packed, rows[used].tobytes(), orders[used].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])


_NONE = np.zeros(0, dtype=np.int64)


def _by_target(target: np.ndarray, doc: np.ndarray, pos: np.ndarray, chosen: np.ndarray) -> dict[int, np.ndarray]:
    """Indices of the chosen entries by target, each in the order of documents and positions."""
    at = np.flatnonzero(chosen)
    at = at[np.lexsort((pos[at], doc[at], target[at]))]
    to = target[at]
    edges = np.flatnonzero(np.diff(to)) + 1
    return {int(target[x[0]]): x for x in np.split(at, edges) if len(x)}


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(h, row, order, pos) of the entries with a hash, (row, pos) of the known ones."""
    sent, told = [], []
    for r in pdf.itertuples(index=False):
        rows, orders = np.frombuffer(r.rows, np.int64), np.frombuffer(r.orders, np.int64)
        number = np.uint32 if r.wide else np.uint16
        doc, old = np.frombuffer(r.doc, number), np.frombuffer(r.known_doc, number)
        sent.append((np.frombuffer(r.h, np.uint64), rows[doc], orders[doc], np.frombuffer(r.pos, number)))
        told.append((rows[old], np.frombuffer(r.known_pos, number)))
    return (*(np.concatenate(x) for x in zip(*sent)), *(np.concatenate(x) for x in zip(*told)))


def _by_bucket(rows: np.ndarray, pos: np.ndarray, buckets: int) -> pd.DataFrame:
    """Places packed by a hash of their row, so that one exchange brings those of a row together."""
    to = (mix(rows.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    at = np.lexsort((pos, rows, to))
    rows, pos, to = rows[at], pos[at].astype(np.int32), to[at]
    out = []
    for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
        if len(part):
            used, counts = np.unique(rows[part], return_counts=True)
            packed = (used.tobytes(), counts.astype(np.int32).tobytes(), pos[part].tobytes())
            out.append((int(to[part[0]]), *packed))
    return pd.DataFrame(out, columns=["bucket", "rows", "counts", "places"])


def _per_row(pdf: pd.DataFrame) -> pd.DataFrame:
    """The places of each row, in order and once each."""
    parts = [
        (np.repeat(np.frombuffer(r.rows, np.int64), np.frombuffer(r.counts, np.int32)), np.frombuffer(r.places, np.int32))
        for r in pdf.itertuples(index=False)
    ]
    rows, pos = (np.concatenate(x) for x in zip(*parts))
    at = np.lexsort((pos, rows))
    rows, pos = rows[at], pos[at]
    new = np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(pos) != 0)])
    rows, pos = rows[new], pos[new]
    edges = np.flatnonzero(np.diff(rows)) + 1
    first = np.concatenate([[0], edges])
    return pd.DataFrame({"row_id": rows[first], "places": pd.Series(np.split(pos, edges), dtype=object)})


def _repeated(buckets: int):
    """Places whose hash occurs at two places or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, row, _, pos, known_row, known_pos = _unpack(pdf)
        at = np.argsort(h, kind="stable")
        same = h[at][1:] == h[at][:-1]
        hit = np.zeros(len(h), dtype=bool)
        hit[at[1:][same]] = True
        hit[at[:-1][same]] = True
        return _by_bucket(np.concatenate([row[hit], known_row]), np.concatenate([pos[hit], known_pos]), buckets)

    return run


def _later(buckets: int):
    """Places whose hash occurs earlier: all but the first in the order of documents, rows and positions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, row, order, pos, known_row, known_pos = _unpack(pdf)
        at = np.lexsort((pos, row, order, h))
        hit = np.zeros(len(h), dtype=bool)
        hit[at[1:][h[at][1:] == h[at][:-1]]] = True
        return _by_bucket(np.concatenate([row[hit], known_row]), np.concatenate([pos[hit], known_pos]), buckets)

    return run


def _anchors(window: int, targets: int):
    period, members = cover_of(window)
    length = window - period + 1
    on_cover = np.zeros(period, dtype=bool)
    on_cover[list(members)] = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Settling(targets, all_of_them=True)
        for pdf in frames:
            rows, orders = pdf["row_id"].to_numpy(np.int64), pdf["doc_order"].to_numpy(np.int64)
            for start, texts in batches(list(pdf["text"])):
                words, counts = word_hashes(texts)
                doc, pos = _positions(counts)
                at = np.flatnonzero(on_cover[pos % period] & (pos + length <= counts[doc]) & (counts[doc] >= window))
                if len(at):
                    end = start + len(texts)
                    held.add(rows[start:end], orders[start:end], run_hashes(words, length)[at], doc[at], pos[at])
                if held.n >= FLUSH:
                    yield held.flush()
        if held.n:
            yield held.flush()

    return run


def _windows(window: int, targets: int):
    period, _ = cover_of(window)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Settling(targets, all_of_them=False)
        for pdf in frames:
            rows, orders = pdf["row_id"].to_numpy(np.int64), pdf["doc_order"].to_numpy(np.int64)
            found = list(pdf["places"])
            for start, texts in batches(list(pdf["text"])):
                words, counts = word_hashes(texts)
                doc, pos = _positions(counts)
                begins = np.concatenate([[0], np.cumsum(counts)])
                # A window holds a repeated anchor if one starts at its own start or up to period - 1 words later.
                marks = np.zeros(len(words) + period, dtype=np.int32)
                for i in range(len(texts)):
                    marks[begins[i] + np.asarray(found[start + i])] = 1
                near = np.cumsum(np.concatenate([[0], marks]))
                near = near[period : period + len(words)] - near[: len(words)] > 0
                at = np.flatnonzero(near & (pos + window <= counts[doc]))
                if len(at):
                    end = start + len(texts)
                    held.add(rows[start:end], orders[start:end], run_hashes(words, window)[at], doc[at], pos[at])
                if held.n >= FLUSH:
                    yield held.flush()
        if held.n:
            yield held.flush()

    return run


def _positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document index and position inside it of every word of a batch."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]


def keep_first(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space.

    A word goes if a window of `window` words that covers it has the same words as one that starts earlier: in a
    document with a smaller doc_id, or earlier in the same document. Windows are judged on the texts as they come in.
    Rows with equal ids follow in the order of the table's files, null ids come last. Null and empty texts have no words; texts
    shorter than a window keep all. An empty table gives no rows, extra columns are left out.
    """
    spark = docs.sparkSession
    # Each writing task sends one row to each target, so there are no more of them than even work needs.
    buckets = parallelism(spark)
    targets = 2 * buckets
    # Row names are never null. Said so, no filter on them comes between, and both joins below share the texts' exchange.
    rows = with_row_names(docs.select("doc_id", "text"), "row_id").select(
        F.coalesce("row_id", F.lit(-1)).alias("row_id"),
        F.col("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_order")

    # Exact copies: rows with the same two hashes as an earlier row.
    keys = rows.where(F.col("text").isNotNull()).select(
        "row_id", order, F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")
    )
    firsts = keys.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_order", "row_id")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    firsts = firsts.where("n > 1").select("k1", "k2", F.col("first.row_id").alias("first_row"))
    copies = keys.join(firsts, ["k1", "k2"]).where("row_id <> first_row").select("row_id")

    packed = rows.select("row_id", order, "text").mapInPandas(_anchors(window, targets), PACKED)
    anchors = packed.groupBy("target").applyInPandas(_repeated(buckets), FOUND)
    anchors = anchors.groupBy("bucket").applyInPandas(_per_row, PLACES)
    anchors = anchors.join(copies, "row_id", "left_anti")

    # Here and at the end the texts meet what is known of them by row, with the same columns: one exchange serves both.
    near = rows.join(anchors, "row_id")
    packed = near.select("row_id", order, "text", "places").mapInPandas(_windows(window, targets), PACKED)
    later = packed.groupBy("target").applyInPandas(_later(buckets), FOUND)
    later = later.groupBy("bucket").applyInPandas(_per_row, PLACES)
    gone = later.select("row_id", "places", F.lit(False).alias("is_copy")).unionByName(
        copies.select("row_id", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("is_copy"))
    )
    judged = rows.join(gone, "row_id", "left")
    return judged.select("doc_id", _cut(window)(F.col("text"), F.col("places"), F.col("is_copy")).alias("r")).select(
        "doc_id", "r.*"
    )


def _cut(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, places: pd.Series, copies: pd.Series) -> pd.DataFrame:
        out = []
        for text, starts, is_copy in zip(texts, places, copies):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            n = len(words)
            if is_copy is True and n >= window:
                words = []
            elif starts is not None:
                edge = np.zeros(n + 1, dtype=np.int32)
                starts = np.unique(np.asarray(starts))
                edge[starts] += 1
                edge[starts + window] -= 1
                words = [w for w, gone in zip(words, np.cumsum(edge[:n]) > 0) if not gone]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut

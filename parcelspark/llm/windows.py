"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions.

Documents are turned into token ids and written once. Every source is a queue of tokens in the order of that table. The
windows are served in two steps by the same routine, `serve`: first whole partitions of windows, on the driver, from
one total per source, then the windows of a partition inside the tasks. In each step a source earns credit by its
target share and takes tokens as far as its credit goes; what a turn leaves over or overdraws is carried to the next
window and, in the first step, from partition to partition. A source that has run dry leaves its share to the others.

Which tokens a window takes from a source depends on the totals alone. So a document finds its windows from its place in
its queue, and no ids are shuffled: the second pass reads the written table, cuts it and is done. Only the last window
can be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.tokens import encoder
from parcelspark.session import lookup_join, stage

CAPACITY = 4096
SPAN = 256  # windows of a partition, unless the table of shares would pass CELLS
CELLS = 1 << 22  # partitions times sources of the driver's table (32 MB)
SLICE_BYTES = 8 << 20  # text encoded at a time
LEAST = 32  # shorter pieces wait for more credit unless they end a queue
PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def serve(queued: np.ndarray, weights: np.ndarray, size: int, turns: int, least: int = 1) -> np.ndarray:
    """Tokens that each turn (row) takes from each queue (column); every turn takes `size` while there are as many.

    A queue earns `size` times its share of the weights of the queues that still hold tokens. It takes its whole
    credit, but nothing below `least` tokens unless that empties it. Room left over goes, on credit, to those with
    the most unspent credit.
    """
    left = queued.astype(np.int64).copy()
    credit = np.zeros(len(left))
    out = np.zeros((turns, len(left)), dtype=np.int64)
    for turn in range(turns):
        live = left > 0
        if not live.any():
            break
        shares = np.where(live, weights, 0.0)
        credit = np.where(live, credit + shares * (size / shares.sum()), 0.0)
        room = min(size, int(left.sum()))
        earned = np.clip(np.floor(credit), 0, left).astype(np.int64)
        earned[earned < np.minimum(least, left)] = 0
        for on_credit in (False, True):
            order = np.argsort(-credit, kind="stable")
            wanted = (left if on_credit else earned)[order]
            taken = np.zeros_like(left)
            taken[order] = np.clip(room - (np.cumsum(wanted) - wanted), 0, wanted)
            out[turn] += taken
            left -= taken
            credit -= taken
            room -= int(taken.sum())
            if not room:
                break
    return out


class Plan:
    """Where every token of every queue goes; small, and the same wherever it is rebuilt."""

    def __init__(self, totals: list[int], weights: list[float], capacity: int, span: int) -> None:
        self.capacity = capacity
        whole, queues = sum(totals), max(len(totals), 1)
        windows = -(-whole // capacity)
        self.span = max(span, -(-windows // max(1, CELLS // queues)))
        turns = -(-windows // self.span) if windows else 0
        self.shares = serve(np.array(totals, dtype=np.int64), np.array(weights), self.span * capacity, turns)
        self.starts = np.vstack([np.zeros((1, self.shares.shape[1]), dtype=np.int64), np.cumsum(self.shares, axis=0)])

    @lru_cache(maxsize=256)
    def windows(self, part: int) -> np.ndarray:
        """Tokens taken per window (row) and queue (column) of a partition."""
        share = self.shares[part]
        turns = -(-int(share.sum()) // self.capacity)
        return serve(share, np.maximum(share, 1e-9).astype(float), self.capacity, turns, LEAST)

    def cuts(self, queue: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, window, place in the window) of all runs of a queue that meet the tokens from low to high."""
        first = int(np.searchsorted(self.starts[1:, queue], low, side="right"))
        last = int(np.searchsorted(self.starts[:-1, queue], high, side="left")) - 1
        runs = []
        for part in range(first, last + 1):
            taken = self.windows(part)
            used = np.flatnonzero(taken[:, queue])
            begins = self.starts[part, queue] + np.cumsum(taken[:, queue]) - taken[:, queue]
            places = taken[:, :queue].sum(axis=1)
            runs.append((begins[used], part * self.span + used, places[used]))
        return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES, so that ids and their copies stay small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.column("text").nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _encode(vocabulary: str, end: int):
    """docs -> (part, doc_id, source, queue, before, n, ids): `before` counts the queue's earlier tokens of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in sliced(batches):
            ids, counts = encoder(vocabulary).encode(batch.column("text"), end)
            before = np.zeros(len(counts), dtype=np.int64)
            queues = np.array(batch.column("queue").to_pylist(), dtype=object)
            for q in set(queues):
                own = np.flatnonzero(queues == q)
                reach = seen.get(q, 0) + np.cumsum(counts[own])
                before[own] = reach - counts[own]
                seen[q] = int(reach[-1])
            small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            limits = np.concatenate([[0], np.cumsum(counts)]) * small.itemsize
            if limits[-1] < 1 << 31:
                packed = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(limits.astype(np.int32).tobytes()), pa.py_buffer(small.tobytes())]
                )
            else:
                raw = small.tobytes()
                packed = pa.array([raw[a:b] for a, b in zip(limits, limits[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    batch.column("doc_id"),
                    batch.column("source"),
                    batch.column("queue"),
                    pa.array(before),
                    pa.array(counts),
                    packed,
                ],
                names=["part", "doc_id", "source", "queue", "before", "n", "ids"],
            )

    return run


def _cut(plan: Plan, numbers: dict[str, int]):
    """Encoded documents with their place in the queue -> their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("n").to_numpy()
            places = batch.column("place").to_numpy()
            queues = np.array([numbers[q] for q in batch.column("queue").to_pylist()])
            found = []
            for q in np.unique(queues):
                own = np.flatnonzero(queues == q)
                own = own[np.argsort(places[own], kind="stable")]
                begins = places[own]
                low, high = int(begins[0]), int(begins[-1] + counts[own[-1]])
                cuts, windows, offsets = plan.cuts(int(q), low, high)
                # A piece starts where a document or a window's run starts; runs are only cut inside these documents.
                starts = np.union1d(begins, cuts[(cuts > low) & (cuts < high)])
                at = np.searchsorted(begins, starts, side="right") - 1
                starts, at = starts[starts < begins[at] + counts[own[at]]], at[starts < begins[at] + counts[own[at]]]
                ends = begins[at] + counts[own[at]]
                ends[:-1] = np.minimum(ends[:-1], np.where(at[1:] == at[:-1], starts[1:], ends[:-1]))
                run_at = np.searchsorted(cuts, starts, side="right") - 1
                found.append(
                    np.stack(
                        [own[at], starts - begins[at], ends - starts, windows[run_at], offsets[run_at] + starts - cuts[run_at]]
                    )
                )
            row, start, length, sequence, offset = (pieces := np.concatenate(found, axis=1))[
                :, np.lexsort((pieces[1], pieces[0]))
            ]
            # Pieces follow their documents, so their ids are the documents' ids in a row.
            raw = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4") for b, n in zip(batch.column("ids").to_pylist(), counts, strict=True)]
            ids = np.concatenate(raw).astype("<u4")
            limits = np.concatenate([[0], np.cumsum(length)]) * 4
            step = max(1, int(np.searchsorted(limits, 1 << 28)))
            for a in range(0, len(row), step):
                b = min(len(row), a + step)
                data = ids[limits[a] // 4 : limits[b] // 4].tobytes()
                held = (limits[a : b + 1] - limits[a]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("doc_id").take(pa.array(row[a:b]))),
                        pa.array(batch.column("source").take(pa.array(row[a:b]))),
                        pa.array(start[a:b]),
                        pa.array(length[a:b]),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(held.tobytes()), pa.py_buffer(data)]),
                        pa.array(counts[row[a:b]]),
                        pa.array(sequence[a:b]),
                        pa.array(offset[a:b]),
                    ],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    weights: dict[str | None, float] | None = None,
    vocabulary: str = "word_bpe_49k.json",
    end: int = 2,
    span: int = SPAN,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids, doc_tokens, sequence_id, offset.

    Every id of every document, with `end` after its last one, lies in exactly one piece; `ids` holds a piece's ids
    as little-endian unsigned 32-bit numbers. A sequence is a window of `capacity` ids, offsets are gapless from 0,
    and only the last sequence may be short. `weights` gives the target share of each source (null is a source),
    sources it does not name weigh 1; without it the targets are the sources' own shares of all tokens. Sources are
    bounded by CELLS: their totals lie on the driver.

    Null and empty texts are documents of one id. Rows with null or equal ids are documents of their own. An empty
    table gives no rows; extra columns are left out.
    """
    if weights and not all(w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        # A name for each queue: null must not meet a source that is called so.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("queue"),
        F.col("text").cast("string").alias("text"),
    )
    encoded = text.mapInArrow(
        _encode(vocabulary, end), "part int, doc_id long, source string, queue string, before long, n long, ids binary"
    )
    encoded = stage(encoded, "window-ids")

    sums = encoded.groupBy("part", "queue").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))), "window-sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("_n").alias("n")).collect()}
    names = sorted(totals)
    named = {"" if s is None else f"={s}": float(w) for s, w in (weights or {}).items()}
    shares = [named.get(q, 1.0) if weights else float(totals[q]) for q in names]
    plan = Plan([totals[q] for q in names], shares, capacity, span)

    placed = lookup_join(encoded, sums.drop("_n"), ["part", "queue"], 96 * sums.count(), ["doc_id", "before"], how="inner")
    placed = placed.select("doc_id", "source", "queue", (F.col("_first") + F.col("before")).alias("place"), "n", "ids")
    return placed.mapInArrow(_cut(plan, {q: i for i, q in enumerate(names)}), PIECES)

"""Exact component-wise medians of vector groups of any size, with the vectors packed into blocks.

A group is dealt into blocks by its measured size, so a task never holds more than one block. A group of one block is
finished there. Larger ones keep their blocks, every component sorted by itself, in a staged table. What then travels
are histograms: one array of counts per block, added up in a tree, which narrow the range of the middle values by a
fixed factor each time. Once few entries are left in the range, the blocks hand over just these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.session import lookup_join, stage

BLOCK_BYTES = 16 << 20  # vectors of one block, as doubles
COUNT_BYTES = 2 << 20  # one block's histogram
SELECT_BYTES = 16 << 20  # entries of a group that are selected from at last
FAN_IN = 16

NOTHING = np.iinfo(np.int64).max  # stands for a missing entry, after all values
FLIP = np.int64(np.iinfo(np.int64).max)


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order; missing (NaN) entries come last."""
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.int64)
    return np.where(np.isnan(values), NOTHING, bits ^ ((bits >> 63) & FLIP))


def values_of(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & FLIP)).view(np.float64)


def dense(vectors: pd.Series, d: int) -> np.ndarray:
    """Vectors as rows of doubles; null entries and the ends of short vectors are NaN."""
    try:
        found = np.array(vectors.tolist(), dtype=np.float64)
        if found.shape == (len(vectors), d):
            return found
    except ValueError:
        pass
    found = np.full((len(vectors), d), np.nan)
    for i, v in enumerate(vectors):
        found[i, : len(v)] = np.asarray(v, dtype=np.float64)
    return found


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Halfway between two ordered keys, as a value."""
    a, b = values_of(low), values_of(high)
    return np.where(low == high, a, a / 2 + b / 2)


def middle(keys: np.ndarray) -> np.ndarray:
    """Median of each column of sorted keys; NaN where a column has no entries."""
    n = (keys != NOTHING).sum(axis=0)
    at = np.arange(keys.shape[1])
    low, high = keys[np.maximum(n - 1, 0) // 2, at], keys[np.minimum(n // 2, len(keys) - 1), at]
    return np.where(n > 0, between(low, high), np.nan)


class Search:
    """The ranges that hold the two middle ranks of every component, and what is known about them."""

    def __init__(self, d: int, raw: bytes | None = None) -> None:
        self.d = d
        self.buckets = max(2, 1 << int(np.log2(max(COUNT_BYTES // (16 * max(d, 1)), 2))))
        if raw is None:
            self.low = np.full((2, d), ordered(np.array([-np.inf]))[0])
            self.high = np.full((2, d), ordered(np.array([np.inf]))[0])
            self.before = np.zeros((2, d), dtype=np.int64)
            self.inside = np.full((2, d), NOTHING)
            self.n = np.zeros((2, d), dtype=np.int64)
        else:
            parts = np.frombuffer(raw, dtype=np.int64).reshape(5, 2, d).copy()
            self.low, self.high, self.before, self.inside, self.n = parts

    def pack(self) -> bytes:
        return np.stack([self.low, self.high, self.before, self.inside, self.n]).tobytes()

    def ranks(self) -> np.ndarray:
        return np.stack([np.maximum(self.n[0] - 1, 0) // 2, self.n[1] // 2])

    def span(self) -> np.ndarray:
        return self.high.view(np.uint64) - self.low.view(np.uint64)

    def step(self) -> np.ndarray:
        return self.span() // np.uint64(self.buckets) + np.uint64(1)

    def edges(self, which: int, j: int) -> np.ndarray:
        """First key of every bucket of a range; those past its end are empty."""
        steps = np.arange(self.buckets, dtype=np.uint64) * self.step()[which, j]
        steps = np.minimum(steps, self.span()[which, j] + np.uint64(1))
        return (self.low.view(np.uint64)[which, j] + steps).view(np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Entries per range and bucket; the last column has a component's entries in all."""
        out = np.zeros((2, self.d, self.buckets + 1), dtype=np.int64)
        for j in range(self.d):
            column = keys[:, j]
            out[:, j, -1] = np.searchsorted(column, NOTHING)
            for which in (0, 1):
                starts = np.searchsorted(column, self.edges(which, j))
                end = np.searchsorted(column, self.high[which, j], side="right")
                out[which, j, :-1] = np.diff(np.append(np.minimum(starts, end), end))
        return out

    def narrow(self, counts: np.ndarray) -> None:
        self.n = counts[:, :, -1]
        upto = self.before[:, :, None] + np.cumsum(counts[:, :, :-1], axis=2)
        bucket = np.minimum((upto <= self.ranks()[:, :, None]).sum(axis=2), self.buckets - 1)
        held = np.take_along_axis(counts, bucket[:, :, None], axis=2)[:, :, 0]
        self.before = np.take_along_axis(upto, bucket[:, :, None], axis=2)[:, :, 0] - held
        step = self.step()
        span = self.span()
        first = np.minimum(bucket.astype(np.uint64) * step, span)
        last = np.minimum(first + (step - np.uint64(1)), span)
        base = self.low.view(np.uint64)
        self.low, self.high = (base + first).view(np.int64), (base + last).view(np.int64)
        self.inside = np.where(self.low == self.high, 0, held)

    def ready(self) -> bool:
        return int(np.minimum(self.inside, 1 << 40).sum()) * 8 <= SELECT_BYTES

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries inside the open ranges in a row, their number per range and component)."""
        parts, sizes = [], np.zeros((2, self.d), dtype=np.int64)
        for which, j in zip(*np.nonzero(self.inside), strict=True):
            a = np.searchsorted(keys[:, j], self.low[which, j])
            b = np.searchsorted(keys[:, j], self.high[which, j], side="right")
            parts.append(keys[a:b, j])
            sizes[which, j] = b - a
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), sizes

    def finish(self, entries: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        found, ranks = self.low.copy(), self.ranks()
        starts = [np.concatenate([[0], np.cumsum(s.ravel())]) for s in sizes]
        for which, j in zip(*np.nonzero(self.inside), strict=True):
            at = which * self.d + j
            own = np.concatenate([e[s[at] : s[at + 1]] for e, s in zip(entries, starts, strict=True)])
            place = int(ranks[which, j] - self.before[which, j])
            if len(own):
                found[which, j] = np.partition(own, place)[place]
        return np.where(self.n[0] == 0, np.nan, between(found[0], found[1]))


def median_vectors(
    df: DataFrame,
    keys: list[str],
    vec: str,
    min_count: int = 1,
    block_rows: int | None = None,
    out: str = "ref",
    spread: list[str] | None = None,
) -> DataFrame:
    """keys, out, n_obs: the exact median of every component for groups of at least `min_count` vectors.

    Null and NaN entries are left out of their component; one without entries is null. Vectors of a group may differ
    in length. Null keys form groups like others. `spread` names columns that tell the rows of a group apart and deal
    them into blocks, by default the vector itself; `block_rows` sets the size of a block.
    """
    df = df.where(F.size(vec) > 0)
    rows_of = F.lit(block_rows) if block_rows else F.greatest(F.lit(1), F.lit(BLOCK_BYTES) / (8 * F.col("_d")))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.max(F.size(vec)).alias("_d"))
    sizes = sizes.where(F.col("n_obs") >= min_count).withColumn("_blocks", F.ceil(F.col("n_obs") / rows_of).cast("int"))
    # Small blocks are read in bundles of a full block's size, so that a histogram is made for that many rows.
    per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("_d") * rows_of))).cast("int")
    sizes = stage(sizes.withColumn("_per", per).withColumn("_group", F.monotonically_increasing_id()), "group-sizes")
    groups, most = sizes.agg(F.count(F.lit(1)), F.max("_blocks")).first()
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = dict(df.dtypes)
    key_schema = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True))
    # Null keys meet inside a struct.
    key = F.struct(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)])
    sizes = sizes.select(key.alias("_key"), "n_obs", "_d", "_blocks", "_per", "_group")
    mark = spread or [vec]
    rows = df.select(key.alias("_key"), F.col(vec).alias("_vec"), F.xxhash64(*mark).alias("_mark"))
    rows = lookup_join(rows, sizes, ["_key"], 128 * groups, ["_mark"], how="inner")
    block = F.pmod("_mark", F.col("_blocks")).cast("int")
    rows = rows.select("_key.*", "_group", block.alias("_block"), "_per", "_blocks", "n_obs", "_d", "_vec")
    rows = rows.withColumn("_bundle", F.floor(F.col("_block") / F.col("_per")).cast("int"))

    block_schema = f"{key_schema}, _group long, _block int, _bundle int, _blocks int, n_obs long, _d int, _rows int, _raw binary"
    columns = [c.split()[0] for c in block_schema.split(f"{key_schema}, ")[1].split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_runs(batches, ["_group", "_block"]):
            heads, ends = pdf.iloc[starts], [*starts[1:], len(pdf)]
            raws = []
            for a, b, d, n in zip(starts, ends, heads["_d"], heads["_blocks"], strict=True):
                found = np.sort(ordered(dense(pdf["_vec"].iloc[a:b], int(d))), axis=0)
                raws.append((middle(found) if n == 1 else np.ascontiguousarray(found)).tobytes())
            yield heads.assign(_rows=np.subtract(ends, starts), _raw=raws)[[*names, *columns]]

    dealt = rows.repartition("_group", "_bundle").sortWithinPartitions("_group", "_block")
    blocks = dealt.mapInPandas(pack, block_schema)
    if (most or 0) > 1:
        blocks = stage(blocks, "median-blocks")
        whole = blocks.where("_blocks = 1").select(*names, "n_obs", F.col("_raw").alias("_found"))
        blocks = whole.unionByName(_narrowed(blocks.where("_blocks > 1"), names, key_schema))
    else:
        blocks = blocks.select(*names, "n_obs", F.col("_raw").alias("_found"))
    return blocks.mapInPandas(_read(names, out), f"{key_schema}, {out} array<double>, n_obs long").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], out, "n_obs"
    )


def _starts(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where the runs of equal whole numbers begin."""
    keys = pdf[columns].to_numpy(np.int64)
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))


def _whole_runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in pieces that cut no run of `columns`, with the places where the runs begin."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        same = bool(held) and (held[-1][columns].iloc[-1] == pdf[columns].iloc[0]).all()
        last = int(_starts(pdf, columns)[-1])
        if held and not (same and last == 0):
            whole = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            yield whole, _starts(whole, columns)
            held = [pdf.iloc[last:]]
        elif not held and last:
            yield pdf.iloc[:last], _starts(pdf.iloc[:last], columns)
            held = [pdf.iloc[last:]]
        else:
            held.append(pdf)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, _starts(whole, columns)


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(head, sorted keys) of the blocks of a bundle that come one after the other."""

    def merged(run: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        head = run[0].iloc[:1]
        parts = [np.frombuffer(raw, dtype=np.int64).reshape(-1, int(head["_d"].iloc[0])) for pdf in run for raw in pdf["_raw"]]
        return head, parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts), axis=0)

    run: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        starts = _starts(pdf, ["_group", "_bundle"])
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            if run and (run[-1][["_group", "_bundle"]].iloc[-1] != part[["_group", "_bundle"]].iloc[0]).any():
                yield merged(run)
                run = []
            run.append(part)
    if run:
        yield merged(run)


def _read(names: list[str], out: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[None if v != v else v for v in np.frombuffer(raw).tolist()] for raw in pdf["_found"]]
            yield pdf[names].assign(**{out: found, "n_obs": pdf["n_obs"]})

    return read


def _narrowed(blocks: DataFrame, names: list[str], key_schema: str) -> DataFrame:
    """Medians of the groups of several blocks: names, n_obs, _found."""
    key = F.struct(*names)
    state_schema = f"{key_schema}, _d int, n_obs long, _state binary, _ready boolean"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fresh = [Search(int(d)).pack() for d in pdf["_d"]]
            yield pdf[[*names, "_d", "n_obs"]].assign(_state=fresh, _ready=False)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for head, keys in _bundles(batches):
            counts = Search(int(head["_d"].iloc[0]), head["_state"].iloc[0]).count(keys)
            yield head[[*names, "_bundle", "_d", "n_obs", "_state"]].assign(_counts=[counts.tobytes()])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["_counts"].iloc[0], dtype=np.int64).copy()
        for raw in pdf["_counts"].iloc[1:]:
            total += np.frombuffer(raw, dtype=np.int64)
        return pdf.iloc[:1].assign(_counts=[total.tobytes()], _bundle=pdf["_bundle"].iloc[0] // FAN_IN)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed, ready = [], []
            for d, state, raw in zip(pdf["_d"], pdf["_state"], pdf["_counts"], strict=True):
                search = Search(int(d), state)
                search.narrow(np.frombuffer(raw, dtype=np.int64).reshape(2, int(d), -1))
                packed.append(search.pack())
                ready.append(search.ready())
            yield pdf[[*names, "_d", "n_obs"]].assign(_state=packed, _ready=ready)

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for head, keys in _bundles(batches):
            entries, sizes = Search(int(head["_d"].iloc[0]), head["_state"].iloc[0]).candidates(keys)
            yield head[[*names, "_d", "n_obs", "_state"]].assign(_entries=[entries.tobytes()], _sizes=[sizes.tobytes()])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["_d"].iloc[0])
        search = Search(d, pdf["_state"].iloc[0])
        entries = [np.frombuffer(raw, dtype=np.int64) for raw in pdf["_entries"]]
        sizes = [np.frombuffer(raw, dtype=np.int64).reshape(2, d) for raw in pdf["_sizes"]]
        return pdf.iloc[:1][[*names, "n_obs"]].assign(_found=[search.finish(entries, sizes).tobytes()])

    def with_state(state: DataFrame, groups: int, widest: int) -> DataFrame:
        own = state.select(key.alias("_key"), "_state")
        met = lookup_join(blocks.withColumn("_key", key), own, ["_key"], groups * (80 * widest + 128), ["_bundle"], how="inner")
        return met.drop("_key")

    heads = blocks.select(*names, "_d", "n_obs").distinct()
    state = stage(heads.mapInPandas(begin, state_schema), "median-ranges")
    groups = state.count()
    widest, most = blocks.agg(F.max("_d"), F.max("_bundle") + 1).first()
    count_schema = f"{key_schema}, _bundle int, _d int, n_obs long, _state binary, _counts binary"
    while True:
        counts = with_state(state, groups, widest or 1).mapInPandas(count, count_schema)
        left = most or 1
        while True:  # at least once: a bundle may lie in two tasks
            parent = F.floor(F.col("_bundle") / FAN_IN)
            counts = counts.groupBy(*names, parent.alias("_to")).applyInPandas(add, count_schema)
            left = -(-left // FAN_IN)
            if left == 1:
                break
        state = stage(counts.mapInPandas(narrow, state_schema), "median-ranges")
        if not state.where(~F.col("_ready")).take(1):
            break
    entry_schema = f"{key_schema}, _d int, n_obs long, _state binary, _entries binary, _sizes binary"
    picked = with_state(state, groups, widest or 1).mapInPandas(select, entry_schema)
    return picked.groupBy(*names).applyInPandas(finish, f"{key_schema}, n_obs long, _found binary")

"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are projected to a few random directions, shifted, cut into cells and numbered along a Hilbert curve; several
curves use different projections and shifts. Spark range-partitions each ordering, and a query meets the rows in a
window around its own key. The merged, reranked windows give every query k candidates and so a lower limit for its
k-th score.

Curves alone recall little where vectors have no structure, so an exact check follows. The first curve's order is cut
into chunks of neighbouring vectors, each with a centre and a radius; no inner product with a row of a chunk exceeds
q.centre + |q| radius. Queries go on only to the chunks that could still beat their limit, block against block, which
completes the result. Clustered data leave few chunks; without structure all remain, and the cost is that of comparing
the stated query set with all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.session import stage

BITS = 7  # cells per projected direction: 2 ** BITS
CHUNK_BYTES = 1 << 20  # vectors of one chunk, and of one block of queries
META_BYTES = 64 << 20  # centres and radii that are broadcast for pruning; beyond it no chunk is skipped


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x directions), at most 63 bits in all.

    The usual transposed form: undo the rotations and reflections from the highest bit down, Gray-encode, and
    interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def usable(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, query flags, matrix) of the rows that take part, by length of their vectors."""
    rows = [
        (i, q, v) for i, q, v in zip(pdf["id"], pdf["is_query"], pdf["vector"]) if v is not None and len(v) and i == i
    ]
    for d in sorted({len(v) for _, _, v in rows}):
        own = [r for r in rows if len(r[2]) == d]
        matrix = np.array([np.asarray(v, dtype=np.float64) for _, _, v in own])
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        ids = np.array([r[0] for r in own], dtype=np.int64)
        flags = np.array([bool(r[1]) for r in own])
        if good.any():
            yield d, ids[good], flags[good], matrix[good]


def directions(d: int, curve: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d, curve]).standard_normal((d, dims)) / math.sqrt(d)


def shift(curve: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 7, curve]).uniform(0, 1, dims)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always summed in the same order, so that equal vectors have equal scores."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(a), np.ascontiguousarray(b))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids, each at its best score; larger scores first, then smaller ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    curves: int = 4,
    dims: int = 8,
    window: int = 48,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row.

    Scores are double sums over the original values; ties go to the smaller id. Rows with a null id, and vectors that
    are null, empty, zero or hold null or non-finite values take no part, neither as query nor as candidate. A query
    is compared with vectors of its own length, and never with rows of its own id; fewer than k such rows are all
    returned. Repeated rows count once; an id with several vectors counts once, with its best score. An empty table
    gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    dtype = "<f4" if single else "<f8"  # how vectors travel; all arithmetic is in doubles
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col(embedding).cast("array<float>" if single else "array<double>").alias("vector"),
    ).where(F.col("id").isNotNull())

    # Mean and spread of every projected direction over all rows: a few numbers per length of vectors.
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, _, _, m in usable(pdf):
                for c in range(curves):
                    p = m @ directions(d, c, dims, seed)
                    yield pd.DataFrame(
                        {"d": d, "c": c, "j": range(dims), "n": len(m), "s": p.sum(axis=0), "q": (p * p).sum(axis=0)}
                    )

    sums = rows.mapInPandas(moments, "d int, c int, j int, n long, s double, q double")
    sums = sums.groupBy("d", "c", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = {}
    for r in sums.collect():
        mean = r["s"] / r["n"]
        spread[r["d"], r["c"], r["j"]] = (mean, math.sqrt(max(r["q"] / r["n"] - mean * mean, 1e-18)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, ids, flags, m in usable(pdf):
                packed = [v.tobytes() for v in m.astype(dtype)]
                for c in range(curves):
                    mean = np.array([spread[d, c, j][0] for j in range(dims)])
                    dev = np.array([spread[d, c, j][1] for j in range(dims)])
                    z = (m @ directions(d, c, dims, seed) - mean) / dev + shift(c, dims, seed)
                    cells = np.clip(np.floor((z + 4) / 9 * (1 << BITS)), 0, (1 << BITS) - 1)
                    yield pd.DataFrame(
                        {"d": d, "c": c, "key": hilbert(cells), "id": ids, "is_query": flags, "vector": packed}
                    )

    ordered = rows.mapInPandas(keyed, "d int, c int, key long, id long, is_query boolean, vector binary")
    # The id's hash as last key lets rows of one cell, however many, be split; copies of a row stay together, with one
    # that is a query first.
    ordered = ordered.withColumn("tie", F.xxhash64("id")).repartitionByRange("d", "c", "key", "tie")
    ordered = ordered.sortWithinPartitions("d", "c", "key", "tie", "id", "vector", F.desc("is_query"))
    along = stage(ordered.mapInPandas(_along_curve(k, window, dtype), ALONG), "ann-curves")

    candidates = along.where("kind = 'near'").select(
        F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")
    )
    candidates = candidates.select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    candidates = candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    no_limit = F.lit(float("-inf"))
    limits = ranked.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(no_limit).alias("least")
    )

    # The queries with their limits, back in the order of the first curve, so that a block's queries lie together.
    asked = along.where("kind = 'query'").select("d", "key", "id", "vector")
    asked = asked.join(limits, F.col("id") == F.col("query_id"), "left")
    asked = asked.select("d", "key", "id", "vector", F.coalesce("least", no_limit).alias("least"))
    asked = asked.repartitionByRange("d", "key", "id").sortWithinPartitions("d", "key", "id")

    chunks = along.where("kind = 'chunk'").withColumn("chunk", F.xxhash64("d", "key", "id", "ids"))
    meta = chunks.select("d", "chunk", "centre", "radius")
    size = meta.agg(F.sum(8 * F.col("d") + 24).alias("bytes")).first()["bytes"] or 0
    if size <= META_BYTES:
        known = spark.sparkContext.broadcast([(r["d"], r["chunk"], r["centre"], r["radius"]) for r in meta.collect()])
        routed = asked.mapInPandas(_route(dtype, known), ROUTED)
    else:
        routed = asked.mapInPandas(_route(dtype, None), ROUTED).drop("chunk").join(meta.select("d", "chunk"), "d")
    members = chunks.select("chunk", F.col("ids").alias("members"), F.col("vector").alias("matrix"))
    exact = routed.join(members, "chunk").mapInPandas(_compare(k, dtype), "query_id long, vec_id long, score double")

    merged = candidates.unionByName(exact).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.select(
        "query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score"
    ).where(F.col("rank") <= k)


ALONG = (
    "kind string, d int, key long, id long, vector binary, ids array<long>, scores array<double>, "
    "centre array<double>, radius double"
)
ROUTED = "d int, chunk long, query_ids array<long>, vectors binary, limits array<double>"


def _matrix(vectors: list[bytes], d: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=dtype).reshape(-1, d).astype(np.float64)


def _chunk_rows(d: int, dtype: str) -> int:
    return max(1, CHUNK_BYTES // (d * np.dtype(dtype).itemsize))


def _along_curve(k: int, window: int, dtype: str):
    """One pass over the sorted rows: candidates of each query, chunks and queries of the first curve.

    Only a window's width of rows before and after, and one unfinished chunk, are held.
    """

    def near(ids: np.ndarray, m: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        for i in at:
            low, high = max(0, i - window), min(len(ids), i + window + 1)
            other = np.flatnonzero(ids[low:high] != ids[i]) + low
            scores = inner(m[other], np.broadcast_to(m[i], (len(other), m.shape[1])))
            best = top(scores, ids[other], k)
            yield ("near", m.shape[1], None, int(ids[i]), None, ids[other][best], scores[best], None, None)

    def chunk(d: int, key: int, ids: np.ndarray, m: np.ndarray) -> tuple:
        centre = m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max())) * (1 + 1e-12)
        return ("chunk", d, key, int(ids[0]), m.astype(dtype).tobytes(), ids, None, centre, radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ALONG.split(", ")]
        state: dict = {}

        def finish() -> Iterator[tuple]:
            if state:
                yield from near(state["ids"], state["m"], np.flatnonzero(state["ask"]))
                if len(state["chunk"][0]):
                    yield chunk(state["of"][0], state["key"], *state["chunk"])
                state.clear()

        def extend(of: tuple[int, int], part: pd.DataFrame) -> Iterator[tuple]:
            d, c = of
            # Copies of a row follow each other: the first one stands for all, or they would fill windows and chunks.
            same = (part["id"] == part["id"].shift()) & (part["vector"] == part["vector"].shift())
            same.iloc[0] = bool(state) and state["last"] == (part["id"].iloc[0], part["vector"].iloc[0])
            part = part[~same]
            if not len(part):
                return
            ids, ask = part["id"].to_numpy(), part["is_query"].to_numpy(dtype=bool)
            m = _matrix(list(part["vector"]), d, dtype)
            if not state:
                state.update(of=of, key=0, ids=ids[:0], ask=ask[:0], m=m[:0], chunk=(ids[:0], m[:0]))
            state.update(
                ids=np.concatenate([state["ids"], ids]),
                ask=np.concatenate([state["ask"], ask]),
                m=np.concatenate([state["m"], m]),
                last=(ids[-1], part["vector"].iloc[-1]),
            )
            whole = max(0, len(state["ids"]) - window)  # rows whose window is complete
            done = np.flatnonzero(state["ask"][:whole])
            yield from near(state["ids"], state["m"], done)
            state["ask"][:whole] = False
            cut = max(0, whole - window)
            for name in ("ids", "ask", "m"):
                state[name] = state[name][cut:]
            if c == 0:
                for i in np.flatnonzero(ask):
                    yield ("query", d, int(part["key"].iloc[i]), int(ids[i]), part["vector"].iloc[i], *[None] * 4)
                state["chunk"] = tuple(np.concatenate(x) for x in zip(state["chunk"], (ids, m)))
                state["key"] = int(part["key"].iloc[0])
                rows = _chunk_rows(d, dtype)
                while len(state["chunk"][0]) >= rows:
                    yield chunk(d, state["key"], *(x[:rows] for x in state["chunk"]))
                    state["chunk"] = tuple(x[rows:] for x in state["chunk"])

        for pdf in batches:
            out = []
            for of, part in pdf.groupby(["d", "c"], sort=False):
                if state and state["of"] != of:
                    out.extend(finish())
                out.extend(extend(of, part))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(list(finish()), columns=columns)

    return run


def _route(dtype: str, known):
    """Blocks of queries, each with only those that a chunk could still improve; `known` None: blocks without a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["d", "chunk", "query_ids", "vectors", "limits"]
        table: dict[int, tuple] = {}
        for pdf in batches:
            for d, own in pdf.groupby("d", sort=False):
                rows = _chunk_rows(int(d), dtype)
                for at in range(0, len(own), rows):
                    part = own.iloc[at : at + rows]
                    ids, least = part["id"].to_numpy(), part["least"].to_numpy(dtype=np.float64)
                    raw = np.array(list(part["vector"]), dtype=object)
                    if known is None:
                        yield pd.DataFrame([(d, None, ids, b"".join(raw), least)], columns=columns)
                        continue
                    if d not in table:
                        held = [x for x in known.value if x[0] == d]
                        table[d] = ([x[1] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held]))
                    chunks, centres, radii = table[d]
                    q = _matrix(list(raw), int(d), dtype)
                    norms = np.sqrt((q * q).sum(axis=1))
                    out, held_bytes = [], 0
                    for j, name in enumerate(chunks):
                        bound = q @ centres[j] + norms * radii[j]
                        need = np.flatnonzero(bound >= least - 1e-9 * (1 + np.abs(least)))
                        if len(need):
                            out.append((d, name, ids[need], b"".join(raw[need]), least[need]))
                            held_bytes += len(out[-1][3])
                        if held_bytes > 8 * CHUNK_BYTES:
                            yield pd.DataFrame(out, columns=columns)
                            out, held_bytes = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=columns)

    return run


def _compare(k: int, dtype: str):
    """A block of queries against a chunk: each query's best k different ids that reach its limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q = _matrix([r.vectors], r.d, dtype)
                m = _matrix([r.matrix], r.d, dtype)
                asked, members = np.asarray(r.query_ids), np.asarray(r.members)
                by_id = np.argsort(members, kind="stable")
                members, m = members[by_id], m[by_id]
                limits = np.asarray(r.limits, dtype=np.float64)
                limits = limits - 1e-9 * (1 + np.abs(limits))  # room for the rounding of the block product
                out = []
                for at in range(0, len(q), 256):
                    scores = q[at : at + 256] @ m.T
                    for i, row in enumerate(scores, at):
                        hit = np.flatnonzero((row >= limits[i]) & (members != asked[i]))
                        if len(hit) > k:
                            own = members[hit]
                            each = np.maximum.reduceat(row[hit], np.flatnonzero(np.append(True, own[1:] != own[:-1])))
                            kth = np.partition(each, max(0, len(each) - k))[max(0, len(each) - k)]
                            hit = hit[row[hit] >= kth - 1e-9 * (1 + abs(kth))]
                        if len(hit):
                            exact = inner(m[hit], np.broadcast_to(q[i], (len(hit), q.shape[1])))
                            best = top(exact, members[hit], k)
                            ids = np.full(len(best), asked[i])
                            out.append(pd.DataFrame({"query_id": ids, "vec_id": members[hit][best], "score": exact[best]}))
                if out:
                    yield pd.concat(out)

    return run

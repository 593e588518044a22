"""Whitening of embeddings by incremental eigendecomposition.

Vectors become whole numbers, and each different vector counts once. A task starts from nothing and takes in its vectors
one by one: each is a centred rank-one update of the eigendecomposition of the scatter so far, found from the secular
equation; components that the update leaves alone are deflated. Spectra of tasks are combined in a tree, again by
successive rank-one updates: one for each eigenvector of the other spectrum, one for the distance of the means.

The leading eigenvectors then go over all vectors once more: a distributed product with the covariance gives the
Rayleigh-Ritz problem of their space and its residual, and the space is turned and multiplied again until the residual
is down to rounding. Nothing larger than a matrix of vector length by vector length leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import pieces
from parcelspark.session import stage

EPS = np.finfo(float).eps
TASK_ROWS = 4096  # rank-one updates of one task
FAN_IN = 8  # spectra that one task combines
SLOTS = 64  # partial sums that reach the driver
GUARD = 8  # eigenvectors kept beside the wanted ones
PASSES = 8  # products with the covariance at most
FLAT = 1e-13  # eigenvalues below this share of the total variance count as zero
SPECTRUM = "part long, n long, mean binary, vals binary, vecs binary"
WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Roots of 1 + rho sum z_k^2 / (d_k - x), as the matrix of (root j - d_k); d ascends strictly, rho > 0, no z is 0.

    Every root is measured from the nearer of its two poles. All roots step together by interpolation through both
    poles and are bisected where a step would leave the bracket.
    """
    k = len(d)
    z2 = rho * z * z
    own = np.arange(k)
    right = np.minimum(own + 1, k - 1)
    gap = np.append(d[1:], d[-1] + z2.sum()) - d
    at = d + gap / 2
    upper = (1 + (z2[:, None] / (d[:, None] - at)).sum(axis=0)) < 0
    upper[-1] = False
    origin = np.where(upper, right, own)
    delta = d[:, None] - d[origin]
    lo, hi = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
    if k and 1 + (z2 / (d - at[-1])).sum() < 0:
        lo[-1], hi[-1] = gap[-1] / 2, gap[-1]
    else:
        hi[-1] = gap[-1] / 2
    hi[-1] = hi[-1] * (1 + 4 * EPS)
    mu = (lo + hi) / 2
    left = np.tri(k, dtype=bool).T  # poles up to the root's own
    for _ in range(100):
        away = delta - mu
        t = z2[:, None] / away
        f = 1 + t.sum(axis=0)
        wrong = np.abs(f) > 2 * EPS * k * (1 + np.abs(t).sum(axis=0))
        wrong &= (hi - lo) > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi))
        if not wrong.any():
            break
        hi, lo = np.where(f > 0, mu, hi), np.where(f > 0, lo, mu)
        slope = t / away
        below = np.where(left, slope, 0.0).sum(axis=0)
        above = slope.sum(axis=0) - below
        p, q = away[own, own], away[right, own]
        a, b = (p + q) * f - p * q * (below + above), p * q * f
        c = f - p * below - q * above
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has a pole on one side only.
            s = below[-1] * p[-1] ** 2
            step[-1] = p[-1] + s / (f[-1] - s / p[-1])
            new = mu + step
            inside = (new > lo) & (new < hi)
        mu = np.where(wrong, np.where(inside, new, (lo + hi) / 2), mu)
    return mu - delta


def rank_one(vals: np.ndarray, vecs: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of vecs diag(vals) vecs' + weight v v', weight > 0.

    `vecs` may span less than the whole space; what v has beyond it becomes a new direction of eigenvalue zero first.
    """
    length = float(np.linalg.norm(v))
    if not weight * length * length > 0:
        return vals, vecs
    z = vecs.T @ v
    if vecs.shape[1] < len(v):
        rest = v - vecs @ z
        more = vecs.T @ rest
        rest, z = rest - vecs @ more, z + more
        beyond = float(np.linalg.norm(rest))
        if beyond > 64 * EPS * length:
            vecs = np.column_stack([rest / beyond, vecs])
            vals, z = np.append(0.0, vals), np.append(beyond, z)
    size = float(np.linalg.norm(z))
    rho, z = weight * size * size, z / size
    order = np.argsort(vals, kind="stable")
    vals, vecs, z = vals[order], vecs[:, order].copy(), z[order]

    # Deflation: directions v does not have, then pairs of equal eigenvalues turned so that one does not have v.
    tol = 8 * EPS * max(float(vals[-1]), rho)
    live = rho * np.abs(z) > tol
    at = np.flatnonzero(live)
    a, b = at[:-1], at[1:]
    if len(at) > 1 and ((vals[b] - vals[a]) * np.abs(z[a] * z[b]) <= tol * (z[a] ** 2 + z[b] ** 2)).any():
        last = at[0]
        for j in at[1:]:
            r = math.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if (vals[j] - vals[last]) * abs(c * s) <= tol:
                z[j], z[last], live[last] = r, 0.0, False
                vecs[:, [last, j]] = vecs[:, [last, j]] @ np.array([[c, s], [-s, c]])
                vals[last], vals[j] = vals[last] * c * c + vals[j] * s * s, vals[last] * s * s + vals[j] * c * c
            last = j
        at = np.flatnonzero(live)
        at = at[np.argsort(vals[at], kind="stable")]
    if len(at):
        d, z = vals[at], z[at]
        away = secular(d, z, rho)  # root j - d_k
        # The z that these roots belong to exactly: with it the eigenvectors are orthogonal to rounding.
        poles = d - d[:, None]
        np.fill_diagonal(poles, 1.0)
        exact = np.sqrt(np.abs(np.prod(away / poles, axis=1))) * np.sign(z)
        turn = exact[:, None] / away
        turn /= np.linalg.norm(turn, axis=0)
        vals, vecs = vals.copy(), vecs
        vals[at] = d + np.diagonal(away)
        vecs[:, at] = vecs[:, at] @ turn
    order = np.argsort(vals, kind="stable")
    return np.maximum(vals[order], 0.0), vecs[:, order]


class Spectrum:
    """Number, mean and eigendecomposition of the scatter about the mean of some vectors."""

    def __init__(self, d: int) -> None:
        self.n, self.mean = 0, np.zeros(d)
        self.vals, self.vecs = np.zeros(0), np.zeros((d, 0))

    def add(self, y: np.ndarray) -> None:
        self.n += 1
        away = y - self.mean
        self.vals, self.vecs = rank_one(self.vals, self.vecs, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away = other.mean - self.mean
        for value, vector in zip(other.vals, other.vecs.T, strict=True):
            self.vals, self.vecs = rank_one(self.vals, self.vecs, vector, float(value))
        n = self.n + other.n
        self.vals, self.vecs = rank_one(self.vals, self.vecs, away, self.n / n * other.n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "part": [part],
                "n": [self.n],
                "mean": [self.mean.tobytes()],
                "vals": [self.vals.tobytes()],
                "vecs": [np.ascontiguousarray(self.vecs).tobytes()],
            }
        )

    @staticmethod
    def read(row) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        found = Spectrum(len(mean))
        found.n, found.mean, found.vals = int(row["n"]), mean, np.frombuffer(row["vals"])
        found.vecs = np.frombuffer(row["vecs"]).reshape(len(mean), -1) if len(found.vals) else np.zeros((len(mean), 0))
        return found


class Centre:
    """The exact mean of the fit list: its size and sums. Differences are taken in whole numbers."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits if they fit, else in Python's whole numbers."""
        limit = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if limit < 1 << 63:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n x - S; None beyond 64 bits."""
        away = self.numerators(x)
        most = int(np.abs(away).max(initial=0))
        if most * most * max(1, away.shape[1]) < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        whole = (away.astype(object) ** 2).sum(axis=1)
        return [int(w) if w < 1 << 63 else None for w in whole]


def matrix(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=np.int64).reshape(len(pdf), d)


def _total(fit: DataFrame, d: int, centre: Centre, basis: np.ndarray, whiten: np.ndarray | None = None) -> tuple:
    """Sums over the fit list: y (y' basis), |y|^2 - or, with `whiten`, of w and w w' for w = (y' basis) whiten."""
    rows = d if whiten is None else basis.shape[1] + 1

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, square = np.zeros((rows, basis.shape[1])), 0.0
        for pdf in frames:
            y = centre.centred(matrix(pdf, d))
            on = y @ basis
            if whiten is None:
                held += y.T @ on
                square += float((y * y).sum())
            else:
                w = on * whiten
                held += np.vstack([w.T @ w, w.sum(axis=0)])
        slot = TaskContext.get().partitionId() % SLOTS
        yield pd.DataFrame({"slot": [slot], "held": [held.tobytes()], "square": [square]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(rows * basis.shape[1])
        for raw in pdf["held"]:
            held += np.frombuffer(raw)
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "held": [held.tobytes()], "square": [pdf["square"].sum()]})

    kind = "slot int, held binary, square double"
    sums = fit.mapInPandas(part, kind).groupBy("slot").applyInPandas(add, kind).orderBy("slot").collect()
    held = sum(np.frombuffer(r["held"]).reshape(rows, -1) for r in sums)
    return held, sum(r["square"] for r in sums)


def incremental(fit: DataFrame, d: int, centre: Centre) -> Spectrum:
    """The spectrum of the fit list by rank-one updates in the tasks and from task to task."""

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Spectrum(d)
        for pdf in frames:
            for y in centre.centred(matrix(pdf, d)):
                found.add(y)
        yield found.row(TaskContext.get().partitionId())

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Spectrum(d)
        for _, row in pdf.sort_values("part").iterrows():
            found.merge(Spectrum.read(row))
        return found.row(int(pdf["part"].min()) // FAN_IN)

    parts = pieces(centre.n, TASK_ROWS)
    spectra = fit.repartition(parts).mapInPandas(update, SPECTRUM)
    while parts > 1:
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("_to")).applyInPandas(combine, SPECTRUM)
        parts = pieces(parts, FAN_IN)
    found = Spectrum(d)
    for row in spectra.collect():  # one spectrum, none of an empty table
        found.merge(Spectrum.read(row))
    return found


def components(fit: DataFrame, d: int, centre: Centre, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, eigenvectors as columns, trace) of the covariance of the fit list."""
    found = incremental(fit, d, centre)
    width = min(d, k + GUARD)
    basis = np.linalg.qr(np.column_stack([found.vecs[:, ::-1], np.eye(d)]))[0][:, :width]
    best, vals, vecs, trace = math.inf, np.zeros(width), basis, 0.0
    for _ in range(PASSES):
        product, square = _total(fit, d, centre, basis)
        product, trace = product / centre.n, square / centre.n
        small = basis.T @ product
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz = basis @ turn
        rest = np.linalg.norm((product @ turn - ritz * theta)[:, :k], axis=0).max(initial=0.0)
        better = rest < 0.95 * best
        if rest < best:
            best, vals, vecs = rest, theta, ritz
        if not better or rest <= 4 * EPS * max(theta[0], 0.0):
            break
        basis = np.linalg.qr(np.where(theta > FLAT * max(trace, 0.0), product @ turn, ritz))[0]
    return vals[:k], vecs[:, :k], trace


def whiten(
    vectors: DataFrame,
    k: int = 16,
    scale: int = 64,
    offset: int = 1_000_000,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    An entry c counts as floor(scale c) + offset. The fit list holds each different vector once: n of them, with sums
    S. deviation: the sum of (n x - S)^2, exact, null beyond 64 bits. whitened: x - S/n along the component, over the
    root of its eigenvalue. explained: the eigenvalue's share of the variance. identity_error: how far the covariance
    of `whitened` over the fit list is from the identity, at most, over the components that have one.

    Vectors that are null or hold null or non-finite entries are left out; empty ones have no component. Repeated
    rows and null ids come out like any other row. Vectors of each length are a fit list of their own. A component
    without variance (fewer different vectors than components, constant entries) has a null `whitened`; without any
    variance explained and identity_error are null. Entries beyond 2^61 count as 2^61. An empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    most = float(1 << 61)

    def whole(c):
        return F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))) + F.lit(offset).cast("long")

    cell = F.col(embedding).cast("array<double>")
    bad = F.exists(cell, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(embedding).isNotNull() & (F.size(cell) > 0) & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(cell, whole).alias("x")
    )
    fit = stage(rows.select("x").distinct(), "whitening-fit")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for pdf in frames:
            sizes = pdf["x"].map(len)
            for d in sizes.unique():
                x = matrix(pdf[sizes == d], int(d))
                n, s = held.get(d, (0, np.zeros(int(d), dtype=object)))
                held[d] = (n + len(x), s + x.astype(object).sum(axis=0))
        for d, (n, s) in held.items():
            yield pd.DataFrame({"d": int(d), "j": range(int(d)), "n": n, "s": [str(v) for v in s]})

    total = fit.mapInPandas(sums, "d int, j int, n long, s string").groupBy("d", "j")
    total = total.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    centres: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("d", "j").collect():  # one row per dimension
        centres.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))

    out = spark.createDataFrame([], WHITENED)
    for d, (n, s) in centres.items():
        out = out.union(_whitened(rows.where(F.size("x") == d), fit.where(F.size("x") == d), d, Centre(n, s), min(k, d)))
    return out


def _whitened(rows: DataFrame, fit: DataFrame, d: int, centre: Centre, k: int) -> DataFrame:
    vals, vecs, trace = components(fit, d, centre, k)
    useful = vals > FLAT * max(trace, 0.0)
    over = np.where(useful, 1 / np.sqrt(np.where(useful, vals, 1.0)), np.nan)
    explained = vals / trace if trace > 0 else np.full(k, np.nan)
    error = np.nan
    if useful.any():
        held, _ = _total(fit, d, centre, vecs[:, useful], over[useful])
        mean = held[-1] / centre.n
        error = float(np.abs(held[:-1] / centre.n - np.outer(mean, mean) - np.eye(len(mean))).max())

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = matrix(pdf, d)
            w = np.einsum("ij,jk->ik", centre.centred(x), vecs) * over
            ids = pdf["vec_id"].astype("Int64").repeat(k).reset_index(drop=True)
            away = pd.Series(centre.deviations(x), dtype="Int64").repeat(k).reset_index(drop=True)
            yield pd.DataFrame(
                {
                    "vec_id": ids,
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": centre.n,
                    "deviation": away,
                    "whitened": pd.Series(w.ravel()).astype("Float64"),
                    "explained": pd.Series(np.tile(explained, len(x))).astype("Float64"),
                    "identity_error": pd.Series(np.full(len(x) * k, error)).astype("Float64"),
                }
            )

    return rows.mapInPandas(project, WHITENED)

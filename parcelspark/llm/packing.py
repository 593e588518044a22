"""Conflict-constrained best-fit packing of documents into training sequences.

Documents longer than the capacity give full pieces, which fill a bin each, and a remainder. The remaining pieces are
dealt into random groups of bounded size and every group is packed on its own: pieces in descending length, open bins
ordered by residual space. Each bin carries a bitmap of the sources and of the duplicate clusters it holds. For a piece
the search starts at the smallest residual that takes it and goes on to the next larger one until a bin without a
conflicting bit is found, the tightest compatible bin; otherwise a new bin is opened.

Groups are cut from a hash of the row, so a source or a cluster with a third of all rows is spread over all groups.
Copies in different groups are in different bins by construction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import free_name, pieces, with_row_names, word_count, words

SCAN = 64  # bins looked at in one step of the successor search


class Bins:
    """Open bins in the order of their residuals, each with a bitmap of what it holds."""

    def __init__(self, bits: int, most: int) -> None:
        self.n = 0
        self.residual = np.zeros(most, dtype=np.int64)
        self.number = np.zeros(most, dtype=np.int64)
        self.maps = np.zeros((bits // 64 + 1, most), dtype=np.uint64)
        self.opened = 0

    def tightest(self, size: int, bits: list[int]) -> int | None:
        """Place of the bin with the least sufficient residual that has none of the bits."""
        at = int(np.searchsorted(self.residual[: self.n], size))
        while at < self.n:
            to = min(self.n, at + SCAN)
            clash = np.zeros(to - at, dtype=np.uint64)
            for b in bits:
                clash |= (self.maps[b >> 6, at:to] >> np.uint64(b & 63)) & np.uint64(1)
            free = np.flatnonzero(clash == 0)
            if len(free):
                return at + int(free[0])
            at = to
        return None

    def take(self, at: int) -> tuple[int, int, np.ndarray]:
        found = int(self.residual[at]), int(self.number[at]), self.maps[:, at].copy()
        for a in (self.residual, self.number):
            a[at : self.n - 1] = a[at + 1 : self.n]
        self.maps[:, at : self.n - 1] = self.maps[:, at + 1 : self.n]
        self.n -= 1
        return found

    def put(self, residual: int, number: int, held: np.ndarray) -> None:
        at = int(np.searchsorted(self.residual[: self.n], residual, side="right"))
        self.residual[at + 1 : self.n + 1] = self.residual[at : self.n].copy()
        self.number[at + 1 : self.n + 1] = self.number[at : self.n].copy()
        self.maps[:, at + 1 : self.n + 1] = self.maps[:, at : self.n].copy()
        self.residual[at], self.number[at], self.maps[:, at] = residual, number, held
        self.n += 1


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin numbers of the pieces; `sources` and `clusters` are small codes, cluster -1 cannot conflict."""
    n_sources = int(sources.max()) + 1 if len(sources) else 0
    n_bits = n_sources + (int(clusters.max()) + 1 if len(clusters) else 0)
    bins = Bins(n_bits, len(sizes) + 1)
    out = np.empty(len(sizes), dtype=np.int64)
    for i in range(len(sizes)):
        size = int(sizes[i])
        bits = [int(sources[i])] + ([n_sources + int(clusters[i])] if clusters[i] >= 0 else [])
        at = bins.tightest(size, bits)
        if at is None:
            residual, number, held = capacity, bins.opened, np.zeros(len(bins.maps), dtype=np.uint64)
            bins.opened += 1
        else:
            residual, number, held = bins.take(at)
        for b in bits:
            held[b >> 6] |= np.uint64(1) << np.uint64(b & 63)
        out[i] = number
        if residual > size:
            bins.put(residual - size, number, held)
    return out


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "_hash", "row_id", "piece"], ascending=[False, True, True, True], kind="stable")
        full = (pdf["n_words"] >= capacity).to_numpy()
        numbers = np.empty(len(pdf), dtype=np.int64)
        rest = pdf[~full]
        sources = pd.factorize(rest["source"], use_na_sentinel=False)[0]
        clusters, _ = pd.factorize(rest["_cluster"])
        shared = np.bincount(clusters, minlength=1)[clusters] > 1 if len(clusters) else np.zeros(0, dtype=bool)
        codes = np.full(len(rest), -1)
        codes[shared] = pd.factorize(clusters[shared])[0]
        numbers[~full] = best_fit(rest["n_words"].to_numpy(), sources, codes, capacity)
        opened = int(numbers[~full].max()) + 1 if (~full).any() else 0
        numbers[full] = opened + np.arange(full.sum())
        pdf = pdf.assign(bin_id=pdf["_group"].to_numpy() * 2**32 + numbers)
        pdf["position"] = pdf.groupby("bin_id").cumcount().astype("int32")
        pdf["bin_words"] = pdf.groupby("bin_id")["n_words"].transform("sum")
        return pdf[["row_id", "doc_id", "source", "piece", "start_word", "n_words", "bin_id", "position", "bin_words"]]

    return pack


PACKED = (
    "row_id long, doc_id long, source string, piece int, start_word long, n_words long, "
    "bin_id long, position int, bin_words long"
)


def pack(
    docs: DataFrame, capacity: int = 2048, group_rows: int = 2048, seed: int = 3, row_name: str | None = None
) -> DataFrame:
    """One row per piece: row_id, doc_id, source, piece, start_word, n_words, bin_id, position, bin_words.

    A bin holds at most `capacity` words, at most one piece of each source (null is a source of its own) and no two
    copies of one text. Full pieces stand alone. Documents without words (null, empty) take no space: they come out
    with n_words 0 and null bin, position and bin_words. Repeated rows are copies of each other. An empty table gives
    no rows; extra columns are left out. row_id names the row of the table (`row_name`: a
    column that holds such names already).
    """
    if row_name is None:
        docs, row_name = with_row_names(docs.select("doc_id", "source", "text"), "row_id"), "row_id"
    rows = docs.select(
        F.col(row_name).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_cluster"),
        word_count(F.col("text")).alias("_words"),
    )
    cut = rows.withColumn("piece", F.explode(F.expr(f"sequence(0, int(greatest(_words - 1, 0) div {capacity}))")))
    cut = cut.select(
        "row_id",
        "doc_id",
        "source",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start_word"),
        F.least(F.lit(capacity).cast("long"), F.col("_words") - F.col("piece") * capacity).alias("n_words"),
        F.xxhash64("_cluster", "piece").alias("_cluster"),
        F.xxhash64(F.lit(seed), "doc_id", "source", "_cluster", "piece", "row_id").alias("_hash"),
    )
    groups = pieces(docs.count(), group_rows)
    cut = cut.withColumn("_group", F.pmod(F.col("_hash"), F.lit(groups)))
    packed = cut.where("n_words > 0").groupBy("_group").applyInPandas(_pack_group(capacity), PACKED)
    empty = cut.where("n_words = 0").select(
        "row_id", "doc_id", "source", "piece", "start_word", "n_words",
        F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("int").alias("position"),
        F.lit(None).cast("long").alias("bin_words"),
    )
    return packed.unionByName(empty)


def packed_texts(docs: DataFrame, **options) -> DataFrame:
    """The pieces of `pack` with their words, joined by one space, as `text`."""
    row = free_name(docs, "row_id")
    numbered = with_row_names(docs, row)
    placed = pack(numbered, row_name=row, **options)
    texts = numbered.select(F.col(row).alias("row_id"), words(F.col("text")).alias("_words"))
    cut = F.slice("_words", (F.col("start_word") + 1).cast("int"), F.greatest(F.col("n_words"), F.lit(1)).cast("int"))
    return placed.join(texts, "row_id").select(
        *placed.columns, F.when(F.col("n_words") > 0, F.array_join(cut, " ")).otherwise(F.lit("")).alias("text")
    )

"""Frequent phrases whose words belong together, from Rabin-Karp fingerprints of all n-grams.

Texts are read as bytes. Polynomial prefix sums over a batch give two independent hashes of every word, and prefix sums
over the words the fingerprint and the check of every run of words. A task combines equal runs and keeps a pointer to
the text with the first of them. The shuffle adds up fingerprints with their pointers. Three passes
find the fingerprints that are frequent enough: words, then pairs of frequent words, then runs of three and four whose
pairs are all frequent. Which fingerprints are frequent is known to the next pass from a bit table of fixed size; a
table too full lets more fingerprints through and loses none.

Two phrases with one fingerprint are told apart by their checks, so each has its own count and pointer (96 bits in all).
Only the phrases found frequent are ever materialised: their pointers meet the rows they point to, where the text is
hashed again and the words are read that both hashes confirm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import with_row_names
from parcelspark.llm.wordhash import mix
from parcelspark.session import lookup_join, stage

LONGEST = 4
BATCH_BYTES = 1 << 19
HELD = 2_500_000  # runs a task holds before it passes them on
FILTER_BITS = 1 << 26  # bits of the table of frequent fingerprints (8 MB)
BLOCK_BITS = 1 << 18
SPREAD = 64  # parts of a language in the first step of its ranking
COPIES = 8  # parts of a frequent first or last word's phrases where counts are too many to broadcast

BASES = (0xD1342543DE82EF95, 0x9E6C63D0876A9A35)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BREAK = re.compile(rb"[.,;:!?\n\x0B\x0C\r]")
RUNS = "print long, check int, n int, row long"
KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; the longest table of each base is kept, and tables grow with the batches only."""
    if len(_tables.get(base, ())) < n:
        table = np.full(1 << int(n).bit_length(), base, dtype=np.uint64)
        table[0] = 1
        _tables[base] = np.cumprod(table, out=table)
    return _tables[base][:n]


def prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, back): the hash of values[a:b] is (sums[b] - sums[a]) * back[a], wherever it stands."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, powers(base, len(values)), out=sums[1:])
    np.cumsum(sums, out=sums)
    return sums, powers(pow(base, -1, 1 << 64), len(values) + 1)


class Batch:
    """The words of some texts: their hashes, pieces, languages and places."""

    def __init__(self, texts: list[bytes], langs: list[str], rows: list[int]) -> None:
        self.names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.raw = b"\n".join(texts).translate(LOWER)
        joined = np.frombuffer(self.raw, dtype=np.uint8)
        kind = KIND[joined]
        edges = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(self.starts)
        # A break anywhere since the last word opens a new piece.
        self.piece = np.concatenate([[0], np.cumsum(kind == 2)])[self.starts]
        limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(limits, self.starts, side="right") - 1
        self.lang = code[text]
        self.row = np.array(rows, dtype=np.int64)[text]
        salts = [hash_bytes(str(name).encode("utf-8", "surrogatepass")) for name in self.names]
        self.salt = mix(np.array(salts, dtype=np.uint64))[self.lang]
        letters, lengths = joined.astype(np.uint64) + np.uint64(1), (self.ends - self.starts).astype(np.uint64)
        self.sums = []
        for base in BASES:
            sums, back = prefix(letters, base)
            word = mix((sums[self.ends] - sums[self.starts]) * back[self.starts] + lengths)
            self.sums.append(prefix(word, base))

    def runs(self, size: int) -> np.ndarray:
        """The first word of every run of `size` words within a piece; of size 0, every word."""
        if size < 2:
            return np.arange(self.n)
        at = np.arange(max(self.n - size + 1, 0))
        return at[self.piece[at] == self.piece[at + size - 1]]

    def _hash(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        sums, back = self.sums[which]
        return mix(((sums[at + size] - sums[at]) * back[at] + np.uint64(size)) ^ self.salt[at])

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the runs of `size` words from `at`, in their language; of size 0, the language's own."""
        return self._hash(at, size, 0) if size else self.salt[at]

    def checks(self, at: np.ndarray, size: int) -> np.ndarray:
        """A second, independent hash of the runs."""
        found = self._hash(at, size, 1) if size else self.salt[at]
        return (found >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def text(self, at: int, size: int) -> str:
        words = [self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + size)]
        return b" ".join(words).decode("utf-8", "surrogatepass")


def hash_bytes(raw: bytes) -> int:
    found = len(raw)
    for b in raw:
        found = (found * BASES[0] + b + 1) % (1 << 64)
    return found


def is_in(prints: np.ndarray, allowed: np.ndarray | None) -> np.ndarray:
    """Which fingerprints may be frequent: the bit of each in the packed table; without one, all."""
    if allowed is None:
        return np.ones(len(prints), dtype=bool)
    place = prints % np.uint64(8 * len(allowed))
    return (allowed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def at_breaks(raw: bytes) -> Iterator[bytes]:
    """A text, or parts of a very long one; no phrase reaches over the break between two pieces."""
    while len(raw) > BATCH_BYTES:
        found = BREAK.search(raw, BATCH_BYTES)
        cut = found.end() if found else len(raw)
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[Batch]:
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for pdf in frames:
        for text, lang, row in zip(pdf["text"], pdf["lang"], pdf["row"], strict=True):
            for raw in at_breaks((text or "").encode("utf-8", "surrogatepass")):
                if size and size + len(raw) > BATCH_BYTES:
                    yield Batch(*held)
                    held, size = ([], [], []), 0
                for values, value in zip(held, (raw, lang, row), strict=True):
                    values.append(value)
                size += len(raw) + 1
    if held[0]:
        yield Batch(*held)


class Runs:
    """Equal runs with their number and the pointer to the first one."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, prints: np.ndarray, checks: np.ndarray, rows: np.ndarray) -> None:
        self.held.append(self.merged([(prints, checks, np.ones(len(prints), dtype=np.int32), rows)]))
        self.n += len(self.held[-1][0])
        if self.n > HELD:
            self.held = [self.merged(self.held)]
            self.n = len(self.held[0][0])

    @staticmethod
    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        prints = np.concatenate([h[0] for h in held])
        order = np.argsort(prints, kind="stable")
        prints, checks = prints[order], np.concatenate([h[1] for h in held])[order]
        new = np.ones(len(prints), dtype=bool)
        new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
        first = np.flatnonzero(new)
        counts = np.concatenate([h[2] for h in held])[order]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        rows = np.concatenate([h[3] for h in held])[order[first]]
        return prints[first], checks[first], counts, rows

    def frames(self) -> Iterator[pd.DataFrame]:
        if self.held:
            prints, checks, counts, rows = self.merged(self.held)
            self.held, self.n = [], 0
            for a in range(0, len(prints), 100_000):
                part = slice(a, a + 100_000)
                yield pd.DataFrame({"print": prints[part].view(np.int64), "check": checks[part], "n": counts[part], "row": rows[part]})


def _count(sizes: list[int], allowed: np.ndarray | None):
    """The runs of these sizes whose parts may all be frequent, counted in the task; size 0 counts a language's words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Runs()
        for batch in batches(frames):
            for size in sizes:
                at = batch.runs(size)
                if size > 1 and allowed is not None:
                    part = min(size - 1, 2)  # pairs need frequent words, longer runs frequent pairs
                    parts = batch.runs(part)
                    good = np.zeros(batch.n + 1, dtype=bool)
                    good[parts[is_in(batch.prints(parts, part), allowed)]] = True
                    keep = np.ones(len(at), dtype=bool)
                    for k in range(size - part + 1):
                        keep &= good[at + k]
                    at = at[keep]
                held.add(batch.prints(at, size), batch.checks(at, size), batch.row[at])
                if held.n > HELD * 3 // 4:
                    yield from held.frames()
        yield from held.frames()

    return run


def _materialise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text, lang, row, runs -> lang, size, phrase, n of each run that points to the text."""
    for pdf in frames:
        open_ = {(row, r["print"], r["check"]): r["n"] for row, runs in zip(pdf["row"], pdf["runs"], strict=True) for r in runs}
        wanted = np.unique(np.array([k[1] for k in open_], dtype=np.int64)).view(np.uint64)
        found = []
        for batch in batches(iter([pdf])):
            for size in range(LONGEST + 1):
                at = batch.runs(size)
                prints = batch.prints(at, size)
                near = np.isin(prints, wanted)
                at, prints = at[near], prints[near].view(np.int64)
                for i, p, c, row in zip(at.tolist(), prints.tolist(), batch.checks(at, size).tolist(), batch.row[at].tolist(), strict=True):
                    n = open_.pop((row, p, c), None)
                    if n is not None:
                        found.append((batch.names[batch.lang[i]], size, batch.text(i, size), n))
        if open_:
            raise ValueError("texts without the runs that point to them: the table changed while it was read")
        yield pd.DataFrame(found, columns=["lang", "size", "phrase", "n"])


def frequent_runs(texts: DataFrame, sizes: list[int], allowed: np.ndarray | None, least: int) -> DataFrame:
    """print, check, n, row of the runs of these sizes that occur at least `least` times."""
    counted = texts.mapInPandas(_count(sizes, allowed), RUNS)
    # Tasks have combined their rows already: straight to the shuffle.
    counted = counted.repartition("print").groupBy("print", "check")
    # Any of the rows will do; a hash spreads the pointers over all of them.
    pointer = F.min_by("row", F.xxhash64("print", "row")).alias("row")
    found = counted.agg(F.sum("n").alias("n"), pointer).where(F.col("n") >= least)
    return stage(found, "phrase-runs")


def bit_table(prints: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit per fingerprint in a table of fixed size, a power of two; separate tasks fill its blocks."""
    width = min(BLOCK_BITS, bits)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(width, dtype=bool)
        block[pdf["place"].to_numpy()] = True
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    place = F.col("print").bitwiseAND(F.lit(bits - 1))
    placed = prints.select(place.alias("place")).distinct()
    placed = placed.select((F.col("place") / width).cast("int").alias("block"), F.pmod("place", F.lit(width)).cast("int").alias("place"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("block").applyInPandas(fill, "block int, bits binary").collect():
        table[r["block"] * width // 8 :][: width // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


def count_phrases(docs: DataFrame, least: int = 30, bits: int = FILTER_BITS) -> DataFrame:
    """lang, size, phrase, n: every phrase of 1 to 4 words with n >= least, and one row of size 0 with a language's words.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line breaks and into words at spaces and tabs;
    phrases lie within a piece, overlaps count. Null texts have no words, null languages are `und`.
    """
    texts = with_row_names(docs.select("text", "lang"), "row").select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        "row",
    )
    # Names without gaps: three bytes instead of six travel with every run.
    files = texts.agg(F.max(F.shiftright("row", 40))).first()[0] or 0
    dense = F.col("row").bitwiseAND(F.lit((1 << 40) - 1)) * (files + 1) + F.shiftright("row", 40)
    texts = texts.withColumn("row", dense)
    words = frequent_runs(texts, [0, 1], None, least)
    pairs = frequent_runs(texts, [2], bit_table(words, bits), least)
    longer = frequent_runs(texts, [3, 4], bit_table(pairs, bits), least)
    runs = words.unionByName(pairs).unionByName(longer)
    by_row = runs.groupBy("row").agg(F.collect_list(F.struct("print", "check", "n")).alias("runs"))
    by_row = stage(by_row, "phrase-pointers")
    known = by_row.agg(F.sum(F.size("runs") * 32 + 64)).first()[0] or 0
    told = lookup_join(texts, by_row, ["row"], known, ["row"], how="inner", salts=1)
    return stage(told.mapInPandas(_materialise, "lang string, size int, phrase string, n long"), "phrase-counts")


def collocations(
    docs: DataFrame, least: int = 30, covered_pct: int = 80, top: int = 2000, bits: int = FILTER_BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to 4 words of each language.

    A phrase with a >= least occurrences is scored at its weakest cut: floor(2,000,000 a / (l + r)), l and r being
    the counts of the parts; the first of equal cuts counts. Phrases inside a longer frequent one that makes up
    `covered_pct` percent of their occurrences are left out. Order: score, a, then the phrase by its UTF-8 bytes.
    Rows with null or repeated ids are texts like any other; languages without such phrases give no rows, an empty
    table none at all. Columns other than text and lang are not read.
    """
    counts = count_phrases(docs, least, bits)
    of_all = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("_all"))
    phrases = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    size_of_counts = counts.select(F.sum(F.length("phrase") + F.length("lang") + 64)).first()[0] or 0

    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("_first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("_rest"),
    )
    for part, name in (("_first", "l"), ("_rest", "r")):
        known = phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cut = lookup_join(cut, known, ["lang", part], 2 * size_of_counts, ["phrase", "k"], how="inner", salts=COPIES)
    wide = "decimal(19,0)"  # products of counts may pass 64 bits
    score = F.expr(f"(cast(2000000 as {wide}) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))

    longer = candidates.where("size > 2").withColumn("_words", words)
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1),"
        " i -> array_join(slice(_words, i, w), ' '))))"
    )
    inside = longer.select("lang", F.explode(spans).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = weakest.join(inside, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull()
        | (F.lit(100).cast(wide) * F.col("_longer").cast(wide) < F.lit(covered_pct).cast(wide) * F.col("a").cast(wide))
    )
    scored = left.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")

    # A language may hold most phrases: the best of many parts first, then the best of these.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    near = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    scored = scored.withColumn("_near", near).where(F.col("_near") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(of_all, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("_all").alias("n"), F.col("score").cast("long").alias("score")
    )

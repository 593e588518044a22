"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a random but fixed order, cut into blocks of about `block_words` words. The target of
a source says how often its block list is gone through: whole passes, then a last one that takes single documents up
to the words still missing, whatever their blocks. The blocks so met are the source's quota. A binary tree over the output shards splits the quotas of all sources at once:
at every node the left half gets its share of the blocks, drawn without replacement, so every shard has nearly the
same number of blocks and quotas are met exactly. A shard then takes its own, disjoint stretch of each source's
permuted blocks and shuffles it locally.

The driver sees one row per source and the tree over shards x sources, never documents or blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import free_name, with_row_names, word_count
from parcelspark.session import stage

BUCKET_ROWS = 4096  # rows of a source that one running sum covers
SOURCE_CAP = 3.0  # a source gives at most this multiple of its own size
ROUNDS = 8  # times that the last pass may skip a document and go on in the order
LEAVE_WORDS = 1024  # missing words that are left to the choice among the documents around the end


@dataclass
class Source:
    name: str | None
    words: int
    rows: int
    target: float = 0.0


def targets(sources: list[Source], weights: list[float], share: float = 1.0, cap: float = SOURCE_CAP) -> None:
    """Set each source's target: its weight's part of `share` of all words, at most `cap` times its own words.

    What a capped source cannot take is shared among the others by weight, again and again until none is above.
    """
    budget = share * sum(s.words for s in sources)
    open_, left = list(range(len(sources))), budget
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > cap * sources[i].words]
        if not above:
            for i in open_:
                sources[i].target = left * weights[i] / total
            return
        for i in above:
            sources[i].target = cap * sources[i].words
            left -= sources[i].target
        open_ = [i for i in open_ if i not in set(above)]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per shard and source (shards x sources): the splitting tree."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def descend(first: int, last: int, quota: np.ndarray) -> None:
        if last - first == 1:
            out[first] = quota
            return
        middle = (first + last) // 2
        total = int(quota.sum())
        left_total = total * (middle - first) // (last - first)
        draw = np.random.default_rng([seed, first, last])
        left, rest, wanted = np.zeros_like(quota), total, left_total
        for i, n in enumerate(quota):  # one source after the other: a multivariate-hypergeometric draw
            n = int(n)
            left[i] = draw.hypergeometric(n, rest - n, wanted) if 0 < wanted and n else 0
            wanted -= int(left[i])
            rest -= n
        descend(first, middle, left)
        descend(middle, last, quota - left)

    if len(quotas):
        descend(0, shards, quotas.astype(np.int64))
    return out


def mix(
    docs: DataFrame,
    share: float = 1.0,
    weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    shards: int = 16,
    block_words: int = 50_000,
    seed: int = 11,
    row_name: str | None = None,
) -> DataFrame:
    """One row per document row: row_id, doc_id, source, size, source_size, target, draws.

    draws: array of (pass, shard, place), one entry for each time the mix takes the document; place is its random
    position in the shard's local order. size: words of the text, 0 for null and empty ones, which are drawn like any
    other document. Sources are weighed in turn by `weight_cycle` in code point order, the null source last. Repeated
    rows are documents of their own. row_id names the row of the table (`row_name`: a column that holds such names
    already); equal results on each run follow from the fixed seed. An empty table gives no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    if row_name is None:
        docs, row_name = with_row_names(docs.select("doc_id", "source", "text"), "row_id"), "row_id"
    rows = docs.select(
        F.col(row_name).alias("row_id"),
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        # Rows without ids, or with one id, have places of their own too.
        F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("text"), F.col(row_name)).alias("_order"),
    )
    rows = stage(rows, "mix-sizes")

    sources = [
        Source(r["source"], int(r["words"]), int(r["n"]))
        for r in rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    ]
    sources.sort(key=lambda s: (s.name is None, (s.name or "").encode()))
    targets(sources, [weight_cycle[i % len(weight_cycle)] for i in range(len(sources))], share)

    plan = []
    for i, s in enumerate(sources):
        blocks = max(1, math.ceil(s.words / block_words))
        full = int(s.target // s.words) if s.words else 0
        rest = s.target - full * s.words
        plan.append((i, s.name, s.words, float(s.target), blocks, full, float(rest), pieces_of(s.rows)))
    table = spark.createDataFrame(
        plan,
        "s int, name string, source_size long, target double, blocks long, full int, rest double, buckets long",
    )

    # Running words in the random order.
    known = rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name")
    known = known.withColumn(
        "_bucket", F.expr("bigint(least(buckets - 1, floor((_order / 18446744073709551616D + 0.5D) * buckets)))")
    )
    placed = running_words(known, "_end", ["_order", "doc_id", "size", "row_id"])
    middle = F.col("_end") - F.col("size") / 2
    placed = placed.withColumn("block", F.least(F.col("blocks") - 1, F.floor(middle / block_words).cast("long")))
    placed = stage(placed, "mix-placed")

    # The documents of the last pass, and from them the blocks that it meets.
    placed = last_pass(placed)
    met = {r["s"]: r["last"] + 1 for r in placed.where("_last").groupBy("s").agg(F.max("block").alias("last")).collect()}
    quotas = [full * blocks + met.get(i, 0) for i, _, _, _, blocks, full, _, _ in plan]
    per_shard = split_quotas(np.array(quotas, dtype=np.int64), shards, seed)

    # Where a shard's stretch of a source's permuted blocks begins, and how the permutation is undone.
    begins = np.cumsum(per_shard, axis=0) - per_shard
    stretches, draw = [], np.random.default_rng([seed, 1])
    for i, n in enumerate(quotas):
        step, shift = coprime(n, draw), int(draw.integers(max(n, 1)))
        for p in range(shards):
            if per_shard[p, i]:
                stretches.append((i, p, int(begins[p, i]), int(per_shard[p, i]), int(n), step, shift, plan[i][4]))
    units = (
        spark.createDataFrame(
            stretches, "s int, shard int, begin long, n long, quota long, step long, shift long, blocks long"
        )
        .withColumn("k", F.explode(F.expr("sequence(begin, begin + n - 1)")))
        .withColumn("unit", F.expr("(k * step + shift) % quota"))
        .select("s", F.expr("unit % blocks").alias("block"), F.expr("int(unit div blocks)").alias("pass"), "shard")
        .groupBy("s", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("units"))
    )

    taken = F.filter(F.col("units"), lambda u: (u["pass"] < F.col("full")) | F.col("_last"))
    draws = F.transform(
        taken,
        lambda u: F.struct(
            u["pass"].alias("pass"),
            u["shard"].alias("shard"),
            F.xxhash64(F.lit(seed), u["shard"], u["pass"], F.col("_order"), F.col("row_id")).alias("place"),
        ),
    )
    none = F.array().cast("array<struct<pass:int,shard:int,place:bigint>>")
    return placed.join(units, ["s", "block"], "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce(draws, none).alias("draws")
    )


def running_words(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """`rows` with the running sum of `size` within each `s`: sums per bucket of the order, then inside the bucket."""
    sums = rows.groupBy("s", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("s", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, ["s", "_bucket"]).withColumn(name, F.col("_before") + F.sum("size").over(inside)).drop("_before")


def last_pass(placed: DataFrame) -> DataFrame:
    """`placed` with `_last`: whether the document belongs to the last, partial pass over its source.

    In the order, documents are taken as long as their running words stay within the words missing. One that does not
    fit is skipped, and the following ones that are small enough are taken in the same way, for some rounds. If much is
    missing still, a skipped document is taken first and the others after it. What is missing then is settled among the
    documents of the buckets around the place reached, of whatever size. The driver holds a few stretches of the order
    for each source.
    """
    spark = placed.sparkSession
    rests = placed.where("rest > 0").groupBy("s").agg(F.first("rest").alias("rest")).collect()
    state = walk(placed, [(r["s"], r["rest"], -1) for r in rests])
    first = []
    for r in rests:
        _, left, _, skipped = state[r["s"]]
        fits = [x for x in skipped if x["size"] <= r["rest"]]
        if left > LEAVE_WORDS and fits:
            first.append((r["s"], r["rest"] - fits[0]["size"], fits[0]["_end"]))
    if first:
        for (s, _, end), found in zip(first, walk(placed, first).values()):
            if found[1] < state[s][1]:
                state[s] = ([*found[0], (end - 1, end, 2**62)], *found[1:])

    reached = spark.createDataFrame(
        [(s, spans, float(left), bucket) for s, (spans, left, bucket, _) in state.items()],
        "s int, spans array<struct<low:long,high:long,most:long>>, left double, reached long",
    )
    placed = placed.join(F.broadcast(reached), "s", "left")
    taken = F.exists(
        "spans", lambda x: (F.col("_end") > x["low"]) & (F.col("_end") <= x["high"]) & (F.col("size") <= x["most"])
    )
    placed = placed.withColumn("_taken", F.coalesce(taken, F.lit(False)))
    near = placed.where("size > 0 and abs(_bucket - reached) <= 1").select("s", "row_id", "_order", "size", "left", "_taken")
    settled = stage(near.groupBy("s").applyInPandas(fill_up, "row_id long, _settled boolean"), "mix-settled")
    placed = placed.join(settled, "row_id", "left").withColumn("_last", F.coalesce("_settled", "_taken"))
    return placed.drop("spans", "left", "reached", "_taken", "_settled")


def walk(placed: DataFrame, wanted: list[tuple[int, float, int]]) -> dict[int, tuple]:
    """Stretches of the order to take, words still missing, bucket reached and documents skipped of each source.

    wanted: source, words to take, and the `_end` of a document that is left out. A stretch is what ends after `low` up
    to `high` and has at most `most` words.
    """
    spark = placed.sparkSession
    out = {s: ([], float(rest), 0, []) for s, rest, _ in wanted}
    step = [(s, float(rest), except_, -1) for s, rest, except_ in wanted]
    for round_ in range(ROUNDS + 1):
        now = F.broadcast(spark.createDataFrame(step, "s int, left double, except long, after long"))
        ends = placed.select("s", "_bucket", "buckets", "size", "_end").join(now, "s")
        ends = ends.where("size > 0 and _end > after and _end <> except")
        if round_ == 0:
            ends = ends.withColumn("_run", F.col("_end"))
        else:
            ends = running_words(ends.where("size <= left"), "_run", ["_end"])
        within = F.col("_run") <= F.col("left")
        found = ends.groupBy("s", "left", "except", "after", "buckets").agg(
            F.max(F.when(within, F.col("_run"))).alias("got"),
            F.min(F.when(~within, F.struct("_end", "size", "_bucket"))).alias("skipped"),
        )
        step = []
        for r in found.collect():
            spans, _, _, skipped = out[r["s"]]
            gap, left = r["skipped"], r["left"] - (r["got"] or 0)
            spans.append((r["after"], gap["_end"] - 1 if gap else 2**62, math.floor(r["left"]) if round_ else 2**62))
            if gap:
                skipped.append(gap)
                if left > LEAVE_WORDS:
                    step.append((r["s"], left, r["except"], gap["_end"]))
            out[r["s"]] = (spans, left, gap["_bucket"] if gap else r["buckets"] - 1, skipped)
        if not step:
            break
    return out


def fill_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """More of the given documents, in their random order, that still fit; then exchanges that come nearer.

    An exchange takes out one chosen document or none and puts in one other or none, whichever leaves least over.
    """
    pdf = pdf.sort_values(["_order", "row_id"])
    sizes = pdf["size"].to_numpy(np.float64)
    left = float(pdf["left"].iloc[0])
    chosen = pdf["_taken"].to_numpy(dtype=bool).copy()
    for i in np.flatnonzero(~chosen):
        if sizes[i] <= left:
            chosen[i] = True
            left -= sizes[i]
    while True:
        # Index -1 with size 0 stands for no document.
        out = np.concatenate([[-1], np.flatnonzero(chosen)])
        put = np.concatenate([[-1], np.flatnonzero(~chosen)])
        put = put[np.argsort(np.where(put < 0, 0, sizes[put]), kind="stable")]
        put_sizes = np.where(put < 0, 0, sizes[put])
        wanted = left + np.where(out < 0, 0, sizes[out])
        near = np.searchsorted(put_sizes, wanted)
        near = np.stack([np.clip(near - 1, 0, len(put) - 1), np.clip(near, 0, len(put) - 1)])
        over = wanted - put_sizes[near]
        side, at = np.unravel_index(np.argmin(np.abs(over)), over.shape)
        if abs(over[side, at]) >= abs(left):
            break
        left = float(over[side, at])
        for i, now in ((out[at], False), (put[near[side, at]], True)):
            if i >= 0:
                chosen[i] = now
    return pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "_settled": chosen})


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: the documents' own columns, one row for each time a document is taken."""
    row_id = free_name(docs, "_mix_row")
    numbered = with_row_names(docs, row_id)
    chosen = mix(numbered, row_name=row_id, **options).where(F.size("draws") > 0)
    chosen = chosen.select(F.col("row_id").alias(row_id), F.explode("draws").alias("_draw"))
    mixed = numbered.join(chosen, row_id)
    mixed = mixed.repartitionByRange(F.col("_draw.shard"), F.col("_draw.place"))
    mixed = mixed.sortWithinPartitions(F.col("_draw.shard"), F.col("_draw.place"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces_of(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def coprime(n: int, draw: np.random.Generator) -> int:
    """A random step that visits all n places once."""
    if n < 3:
        return 1
    while True:
        step = int(draw.integers(1, n))
        if math.gcd(step, n) == 1:
            return step

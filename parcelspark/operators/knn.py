"""Exact k-nearest-neighbour join.

Vectors are grouped into cells around sampled pivots, which form two levels, and packed into blocks of bounded size. A
block compared with itself bounds the distance of each query's k-th neighbour, and the triangle inequality rules out
the cells beyond that bound, so the result is exact and distant cells are never compared. What is routed are numbers of
cells, not vectors: query blocks form groups that fit into a task, and every group has the open blocks streamed past
it once. The bytes shuffled are those of the corpus times the number of groups, whatever the vectors look like. Copies
of one vector are compared once and expanded afterwards, since only the k + 1 smallest ids among copies can be
anybody's neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.session import lookup_join, parallelism, stage

EARTH_RADIUS_KM = 6371.0
MAX_PIVOT_BYTES = 64 * 1024 * 1024
MAX_BLOCK_BYTES = 4 * 1024 * 1024
HELD_BYTES = 128 * 1024 * 1024  # query vectors of one task
GROWN_ROWS = 512  # rows up to which blocks grow with the table
TASK_PRODUCTS = 2**33  # multiplications that are worth a task of their own


class CosineMetric:
    """Rows are unit vectors; the distance is one minus the inner product, compared at 9 dp."""

    digits = 9

    @staticmethod
    def slack(kth: np.ndarray) -> float:
        """How far below the k-th inner product an equal rounded distance may lie."""
        return 2e-9

    @staticmethod
    def embed(rows: np.ndarray) -> np.ndarray:
        return rows

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return 1.0 - inner

    @staticmethod
    def chord(distance: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 * np.maximum(distance, 0.0))


class HaversineMetric:
    """Rows are (lat, lon) in degrees; the distance is in kilometres, compared at 6 dp."""

    digits = 6

    @staticmethod
    def slack(kth: np.ndarray) -> np.ndarray:
        """As above: a rounding step along the arc, and the error of the inner product itself."""
        return np.sqrt(np.maximum(2.0 * (1.0 - kth), 0.0)) * 1e-9 + 4e-15

    @staticmethod
    def embed(rows: np.ndarray) -> np.ndarray:
        lat, lon = np.radians(rows[:, 0]), np.radians(rows[:, 1])
        return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray, inner: np.ndarray) -> np.ndarray:
        lat_a, lat_b = np.radians(a[:, 0]), np.radians(b[:, 0])
        half_lat, half_lon = np.radians(b[:, 0] - a[:, 0]) / 2, np.radians(b[:, 1] - a[:, 1]) / 2
        h = np.sin(half_lat) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin(half_lon) ** 2
        h = np.clip(h, 0.0, 1.0)
        return EARTH_RADIUS_KM * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    @staticmethod
    def chord(distance: np.ndarray) -> np.ndarray:
        return 2.0 * np.sin(np.minimum(distance / EARTH_RADIUS_KM, np.pi) / 2)


@dataclass(frozen=True)
class KnnPlan:
    """Sizes of the join; they change its cost, never its result.

    Up to `one_cell_rows` vectors are compared without cells. Beyond, there is a pivot per two blocks of
    rows, up to `max_cells` pivots. Small blocks grow with the square root of the table (see `grown_block`).
    """

    one_cell_rows: int = 20_000
    block_rows: int = 512
    max_cells: int = 200_000


def grown_block(block_rows: int, total: int) -> int:
    """Rows of a block: what the plan says, but of a large table at least the root of its rows, up to GROWN_ROWS.

    Vectors without structure leave all pairs of blocks open. Their number then stays near that of the rows, each is one
    matrix product of some size, and the lists of open cells stay short.
    """
    return max(block_rows, min(GROWN_ROWS, ceil(total**0.5)))


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric=CosineMetric,
    max_distance: float | None = None,
    plan: KnnPlan = KnnPlan(),
) -> DataFrame:
    """The k nearest corpus rows of every query row: (id, neighbor_id, distance, rank).

    `queries` and `corpus` carry `id` and `vec`; every query id is in the corpus. A row is never its
    own neighbour. Order and ties follow the distance at the metric's precision, then the smaller id.
    """
    points = stage(corpus.select("id", "vec", _digest("vec").alias("_copy")), "knn-points")
    sizes = points.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_copy").alias("vectors")).first()
    if sizes["rows"] == sizes["vectors"]:
        asked = None if queries is corpus else queries.select(F.col("id").alias("rep"))
        rows = points.select(F.col("id").alias("rep"), "vec")
        nearest = _nearest_distinct(rows, sizes["rows"], asked, k + 1, metric, max_distance, plan)
        order = Window.partitionBy("query").orderBy("distance", "match")
        return (
            nearest.where(F.col("query") != F.col("match"))
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(F.col("query").alias("id"), F.col("match").alias("neighbor_id"), F.col("exact").alias("distance"), "rank")
        )
    return _with_copies(queries, points, sizes["vectors"], k, metric, max_distance, plan)


def _with_copies(queries, points, n_vectors, k, metric, max_distance, plan) -> DataFrame:
    """Search among distinct vectors, then put the copies back."""
    copies = stage(points.groupBy("_copy").agg(F.min("id").alias("rep")), "knn-copies")
    by_id = Window.partitionBy("_copy").orderBy("id")
    members = (
        points.select("_copy", "id")
        .withColumn("_n", F.row_number().over(by_id))
        .where(F.col("_n") <= k + 1)
        .groupBy("_copy")
        .agg(F.collect_list("id").alias("ids"))
        .select(F.array_min("ids").alias("rep"), "ids")
    )
    distinct = stage(
        points.join(copies.select(F.col("rep").alias("id")), "id", "left_semi").select(
            F.col("id").alias("rep"), "vec"
        ),
        "knn-distinct",
    )
    asked = queries.select("id", _digest("vec").alias("_copy")).join(copies, "_copy").select("id", "rep")
    nearest = _nearest_distinct(
        distinct, n_vectors, asked.select("rep").distinct(), k + 1, metric, max_distance, plan
    )

    best = Window.partitionBy("query").orderBy("distance", "id")
    candidates = (
        nearest.join(members.withColumnRenamed("rep", "match"), "match")
        .select("query", "distance", "exact", F.explode("ids").alias("id"))
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("distance", F.col("id").alias("neighbor_id"), "exact"))).alias("_near"))
    )
    others = F.slice(F.filter("_near", lambda e: e["neighbor_id"] != F.col("id")), 1, k)
    return (
        asked.join(candidates.withColumnRenamed("query", "rep"), "rep")
        .select("id", F.posexplode(others).alias("_pos", "_hit"))
        .select("id", "_hit.neighbor_id", F.col("_hit.exact").alias("distance"), (F.col("_pos") + 1).alias("rank"))
    )


def _digest(vec: str) -> F.Column:
    """A 128-bit key of a vector, so that copies meet without shuffling the vectors."""
    return F.concat(F.hex(F.xxhash64(vec)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), vec)))


def _nearest_distinct(rows, total, asked, keep, metric, max_distance, plan) -> DataFrame:
    """(query, match, distance, exact): the `keep` nearest vectors of every asked vector, itself included.

    `distance` is rounded and decides the order, `exact` is the value to report.

    `rows` is a staged table of `total` distinct vectors; `asked` is None when all of them are queries.
    """
    spark = rows.sparkSession
    id_type = dict(rows.dtypes)["rep"]
    schema = f"query {id_type}, match {id_type}, distance double, exact double"
    if total == 0:
        return spark.createDataFrame([], schema)
    width = rows.select(F.size("vec")).first()[0]
    block_rows = max(1, min(grown_block(plan.block_rows, total), MAX_BLOCK_BYTES // (8 * width)))
    n_asked = total
    if asked is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        n_asked = asked.count()
        rows = rows.join(asked.withColumn("asked", F.lit(True)), "rep", "left")
    if total <= plan.one_cell_rows:
        celled, pivots, cells = rows.withColumn("cell", F.lit(0)), None, {0: (total, 0.0)}
    else:
        pivots = _choose_pivots(rows, total, width, block_rows, metric, plan)
        celled = stage(_assign(rows, pivots, metric), "knn-cells")
        stats = celled.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("pivot_distance").alias("radius")
        )
        # One row per pivot, so at most max_cells rows reach the driver.
        cells = {r["cell"]: (r["n"], r["radius"]) for r in stats.collect()}
        pivots = pivots.with_radius(cells)

    blocks, n_blocks = _blocks(celled, cells, pivots, block_rows)
    asking = stage(_limits(blocks, pivots, keep, metric, max_distance), "knn-queries")
    groups, parts = _grid(n_asked, total, width, n_blocks, parallelism(spark))
    return _meet(blocks, asking, n_blocks, groups, parts, keep, metric, max_distance, schema)


def _grid(asked: int, total: int, width: int, n_blocks: int, tasks: int) -> tuple[int, int]:
    """Groups of query blocks, and parts of the corpus that each group meets in a task of its own.

    A group's vectors fit into HELD_BYTES. Queries travel once per part and the corpus once per group, so beyond that
    the sides of the grid follow the sizes of the two tables.
    """
    least = max(1, ceil(8 * width * asked / HELD_BYTES))
    tasks = max(1, min(tasks, ceil(asked * total * width / TASK_PRODUCTS)))
    groups = min(n_blocks, max(least, round((tasks * asked / total) ** 0.5), 1))
    return groups, max(1, min(n_blocks, ceil(tasks / groups)))


def _blocks(celled, cells, pivots, block_rows) -> tuple[DataFrame, int]:
    """The vectors in blocks of about `block_rows`, numbered so that blocks of neighbouring cells follow each other."""
    order = [0] if pivots is None else [int(c) for group in pivots.groups for c in group if int(c) in cells]
    shape, start = [], 0
    for cell in order:
        n = max(1, ceil(cells[cell][0] / block_rows))
        shape.append((cell, n, start))
        start += n
    sizes = celled.sparkSession.createDataFrame(shape, "cell int, blocks int, start long")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = celled.join(F.broadcast(sizes), "cell").withColumn("number", F.col("start") + block)  # one row per pivot
    packed = F.array_sort(F.collect_list(F.struct("rep", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))))
    return stage(placed.groupBy("cell", "number").agg(packed.alias("rows")), "knn-blocks"), start


class Pivots:
    """Pivot points in two levels: every pivot belongs to the nearest of a few heads.

    A row finds its head first and then a pivot of that head, so its cost grows with the square root
    of the number of pivots.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.heads = points[: max(1, int(np.sqrt(len(points))))]
        owner = _gaps(points, self.heads).argmin(1)
        owner[: len(self.heads)] = np.arange(len(self.heads))
        self.groups = [np.flatnonzero(owner == h) for h in range(len(self.heads))]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot index and distance of each row."""
        head = _gaps(rows, self.heads).argmin(1)
        cell, distance = np.empty(len(rows), dtype=np.int32), np.empty(len(rows))
        for h in np.unique(head):
            here = np.flatnonzero(head == h)
            gaps = _gaps(rows[here], self.points[self.groups[h]])
            best = gaps.argmin(1)
            cell[here], distance[here] = self.groups[h][best], gaps[np.arange(len(here)), best]
        return cell, distance

    def with_radius(self, cells: dict[int, tuple[int, float]]) -> Pivots:
        """Note how far the rows of each pivot and of each head reach; pivots without rows reach nowhere."""
        self.radius = np.full(len(self.points), -np.inf)
        for cell, (_, radius) in cells.items():
            self.radius[cell] = radius
        self.head_radius = np.array(
            [
                (_gaps(self.heads[h : h + 1], self.points[group])[0] + self.radius[group]).max()
                for h, group in enumerate(self.groups)
            ]
        )
        return self

    def within(self, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, pivot) where a row of the pivot may lie within reach of the row."""
        reach = np.minimum(reach, 1e300) + 1e-6
        near_head = _gaps(rows, self.heads) - self.head_radius[None, :] <= reach[:, None]
        found_rows, found_cells = [], []
        for h in np.flatnonzero(near_head.any(0)):
            here, group = np.flatnonzero(near_head[:, h]), self.groups[h]
            r, c = np.nonzero(
                _gaps(rows[here], self.points[group]) - self.radius[group][None, :] <= reach[here][:, None]
            )
            found_rows.append(here[r])
            found_cells.append(group[c])
        if not found_rows:
            return np.empty(0, dtype=int), np.empty(0, dtype=int)
        row, cell = np.concatenate(found_rows), np.concatenate(found_cells)
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


def _choose_pivots(rows, total, width, block_rows, metric, plan) -> Pivots:
    """Pivots are sampled rows, so dense regions get more of them. Their number and bytes are capped."""
    fitting = max(1, MAX_PIVOT_BYTES // (8 * max(3, width)))
    wanted = max(1, min(plan.max_cells, ceil(total / (2 * block_rows)), fitting))
    share = max(1, total // (2 * wanted))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(2), "rep"), F.lit(share)) == 0).select("vec").limit(wanted).collect()
    picked = picked or rows.select("vec").limit(1).collect()
    return Pivots(metric.embed(np.array([r["vec"] for r in picked], dtype=float)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float, copy=False)


def _gaps(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def _assign(rows, pivots, metric) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest_pivot(batches):
        for batch in batches:
            if batch.num_rows:
                cell, distance = shared.value.nearest(metric.embed(_matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell), pa.array(distance)],
                    names=["rep", "vec", "asked", "cell", "pivot_distance"],
                )

    types = dict(rows.dtypes)
    return rows.select("rep", "vec", "asked").mapInArrow(
        nearest_pivot, f"rep {types['rep']}, vec {types['vec']}, asked boolean, cell int, pivot_distance double"
    )


def _limits(blocks, pivots, keep, metric, max_distance) -> DataFrame:
    """The asked rows of every block, an upper limit of each one's `keep`-th distance, and the cells it leaves open.

    The limits come from the rows of the own block. `cells` is null where there are no pivots.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(pivots)

    def own_block(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                chosen = rows.filter(rows.field("asked"))
                if not len(chosen):
                    continue
                queries = Queries(chosen, np.full(len(chosen), np.inf), keep, metric, max_distance)
                queries.meet(rows)
                queries.prune()
                cells = None
                if shared.value is not None:
                    known = np.isfinite(queries.limit)
                    reach = np.where(known, metric.chord(np.where(known, queries.limit, 0.0)), np.inf)
                    if max_distance is not None:
                        reach = np.minimum(reach, metric.chord(np.array([max_distance]))[0])
                    cells = np.unique(shared.value.within(queries.embedded, reach)[1]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("number").slice(i, 1),
                        _listed(chosen),
                        pa.array([queries.limit.tolist()], pa.list_(pa.float64())),
                        pa.array([cells], pa.list_(pa.int32())),
                    ],
                    names=["number", "rows", "limits", "cells"],
                )

    types = dict(blocks.dtypes)
    return blocks.select("number", "rows").mapInArrow(
        own_block, f"number long, rows {types['rows']}, limits array<double>, cells array<int>"
    )


def _listed(rows: pa.StructArray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


class Queries:
    """The queries of one block with the best matches found so far."""

    def __init__(self, rows: pa.StructArray, limit: np.ndarray, keep: int, metric, max_distance: float | None) -> None:
        self.ids, self.plain = rows.field("rep"), _matrix(rows.field("vec"))
        self.embedded = metric.embed(self.plain)
        self.keep, self.metric, self.max_distance = keep, metric, max_distance
        self.limit, self.found, self.waiting = limit, [], 0

    def meet(self, rows: pa.StructArray) -> None:
        """Compare with a block of the corpus; what lies beyond a query's limit is never written down."""
        metric, plain = self.metric, _matrix(rows.field("vec"))
        inner = self.embedded @ metric.embed(plain).T
        known = np.isfinite(self.limit)
        floor = np.where(known, 1.0 - metric.chord(np.where(known, self.limit, 0.0)) ** 2 / 2.0, -2.0)
        near = inner >= (floor - metric.slack(floor))[:, None]
        if inner.shape[1] > self.keep and near.sum() > 2 * self.keep * len(inner):
            kth = -np.partition(-inner, self.keep - 1, axis=1)[:, self.keep - 1]
            near &= inner >= (kth - metric.slack(kth))[:, None]
        q, c = np.nonzero(near)
        exact = metric.distance(self.plain[q], plain[c], inner[q, c])
        distance = np.round(exact, metric.digits)
        good = distance <= self.limit[q]
        if self.max_distance is not None:
            good &= exact <= self.max_distance
        if good.any():
            q, c = q[good], c[good]
            matches = rows.field("rep").take(pa.array(c))
            self.found.append(
                pa.table({"q": pa.array(q), "distance": pa.array(distance[good]), "match": matches, "exact": pa.array(exact[good])})
            )
            self.waiting += len(q)
            if self.waiting > 8 * self.keep * len(self.limit):
                self.prune()

    def prune(self) -> None:
        """Keep the best matches of each query; ties go to the smaller id."""
        if not self.found:
            return
        met = pa.concat_tables(self.found)
        met = met.take(pc.sort_indices(met, sort_keys=[("q", "ascending"), ("distance", "ascending"), ("match", "ascending")]))
        q = met.column("q").to_numpy()
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.keep
        met = met.filter(pa.array(first))
        q, distance = q[first], met.column("distance").to_numpy()
        full = np.bincount(q, minlength=len(self.limit)) >= self.keep
        worst = np.full(len(self.limit), -np.inf)
        np.maximum.at(worst, q, distance)
        self.limit = np.where(full, np.minimum(self.limit, worst), self.limit)
        self.found, self.waiting = [met], 0

    def results(self) -> pa.RecordBatch | None:
        self.prune()
        if not self.found:
            return None
        met = self.found[0].combine_chunks()
        columns = [self.ids.take(met.column("q").chunk(0)), *(met.column(n).chunk(0) for n in ("match", "distance", "exact"))]
        return pa.RecordBatch.from_arrays(columns, names=["query", "match", "distance", "exact"]) if len(met) else None


def _meet(blocks, asking, n_blocks, groups, parts, keep, metric, max_distance, schema) -> DataFrame:
    """Every group of query blocks meets the blocks of the cells that any of its queries leaves open.

    Only numbers of cells and groups are routed. A task holds its group's queries and streams the corpus past them, block by
    block, in the order of the shuffle; what it has found so far shortens each query's limit.
    """
    group = F.floor(F.col("number") * groups / n_blocks).cast("int")
    asking = asking.withColumn("group", F.least(group, F.lit(groups - 1)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asking.withColumn("part", spread).select(
        (F.col("group") * parts + F.col("part")).alias("task"), F.lit(0).alias("kind"), F.lit(0).alias("cell"), "number", "rows", "limits", "cells"
    )
    part = F.pmod("number", F.lit(parts)).cast("int")
    if "cell" in blocks.columns and asking.where("cells is not null").take(1):
        routes = asking.select("group", F.explode("cells").alias("cell")).distinct()
        routes = stage(routes.groupBy("cell").agg(F.collect_list("group").alias("groups")), "knn-routes")
        bytes_of = routes.agg(F.sum(F.size("groups") * 4 + 64)).first()[0] or 0
        right = lookup_join(blocks, routes, ["cell"], bytes_of, ["number"], how="inner")
        right = right.withColumn("group", F.explode("groups"))
    else:
        right = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.select(
        (F.col("group") * parts + part).alias("task"), F.lit(1).alias("kind"), "cell", "number", "rows",
        F.lit(None).cast("array<double>").alias("limits"), F.lit(None).cast("array<int>").alias("cells"),
    )
    dealt = left.unionByName(right).repartitionById(groups * parts, "task").sortWithinPartitions("task", "kind", "number")

    def stream(batches):
        held: list[Queries] = []
        by_cell: dict[int, list[Queries]] = {}
        everywhere: list[Queries] = []
        now = None
        for batch in batches:
            task, kind, cell = (batch.column(n).to_numpy() for n in ("task", "kind", "cell"))
            for i in range(batch.num_rows):
                if task[i] != now:
                    yield from filter(None, (q.results() for q in held))
                    held, by_cell, everywhere, now = [], {}, [], task[i]
                rows = batch.column("rows")[i].values
                if kind[i] == 0:
                    limits = np.array(batch.column("limits")[i].as_py(), dtype=float)
                    queries = Queries(rows, limits, keep, metric, max_distance)
                    held.append(queries)
                    open_cells = batch.column("cells")[i].as_py()
                    for c in open_cells or ():
                        by_cell.setdefault(c, []).append(queries)
                    if open_cells is None:
                        everywhere.append(queries)
                else:
                    for queries in (*everywhere, *by_cell.get(int(cell[i]), ())):
                        queries.meet(rows)
        yield from filter(None, (q.results() for q in held))

    found = dealt.mapInArrow(stream, schema)
    if parts == 1:
        return found
    order = Window.partitionBy("query").orderBy("distance", "match")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")

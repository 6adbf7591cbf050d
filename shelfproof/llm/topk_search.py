"""Exact top-k inner products as a Voronoi kNN join.

Vectors get one more component that brings data to one common length and is 0 in
queries; then the largest inner product is the smallest distance (for vector
lengths up to M: ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``).  Pivots from a bounded
sample divide the space into cells.  Summaries of the cells (how far the queries
of a cell lie from its pivot; the k smallest distances of each cell's data) bound
how far any query's k-th neighbour can be, and only data that a group of query
cells can need by the triangle inequality is sent to it.  A group holds a bounded
number of queries, its data is dealt into bounded blocks, and each (group, block)
is solved by matrix products; a query's best of each block are merged at the end.

Neither a crowded cell nor a vector that a third of the rows repeat makes a large
task: cells with many queries are split, and data is dealt by row, not by cell.
Components are whole numbers, so scores are exact; bounds are widened by a margin
for rounding before they exclude anything.

Vectors that are NULL or hold NULL or non-finite components take no part, shorter
vectors are taken as padded with 0.  Ties go to the smaller id.  Rows that repeat
an id count once (the better score), and a query is never its own neighbour.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm.common import stored

PIVOTS = 64
#: Queries of a group, and rows of a block of data.
GROUP, BLOCK = 1024, 8192
#: Share of the largest distance by which bounds are widened.
MARGIN = 1e-6


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; NULL for a vector that takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of one length, shorter ones padded with 0."""
    ends = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), dtype=np.float64)
    rows = np.repeat(np.arange(len(lists)), ends)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(ends) - ends, ends)
    out[rows, cols] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.concatenate([x, extra[:, None]], axis=1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(pivots: np.ndarray, most: float):
    """Adds each row's cell and distance, as data and, where it is a query, as query."""
    dims = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), dims)
            far = _distances(x, np.sqrt(np.maximum(most - (x**2).sum(1), 0)), pivots)
            near = _distances(x, np.zeros(len(x)), pivots)
            cell, q = far.argmin(1).astype(np.int32), near.argmin(1).astype(np.int32)
            rows = np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("query"), b.column("vec"), pa.array(cell), pa.array(far[rows, cell]),
                 pa.array(q), pa.array(near[rows, q])],
                names=["id", "query", "vec", "cell", "dist", "q_cell", "q_dist"])

    return run


def _needed(pivots: np.ndarray, most: float, groups: list[tuple[int, list[int]]], radius: dict[int, float],
            reach: dict[int, float]):
    """Repeats each data row for the groups that can need it: any of a group's cells within reach."""
    dims = pivots.shape[1] - 1
    cells = sorted(radius)
    bound = np.array([radius[c] + reach[c] for c in cells])
    member = np.zeros((len(cells), len(groups)), dtype=bool)
    for g, (_, held) in enumerate(groups):
        member[[cells.index(c) for c in held], g] = True
    number = np.array([g for g, _ in groups], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), dims)
            far = _distances(x, np.sqrt(np.maximum(most - (x**2).sum(1), 0)), pivots[cells])
            rows, at = np.nonzero((far <= bound) @ member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[at]), b.column("id").take(pa.array(rows)), b.column("vec").take(pa.array(rows))],
                names=["grp", "id", "vec"])

    return run


def _solve(k: int, dims: int):
    """The best k of a block for each query of a group."""

    def run(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        qid = queries.column("id").to_numpy()
        ids = data.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        q, x = (_matrix(t.column("vec").combine_chunks(), dims) for t in (queries, data))
        x = x[order]
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims < 2**53
        if not exact:
            q, x = q.astype(np.int64), x.astype(np.int64)
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, dtype=int)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(qid), 128):
            score = q[a:a + 128] @ x.T
            if len(first) < len(ids):  # rows of one id count once
                score = np.maximum.reduceat(score, first, axis=1)
            names = ids[first]
            low = np.finfo(np.float64).min if exact else np.iinfo(np.int64).min
            mine = np.searchsorted(names, qid[a:a + 128])
            own = (mine < len(names)) & (names[np.minimum(mine, len(names) - 1)] == qid[a:a + 128])
            score[np.flatnonzero(own), mine[own]] = low
            kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), low)
            for i, row in enumerate(score):
                at = np.flatnonzero((row >= kth[i]) & (row > low))
                at = at[np.argsort(-row[at], kind="stable")[:k]]
                out.append((np.full(len(at), qid[a + i]), names[at], row[at].astype(np.int64)))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})

    return run


def _grouped(counts: dict[int, int], pivots: np.ndarray, group: int) -> tuple[list[tuple[int, list[int]]], dict]:
    """Groups of query cells, next to each other where possible, and each cell's first group and number of groups."""
    groups: list[tuple[int, list[int]]] = []
    place: dict[int, tuple[int, int]] = {}
    left, here, held = set(counts), [], 0
    at = max(counts, key=lambda c: (counts[c], -c), default=None)
    while left:
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at])**2).sum()), c))
        left.discard(at)
        parts = -(-counts[at] // group)
        if parts > 1:
            place[at] = (len(groups), parts)
            groups += [(len(groups) + i, [at]) for i in range(parts)]
            continue
        if held + counts[at] > group and here:
            groups.append((len(groups), here))
            here, held = [], 0
        here.append(at)
        held += counts[at]
        place[at] = (-1, 1)
    if here:
        groups.append((len(groups), here))
    for g, cells in groups:
        for c in cells:
            if place[c][0] < 0:
                place[c] = (g, 1)
    return groups, place


def top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: each query's k best of all other rows."""
    spark = vectors.sparkSession
    whole = (vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                            quantised(F.col(vec_col), scale).alias("vec"))
             .where(F.col("vec").isNotNull() & F.col("id").isNotNull()))
    whole = stored(whole, "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most, dims = whole.agg(F.count("id"), F.max(norm), F.max(F.size("vec"))).first()
    sample = [r[0] for r in whole.groupBy("vec").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id")
              .limit(pivots).select("vec").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, 1)
    points = np.zeros((len(sample), dims + 1))
    for i, v in enumerate(sample):
        points[i, :len(v)] = v
    points[:, dims] = np.sqrt(np.maximum(most - (points**2).sum(1), 0))
    placed = stored(whole.mapInArrow(_assign(points, most), "id long, query boolean, vec array<long>, cell int, "
                                     "dist double, q_cell int, q_dist double"), "cells")
    # Summaries: radius of each query cell, the k + 1 nearest distances of each data cell (one may be the query's own).
    q_cells = {r[0]: (r[1], r[2]) for r in placed.where("query").groupBy("q_cell")
               .agg(F.count("id"), F.max("q_dist")).collect()}
    ranked = Window.partitionBy("cell").orderBy("dist")
    heads = (placed.groupBy("cell", "id").agg(F.max("dist").alias("dist"))
             .withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).select("cell", "dist").collect())
    between = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(2))
    slack = MARGIN * (float(between.max()) + float(np.sqrt(most)) + 1)
    radius = {c: r + slack for c, (_, r) in q_cells.items()}
    reach = {}
    for c, r in radius.items():
        near = sorted(r + between[c, j] + d for j, d in heads)
        reach[c] = near[k] + slack if len(near) > k else float("inf")
    groups, place = _grouped({c: m for c, (m, _) in q_cells.items()}, points, group)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-n // block)
    data = placed.mapInArrow(_needed(points, most, groups, radius, reach), "grp int, id long, vec array<long>")
    data = data.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    where = F.create_map(*[F.lit(x) for c, (g, p) in place.items() for x in (c, g * 1000000 + p)])
    spot = where[F.col("q_cell")]
    queries = (placed.where("query")
               .withColumn("grp", (F.floor(spot / 1000000) + F.pmod(F.xxhash64("id", F.lit(1)), spot % 1000000)).cast("int"))
               .select("grp", "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    best = queries.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInArrow(
        _solve(k, dims), "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

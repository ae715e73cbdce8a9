"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots are a fixed number of data vectors. Every vector belongs to the cell of its nearest pivot; a cell's summary is its pivot and
radius. A query's products with the pivots, which are data, bound its k-th best score from below; the product with a cell's pivot plus
the query's length times the radius bounds every score in the cell from above. Queries are grouped by their pivots, a group's
needed cells are the union of its queries', and only the vectors of these cells are copied to the group, in slices of bounded
size. Each slice is solved locally, and the best of a query's slices are its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdlake.session import stored

PIVOTS = 256  # data vectors that cells are drawn around, at most
GROUP = 512  # queries of a group, about
SLICE = 20_000  # data vectors of a group that one task solves, about


def quantised(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): floor(256 * x) of each component x as double; vectors that are null, empty or not finite, and rows without id, are left out."""
    x = F.col(vector).cast("array<double>")
    # for null elements the first condition is null, which counts as not true
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, pivots = a.astype(np.float64), pivots.astype(np.float64)
    squares = (a**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * a @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, group: int = GROUP, slice_: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows, ties to the smaller id.

    Vectors must have one length; those of another than most are left out with a query's own id. Rows that repeat an id are candidates each,
    and a repeated query is asked once.
    """
    spark = vectors.sparkSession
    data = quantised(vectors, id_col, vector)
    length = data.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    data = data.where(F.size("v") == length["n"])
    asked = quantised(queries, id_col, vector).where(F.size("v") == length["n"]).dropDuplicates(["id"])
    chosen = data.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).toPandas()  # bounded by ``pivots``
    pivot_ids, pivot = chosen["id"].to_numpy(np.int64), np.stack([np.array(v, np.int64) for v in chosen["v"]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_matrix(batch.column("v")), pivot)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "v", "cell", "far"])

    kinds = "id bigint, v array<bigint>, cell int, far double"
    placed = stored(data.mapInArrow(assign, kinds), "knn-data")
    wanted = stored(asked.mapInArrow(assign, kinds), "knn-queries")
    summary = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).toPandas()  # a row per pivot at most
    radius, size = np.full(len(pivot), -np.inf), np.zeros(len(pivot), np.int64)
    radius[summary["cell"]], size[summary["cell"]] = summary["radius"] * (1 + 1e-9) + 1e-6, summary["n"]
    # neighbouring cells share a group until it has about ``group`` queries
    load = dict(wanted.groupBy("cell").count().toPandas().itertuples(index=False))
    group_of, number, held, at = np.zeros(len(pivot), np.int32), 0, 0, 0
    left = set(range(len(pivot)))
    while left:
        if held >= group:
            number, held = number + 1, 0
        group_of[at] = number
        held += load.get(at, 0)
        left.discard(at)
        if left:
            rest = np.array(sorted(left))
            at = int(rest[_distances(pivot[at : at + 1], pivot[rest])[0].argmin()])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
            scores = _products(q, pivot).astype(np.float64)
            own = np.where(ids[:, None] == pivot_ids, -np.inf, scores)
            least = np.sort(own, 1)[:, -k] if len(pivot) >= k else np.full(len(q), -np.inf)
            above = scores + np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * np.where(np.isfinite(radius), radius, 0) * (1 + 1e-9) + 1e-3
            query, cell = np.nonzero((above >= least[:, None]) & (size > 0))
            pairs = np.unique(np.stack([group_of[batch.column("cell").to_numpy()][query], cell], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], ["group", "cell"])

    needed = stored(wanted.mapInArrow(needs, "group int, cell int").distinct(), "knn-needed")  # at most groups x pivots rows
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(size.tolist())], "cell int, n bigint")
    slices = needed.join(sizes, "cell").groupBy("group").agg(F.ceil(F.sum("n") / slice_).cast("int").alias("slices"))
    copies = placed.select("id", "v", "cell").join(F.broadcast(needed.join(slices, "group")), "cell").select(  # at most pivots ** 2 slim rows
        "group", F.pmod(F.xxhash64("id", "v"), F.col("slices")).cast("int").alias("slice"), "id", "v"
    )
    groups = F.element_at(F.lit([int(g) for g in group_of]), F.col("cell") + 1)
    sent = wanted.select("id", "v", groups.alias("group")).join(F.broadcast(slices), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, q_ids, x, x_ids = _matrix(left.column("v")), left.column("id").to_numpy(), _matrix(right.column("v")), right.column("id").to_numpy()
        out = [np.zeros((0, 3), np.int64)]
        if len(x):
            order = np.argsort(x_ids, kind="stable")
            x, x_ids = x[order], x_ids[order]
            for start in range(0, len(q), 64):
                scores = _products(q[start : start + 64], x)
                for row, own in enumerate(scores):
                    query = q_ids[start + row]
                    other = np.flatnonzero(x_ids != query)
                    best = own[other]
                    if len(best) > k:
                        cut = np.partition(best, len(best) - k)[len(best) - k]
                        high, tied = other[best > cut], other[best == cut]
                        other = np.concatenate([high, tied[: k - len(high)]])  # ids ascend
                    out.append(np.stack([np.full(len(other), query), x_ids[other], own[other]], axis=1))
        found = np.concatenate(out)
        return pa.table({"query_id": found[:, 0], "vec_id": found[:, 1], "score": found[:, 2]})

    local = sent.groupBy("group", "slice").cogroup(copies.groupBy("group", "slice")).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

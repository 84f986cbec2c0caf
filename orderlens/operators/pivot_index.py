"""Exact nearest vectors over a pivot table, pruned by the triangle inequality.

Every vector belongs to the cell of its nearest pivot and is stored with its distance to it,
sorted by cell and distance.  A cell is a ball with a hole: all its vectors lie between a
smallest and a largest distance from the pivot.  A vector at distance r from a pivot that is
d away from a query cannot be nearer to the query than |d - r|.  A search first reads, for
each query, the nearest cells that hold k vectors; their k-th distance closes all cells, and
inside the others all vectors, that cannot be nearer.  Closed cells are not read: the filter
on the cell reaches the Parquet scan.

Pivots are bounded in number, whatever the size of the corpus; queries come in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import staged

#: Numbers in all pivots together, and pivots, at most.
PIVOT_FLOATS, PIVOTS = 1 << 21, 2048
#: Query numbers that go to the tasks at once: 4,096 vectors of 1,024 floats are 32 MB.
QUERY_FLOATS = 4_096 * 1_024
#: Relative room for rounding in bounds.
SLACK = 1e-9


@dataclass
class PivotIndex:
    """``vectors`` (cell, r, id, vector) as stored, and what the cells look like."""

    vectors: DataFrame
    centers: np.ndarray
    nearest: np.ndarray  # smallest and largest distance to the pivot by cell, and vectors in it
    farthest: np.ndarray
    sizes: np.ndarray

    @property
    def width(self) -> int:
        return self.centers.shape[1]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices by one product, for bounds."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances, by differences: equal vectors have equal ones."""
    gap = vectors - query
    return np.einsum("ij,ij->i", gap, gap)


def build(corpus: DataFrame, pivots: int | None = None) -> PivotIndex:
    """The index of a corpus (id, vector); vectors of another length than most, or none, are refused."""
    spark = corpus.sparkSession
    shape = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("wide"), F.min(
        F.coalesce(F.size("vector"), F.lit(-1))).alias("narrow")).first()
    if not shape["n"]:
        none = np.empty(0)
        return PivotIndex(corpus.selectExpr("0 AS cell", "0D AS r", "id", "vector"), np.empty((0, 0)), none, none, none)
    if shape["wide"] != shape["narrow"] or shape["wide"] < 1:
        raise ValueError("all vectors of a corpus have one length")
    wanted = pivots or int(np.ceil(np.sqrt(shape["n"])))
    wanted = max(1, min(wanted, PIVOTS, PIVOT_FLOATS // shape["wide"]))
    chosen = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect()
    centers = np.unique(np.array([r["vector"] for r in chosen], dtype=np.float64), axis=0)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        centers = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vectors = matrix(batch.column("vector"))
            cell = distances(vectors, centers).argmin(axis=1)
            r = np.sqrt(np.einsum("ij,ij->i", vectors - centers[cell], vectors - centers[cell]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(r), batch.column("id"), batch.column("vector")],
                names=["cell", "r", "id", "vector"])

    types = {c: corpus.schema[c].dataType.simpleString() for c in ("id", "vector")}
    placed = corpus.select("id", "vector").mapInArrow(
        assign, f"cell int, r double, id {types['id']}, vector {types['vector']}")
    # cells lie together; one that holds a large share of the corpus is split over several files
    vectors = staged(placed.hint("rebalance", "cell").sortWithinPartitions("cell", "r"), "pivot-index")
    cells = vectors.groupBy("cell").agg(
        F.min("r").alias("near"), F.max("r").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # one row a pivot
    near, far, sizes = np.zeros(len(centers)), np.zeros(len(centers)), np.zeros(len(centers), dtype=np.int64)
    for c in cells:
        near[c["cell"]], far[c["cell"]], sizes[c["cell"]] = c["near"], c["far"], c["n"]
    return PivotIndex(vectors, centers, near, far, sizes)


def first_cells(index: PivotIndex, away: np.ndarray, k: int) -> np.ndarray:
    """queries x cells: the nearest cells of each query that together hold k vectors."""
    order = np.argsort(away, axis=1, kind="stable")
    held = np.cumsum(index.sizes[order], axis=1)
    needed = (held - index.sizes[order] < k) & (index.sizes[order] > 0)
    out = np.zeros_like(needed)
    np.put_along_axis(out, order, needed, axis=1)
    return out


def open_cells(index: PivotIndex, away: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """queries x cells: the cells that may hold a vector within ``limit`` of a query."""
    least = np.maximum(away - index.farthest[None, :], index.nearest[None, :] - away)
    return (least <= (limit * (1 + SLACK) + SLACK)[:, None]) & (index.sizes > 0)[None, :]


def _scan(index: PivotIndex, ids: list, points: np.ndarray, away: np.ndarray, wanted: np.ndarray,
          limit: np.ndarray, k: int, schema: str) -> DataFrame:
    """The k nearest in every task per query, among the cells wanted and within the limits."""
    cells = np.flatnonzero(wanted.any(axis=0)).tolist()
    shared = index.vectors.sparkSession.sparkContext.broadcast((points, away, wanted, limit))

    def scan(batches):
        points, away, wanted, limit = shared.value
        limit = limit.copy()
        best: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            vectors, found = matrix(batch.column("vector")), batch.column("id").to_pylist()
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                asking = np.flatnonzero(wanted[:, cell[a]])
                room = limit[asking] * (1 + SLACK) + SLACK
                near = np.abs(away[asking, cell[a]][:, None] - r[None, a:b]) <= room[:, None]
                some = near.any(axis=1)
                if not some.any():
                    continue
                asking, near, room = asking[some], near[some], room[some]
                near &= distances(points[asking], vectors[a:b]) <= room[:, None] * (1 + 1e-6) + 1e-6
                for q, row in zip(asking.tolist(), near):
                    at = np.flatnonzero(row)
                    if not len(at):
                        continue
                    square = exact(vectors[a + at], points[q])
                    if len(at) > k:
                        keep = square <= np.partition(square, k - 1)[k - 1]
                        at, square = at[keep], square[keep]
                    mine = sorted([*best.get(q, []), *zip(square.tolist(), (found[a + i] for i in at))])[:k]
                    best[q] = mine
                    if len(mine) == k:
                        limit[q] = min(limit[q], np.sqrt(mine[-1][0]))
        if best:
            rows = [(q, i, d) for q, mine in best.items() for d, i in mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                 pa.array([r[2] for r in rows], pa.float64())], names=["query", "id", "distance"])

    rows = index.vectors.where(F.col("cell").isin(cells)) if len(cells) < len(index.centers) else index.vectors
    return rows.select("cell", "r", "id", "vector").mapInArrow(scan, schema)


def nearest(queries: DataFrame, index: PivotIndex, k: int, max_floats: int = QUERY_FLOATS) -> tuple[DataFrame, dict]:
    """(query_id, id, distance, rank) of the k nearest vectors by squared distance, ties by id, and
    how many (query, cell) pairs there were and how many were opened."""
    spark = queries.sparkSession
    asked = staged(queries.select("query_id", "vector"), "queries")
    kind = {"id": index.vectors.schema["id"].dataType.simpleString(),
            "query_id": asked.schema["query_id"].dataType.simpleString()}
    schema = f"query int, id {kind['id']}, distance double"
    out = spark.createDataFrame([], f"query_id {kind['query_id']}, id {kind['id']}, distance double")
    told = {"pairs": 0, "opened": 0}
    if not len(index.centers):
        return out.withColumn("rank", F.lit(0)), told
    blocks = max(1, -(-asked.count() * index.width // max_floats))
    best = Window.partitionBy("query").orderBy("distance", "id")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        ids, points = [r["query_id"] for r in block], np.array([r["vector"] for r in block], dtype=np.float64)
        away = distances(points, index.centers)
        first = first_cells(index, away, k)
        far = np.full(len(ids), np.inf)
        start = staged(_scan(index, ids, points, away, first, far, k, schema), "nearest-first")
        last = start.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", "distance")
        for r in last.collect():  # one row a query of the block
            far[r["query"]] = np.sqrt(r["distance"])
        rest = open_cells(index, away, far) & ~first
        told["pairs"] += rest.size
        told["opened"] += int(rest.sum() + first.sum())
        found = start
        if rest.any():
            found = start.unionByName(staged(_scan(index, ids, points, away, rest, far, k, schema), "nearest-rest"))
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {kind['query_id']}")
        out = out.unionByName(found.join(names, "query").select("query_id", "id", "distance"))
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), told

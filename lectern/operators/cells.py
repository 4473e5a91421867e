"""Exact vector search that skips cells by the triangle inequality.

Normalised vectors are stored by cell: that of the nearest of about sqrt(n) centers.
Angles keep the triangle inequality, so no vector of a cell is nearer to a query than
the query's angle to the center less the cell's radius.  A query first looks into its
nearest cells; the k-th best score there is a floor, and of the other cells only those
are read whose bound reaches it.  What is skipped can't be among the best, so results
equal those of a full scan, ties included.

Centers come from a bounded sample (``SAMPLE_BYTES``, a hash of the ids); cells and
radii cover all vectors.  Centers are bounded (``CENTER_BYTES``), and go to all tasks.
A hot cell is several files and row groups like any other rows.  Queries go to all
tasks in blocks, as in ``vectors.vector_search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import vectors

#: Bytes of the centers, and of the vectors that they are learned from, at most.
CENTER_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20
ROUNDS = 5
#: The cell of vectors without a direction; all their scores are zero.
ZERO = -1
#: Angles are computed in floating point: cells count as so much wider.
SLACK = 1e-6


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.empty((0, 0))


def centers_of(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` centers of normalised vectors at most: each the direction of its nearest vectors' sum."""
    v = v[np.linalg.norm(v, axis=1) > 0]
    centers = np.unique(v[:: max(1, len(v) // n)][:n], axis=0) if len(v) else v
    for _ in range(ROUNDS if len(centers) else 0):
        near = (v @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, v)
        lost = np.linalg.norm(sums, axis=1) < 1e-12
        sums[lost] = centers[lost]
        centers = vectors.unit(sums)
    return centers


@dataclass
class Cells:
    """Stored vectors (``path``/vectors: item_id, v, cell) and their cells' centers, radii and sizes."""

    path: str
    table: DataFrame
    #: Cell numbers, centers (cells x dimensions), radii as angles, and vectors in each.
    cell: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @classmethod
    def build(cls, items: DataFrame, path: str, cells: int | None = None) -> Cells:
        """``items``: item_id (long), v (array of double, all of one length); rows without a vector are left out."""
        spark = items.sparkSession
        items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
        counts = items.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        n, dim = counts.n, max(1, counts.dim or 1)
        cells = max(1, min(cells or int(n**0.5), CENTER_BYTES // (8 * dim)))
        share = min(1.0, SAMPLE_BYTES / (8 * dim * max(1, n)))
        sample = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("item_id")).select("v").toArrow()
        centers = centers_of(vectors.unit(matrix(sample.column("v"))) if n and sample.num_rows else np.empty((0, dim)), cells)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = vectors.unit(matrix(batch.column("v")))
                near = v @ centers.T if len(centers) else np.zeros((len(v), 1))
                cell = np.where(np.linalg.norm(v, axis=1) > 0, near.argmax(axis=1), ZERO)
                angle = np.where(cell == ZERO, 0.0, np.arccos(np.clip(near.max(axis=1), -1, 1)))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angle)], names=["item_id", "v", "cell", "angle"])

        dealt = items.mapInArrow(deal, "item_id long, v array<double>, cell int, angle double")
        dealt.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id").write.mode("overwrite").parquet(f"{path}/vectors")
        table = spark.read.schema(dealt.schema).parquet(f"{path}/vectors")
        rows = sorted(table.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect())
        cell = np.array([r.cell for r in rows], np.int64)
        center = np.stack([centers[c] if c != ZERO else np.zeros(dim) for c in cell]) if len(cell) else np.empty((0, dim))
        return cls(path, table.drop("angle"), cell, center, np.array([r.radius for r in rows]), np.array([r.n for r in rows], np.int64))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no score in each cell exceeds (queries x cells)."""
        angle = np.arccos(np.clip(queries @ self.center.T, -1, 1))
        bound = np.cos(np.clip(angle - self.radius - SLACK, 0, np.pi))
        # A query or a vector without a direction scores zero.
        bound[:, self.cell == ZERO] = 0.0
        bound[np.linalg.norm(queries, axis=1) == 0] = 0.0
        return bound

    def _scores(self, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, k: int, decimals: int) -> DataFrame:
        """query_id, item_id, score: each task's best k of each query, of the cells that the query wants (queries x cells)."""
        at = {int(c): i for i, c in enumerate(self.cell)}
        table = self.table.filter(F.col("cell").isin([int(c) for c in self.cell[wanted.any(axis=0)]]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)]
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                v, item = matrix(batch.column("v")), batch.column("item_id").to_numpy()
                for c in np.unique(cells):
                    own, asks = cells == c, np.flatnonzero(wanted[:, at[int(c)]])
                    if not len(asks):
                        continue
                    score = np.concatenate([best[0][asks], np.round(queries[asks] @ v[own].T, decimals) + 0.0], axis=1)
                    found = np.concatenate([best[1][asks], np.tile(item[own], (len(asks), 1))], axis=1)
                    order = np.lexsort((found, -score), axis=1)[:, :k]
                    for x, new in zip(best, (score, found), strict=True):
                        x[asks] = np.take_along_axis(new, order, axis=1)
            query, place = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(best[1][query, place]), pa.array(best[0][query, place])], names=["query_id", "item_id", "score"])

        return table.select("item_id", "v", "cell").mapInArrow(run, "query_id long, item_id long, score double")

    def _planned(self, ids: np.ndarray, queries: np.ndarray, k: int, decimals: int) -> np.ndarray:
        """The cells that each query must look into (queries x cells)."""
        if not len(self.cell):
            return np.zeros((len(ids), 0), bool)
        bound = self.bounds(queries)
        order = np.argsort(-bound, axis=1, kind="stable")
        # The nearest cells that hold k vectors together.
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        best = vectors.top_k(self._scores(ids, queries, first, k, decimals), k, "query_id", F.desc("score"), "item_id").filter(F.col("rank") == k)
        floor = {r.query_id: r.score for r in best.select("query_id", "score").collect()}
        least = np.array([floor.get(int(i), -np.inf) for i in ids])
        return first | (bound + 10.0**-decimals >= least[:, None])

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        blocks = max(1, -(-queries.count() // vectors.QUERY_BLOCK))
        for b in range(blocks):
            rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL").toArrow()
            if rows.num_rows:
                yield rows.column("query_id").to_numpy(), vectors.unit(matrix(rows.column("v")))

    def search(self, queries: DataFrame, k: int = 5, decimals: int = 9) -> DataFrame:
        """query_id, rank, item_id, score, as ``vectors.vector_search`` gives them."""
        found = queries.sparkSession.createDataFrame([], "query_id long, item_id long, score double")
        for ids, v in self._blocks(queries):
            found = found.unionByName(self._scores(ids, v, self._planned(ids, v, k, decimals), k, decimals))
        return vectors.top_k(found, k, "query_id", F.desc("score"), "item_id").select("query_id", "rank", "item_id", "score")

    def report(self, queries: DataFrame, k: int = 5, decimals: int = 9) -> DataFrame:
        """query_id, n, n_read: the vectors there are, and those in cells that the query looks into."""
        rows = []
        for ids, v in self._blocks(queries):
            read = self._planned(ids, v, k, decimals) @ self.size
            rows += [(int(i), int(self.size.sum()), int(n)) for i, n in zip(ids, read, strict=True)]
        return queries.sparkSession.createDataFrame(rows, "query_id long, n long, n_read long")

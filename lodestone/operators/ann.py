"""An inverted file of k-means cells, with bounds that tell which cells a search can leave out.

Each cell keeps its radius and the norms of its rows.  By the triangle inequality no row of a cell
can be nearer to a query than the cell's bound says.  A search reads the few cells that look best,
takes each query's k-th score there, and then reads every cell whose bound reaches that: the result
is the exact one.  With nprobe it stops at the nearest cells and is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import METRICS
from lodestone.operators.kernel import Best, exact_scores, matrix
from lodestone.operators.ranking import ranked
from lodestone.operators.search import QUERY_BYTES, checked_metric, query_blocks
from lodestone.operators.tables import discard, kept, kept_at, shipped

#: Cells that a query reads before its bounds are known, and pairs of queries and cells that the driver holds at a time.
FIRST_CELLS, MOST_BOUNDS = 4, 16_000_000
#: Tasks that the rows of one cell are dealt over.
PARTS = 64


def cells(rows: int, dimension: int) -> int:
    """4 cells a dimension, 128 at least, and no more than rows."""
    return max(1, min(rows, max(128, 4 * dimension)))


def _assigned(centroids: np.ndarray):
    """For mapInArrow over id, vector: the nearest cell of each row, how far its centroid is, and the row's norm."""
    squares = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, places = matrix(batch.column(1), centroids.shape[1])
            step = max(1, 4_000_000 // len(centroids))
            near = [np.argmin(squares[None, :] - 2 * (vectors[i : i + step] @ centroids.T), axis=1) for i in range(0, len(vectors), step)]
            cell = np.concatenate(near) if near else np.empty(0, np.int64)
            far, norm = np.sqrt(exact_scores("L2", vectors, centroids[cell])), np.sqrt((vectors * vectors).sum(axis=1))
            rows = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell, pa.int32()), pa.array(far), pa.array(norm)], ["id", "vector", "cell", "far", "norm"])

    return run


def bounds(metric: str, queries: np.ndarray, summary: dict[str, np.ndarray]) -> np.ndarray:
    """For each query and cell what no score in the cell is better than; larger is nearer, L2 is turned round."""
    centroids, radius = summary["centroid"], summary["radius"]
    length, size = np.sqrt((queries * queries).sum(axis=1))[:, None], np.sqrt((centroids * centroids).sum(axis=1))[None, :]
    products = queries @ centroids.T
    slack = 1e-12 * (length * (size + radius[None, :]) + 1e-300)
    if metric == "L2":
        apart = np.sqrt(np.maximum(0, length**2 + size**2 - 2 * products))
        near = np.maximum(0, apart - radius[None, :] - 1e-6 * (length + size))  # the square root is of a difference
        return -(near**2) * (1 - 1e-12)
    most = products + length * radius[None, :] + slack
    if metric == "IP":
        return most
    with np.errstate(divide="ignore", invalid="ignore"):
        out = most / length / np.where(most > 0, summary["least"][None, :], summary["most"][None, :])
    return np.where(np.isfinite(out), out + 1e-12, np.inf)


class IVFIndex:
    """Cells (centroid, radius, norms, rows) and the rows by cell; a search reads the cells that it needs."""

    def __init__(self, collection: DataFrame, nlist: int | None = None, sample_rows: int = 200_000, seed: int = 7):
        spark = collection.sparkSession
        shipped(spark)
        vectors, vectors_at = kept_at(collection.select("id", "vector"), "vectors")  # read once for each step of k-means
        finite = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        sizes = vectors.filter(finite).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
        size = sizes.orderBy(F.desc("n"), "d").first()  # the dimension that most rows have
        rows, dimension = (size["n"], size["d"]) if size else (0, 1)
        nlist = min(rows, nlist) if nlist else cells(rows, dimension)
        whole = vectors.filter(finite & (F.size("vector") == dimension))
        sample = whole if rows <= sample_rows else whole.sample(sample_rows / rows, seed)
        features = sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
        centroids = np.array(KMeans(k=max(2, nlist), maxIter=5, seed=seed).fit(features).clusterCenters()) if rows > 1 else np.zeros((1, dimension))
        kind = vectors.schema["id"].dataType.simpleString()
        placed = vectors.mapInArrow(_assigned(centroids), f"id {kind}, vector {vectors.schema['vector'].dataType.simpleString()}, cell int, far double, norm double")
        # A cell of many rows is dealt over PARTS tasks; within a file cells lie together, so that its statistics prune.
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("cell")
        self.placed = kept(dealt, "cells")
        found = self.placed.groupBy("cell").agg(F.max("far").alias("radius"), F.min(F.when(F.col("norm") > 0, F.col("norm"))).alias("least"), F.max("norm").alias("most"), F.count("*").alias("n"))
        given = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        self.cells = kept(given.join(found, "cell"), "cell-bounds")
        discard(spark, vectors_at)
        self._read: list[tuple[int, int]] = []

    def save(self, path: str) -> None:
        self.placed.write.mode("overwrite").parquet(f"{path}/rows")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVFIndex:
        """What save() put down."""
        out = cls.__new__(cls)
        out.cells, out.placed, out._read = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/rows"), []
        return out

    def share_read(self) -> float:
        """Share of all pairs of queries and cells that searches have read so far."""
        return sum(x for x, _ in self._read) / max(1, sum(y for _, y in self._read))

    def _summary(self) -> dict[str, np.ndarray]:
        """The cells, some 8 bytes a component: as many as a parameter says, however many rows there are."""
        rows = self.cells.orderBy("cell").toArrow()
        out = {n: np.asarray(rows[n].combine_chunks().cast(pa.float64()).fill_null(np.inf)) for n in ("radius", "least", "most", "n")}
        return out | {"cell": np.asarray(rows["cell"]), "centroid": np.array(rows["centroid"].to_pylist(), float).reshape(len(rows), -1 if len(rows) else 0)}

    def _found(self, sent, wanted: np.ndarray, summary: dict[str, np.ndarray], k: int, metric: str, shape: str, least: np.ndarray | None = None) -> DataFrame:
        """qid, id, score of each task's best among the wanted (query, cell) pairs."""
        spark = self.placed.sparkSession
        table = np.zeros((len(wanted), int(summary["cell"].max()) + 1), bool)
        table[:, summary["cell"]] = wanted
        asked = spark.sparkContext.broadcast((table, least))
        self._read.append((int(wanted.sum()), 0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (queries, names), (table, least) = sent.value, asked.value
            best, kind = Best(metric, queries, k, least), None
            for batch in batches:
                kind = batch.column(0).type
                vectors, places = matrix(batch.column(1), queries.shape[1])
                ids, cell = batch.column(0).to_numpy(zero_copy_only=False)[places], batch.column(2).to_numpy()[places]
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    if len(part):
                        best.add(ids[part], vectors[part], np.flatnonzero(table[:, cell[part[0]]]))
            if best.ids is not None and len(best.ids):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.ids, kind), pa.array(best.scores())], ["qid", "id", "score"])

        needed = summary["cell"][wanted.any(axis=0)].tolist()
        return self.placed.filter(F.col("cell").isin(needed)).select("id", "vector", "cell").mapInArrow(run, shape)

    def search(self, queries: DataFrame, k: int = 5, nprobe: int | None = None, metric: str = "IP") -> DataFrame:
        """qid, id, score, rank: each query's k nearest rows; with nprobe those among its nprobe nearest cells.

        The index holds the rows of the dimension that most have.  Vectors that are null, of another
        dimension, or hold nulls or components that aren't finite take no part, nor do vectors of length
        0 where the metric is cosine.
        """
        metric = checked_metric(metric)
        spark, summary = self.placed.sparkSession, self._summary()
        shipped(spark)
        shape = f"qid {queries.schema['qid'].dataType.simpleString()}, id {self.placed.schema['id'].dataType.simpleString()}, score double"
        descending = METRICS[metric][1]
        out = []
        dimension, many = summary["centroid"].shape[1], len(summary["cell"])
        for vectors, names in query_blocks(queries, min(QUERY_BYTES, 8 * dimension * max(1, MOST_BOUNDS // max(1, many)))):
            if vectors.shape[1] != dimension or not many:
                continue
            sent = spark.sparkContext.broadcast((vectors, names))
            most = bounds(metric, vectors, summary)
            near = most if nprobe is None else 2 * vectors @ summary["centroid"].T - (summary["centroid"] ** 2).sum(axis=1)
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, : nprobe or FIRST_CELLS], True, axis=1)
            self._read.append((0, most.size))
            rows = self._found(sent, first, summary, k, metric, shape)
            if nprobe is None:
                rows = kept(ranked(rows, k, descending=descending).drop("rank"), "first-cells")
                worst = rows.groupBy("qid").agg(F.count("*").alias("n"), (F.min if descending else F.max)("score").alias("s")).filter(F.col("n") == k)
                known = {r["qid"]: r["s"] for r in worst.select("qid", "s").toLocalIterator()}  # one number for each query of the block
                least = np.array([known.get(q, -np.inf if descending else np.inf) for q in names.to_pylist()]) * (1 if descending else -1)
                rest = (most >= least[:, None]) & ~first
                if rest.any():
                    rows = rows.unionByName(self._found(sent, rest, summary, k, metric, shape, least))
            out.append(ranked(rows, k, descending=descending))
        return reduce(DataFrame.unionByName, out) if out else ranked(spark.createDataFrame([], shape), k)

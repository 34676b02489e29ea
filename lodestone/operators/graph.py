"""A navigable small-world graph as a table, built by joins and searched by rounds of a bounded beam.

Layer 0 holds every row, each layer above one row in `fan` of the one below, chosen by a hash of the id,
until a layer is small enough to be compared whole.  In a layer each row is put into the cells of its
NEAREST centroids, so cells overlap; within pieces of a cell of bounded size every row meets every other
as one matrix product, and the best pairs of all pieces are merged by row.  Links also go the other
way, and a row keeps the nearest of both.

A search compares the top layer whole.  Below, a round takes each query's best `beam` rows so far,
follows the links of those that it hasn't followed, joins the ids that the query hasn't met with the
graph and keeps the best again; a round writes the beams and the ids newly met, not what was met before.  It ends when no query has a row left to follow, then goes
on a layer below.  Every round is a table, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import METRICS
from lodestone.operators.ann import IVFIndex, cells
from lodestone.operators.bm25 import sent
from lodestone.operators.kernel import Best, matrix
from lodestone.operators.ranking import ranked
from lodestone.operators.search import checked_metric, dense_search
from lodestone.operators.tables import discard, kept_at, shipped

#: Links of a row, rows for one of the layer above, and rows that a search keeps, as such indexes have them.
LINKS, FAN, BEAM = 16, 16, 64
#: Rows of a layer that is compared whole, cells that a row is put into, and rows of a piece that meet as one product.
TOP_ROWS, NEAREST, PIECE = 64, 3, 4096


def _linked(metric: str, links: int):
    """For applyInPandas over the rows (id, vector) of a piece: id, other, score of the nearest of each row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vectors, places = matrix(pa.array(rows["vector"].tolist(), pa.list_(pa.float64())))
        ids = rows["id"].to_numpy()[places]
        best = Best(metric, vectors, links + 1)
        best.add(ids, vectors)
        own = pd.DataFrame({"id": ids[best.query], "other": best.ids if best.ids is not None else ids[:0], "score": best.scores()})
        return own[own["id"] != own["other"]]

    return run


def _homes(index: IVFIndex, nearest: int) -> DataFrame:
    """id, vector and each of the nearest cells of the rows of an index."""
    summary = index._summary()
    centroids, numbers = summary["centroid"], summary["cell"].astype(np.int32)
    squares, nearest = (centroids * centroids).sum(axis=1), min(nearest, len(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, places = matrix(batch.column(1), centroids.shape[1])
            far = squares[None, :] - 2 * (vectors @ centroids.T)
            cell = numbers[np.argsort(far, axis=1, kind="stable")[:, :nearest]].ravel()
            rows = batch.take(pa.array(np.repeat(places, nearest)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell)], ["id", "vector", "cell"])

    return index.placed.select("id", "vector").mapInArrow(run, f"{index.placed.select('id', 'vector')._jdf.schema().toDDL()}, cell int")


def _layer(rows: DataFrame, metric: str, links: int) -> DataFrame:
    """id, vector and links (ids, nearest first) of each row of one layer."""
    count = rows.count()
    index = IVFIndex(rows, max(1, min(cells(count, 1), count // (4 * links))))
    home = _homes(index, NEAREST)
    # A cell of many rows is dealt over pieces of bounded size, anew by the hash; rows that two pieces share tie them together.
    sizes = home.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces"))
    dealt = home.join(sizes, "cell").withColumn("_piece", F.pmod(F.xxhash64("id", "cell"), F.col("_pieces")))
    kind = rows.schema["id"].dataType.simpleString()
    pairs = dealt.groupBy("cell", "_piece").applyInPandas(_linked(metric, links), f"id {kind}, other {kind}, score double")
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "score")).dropDuplicates(["id", "other"])
    near = F.desc("score") if METRICS[metric][1] else F.asc("score")
    place = F.row_number().over(Window.partitionBy("id").orderBy(near, "other"))
    linked = both.withColumn("_place", place).filter(F.col("_place") <= 2 * links).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_place", "other"))).alias("_links"))
    return index.placed.select("id", "vector").join(linked, "id", "left").select("id", "vector", F.coalesce(F.transform("_links", lambda x: x["other"]), F.array().cast(f"array<{kind}>")).alias("links"))


class GraphIndex:
    """Layers of a graph (layer, id, vector, links); layer 0 has every row that takes part."""

    def __init__(self, collection: DataFrame, metric: str = "IP", links: int = LINKS, fan: int = FAN):
        """Ids must be unique and not null.  Vectors that are null, of another dimension than most, or hold nulls or
        components that aren't finite are left out."""
        spark = collection.sparkSession
        shipped(spark)
        self.metric, self.fan = checked_metric(metric), fan
        rows, _ = kept_at(collection.select("id", "vector").filter(F.col("id").isNotNull()), "graph-rows")
        layers, level = [], 0
        while True:
            made, _ = kept_at(_layer(rows, self.metric, links).withColumn("layer", F.lit(level)), f"graph-{level}")
            layers.append(made)
            if made.count() <= TOP_ROWS:
                break
            level += 1
            rows = made.filter(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(fan**level)) == 0).select("id", "vector")
            if rows.isEmpty():
                break
        self.layers = layers
        self.compared = 0

    def save(self, path: str) -> None:
        reduce(DataFrame.unionByName, self.layers).write.mode("overwrite").partitionBy("layer").parquet(f"{path}/graph")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: str = "IP") -> GraphIndex:
        """What save() put down."""
        out = cls.__new__(cls)
        out.metric, out.fan, out.compared = checked_metric(metric), FAN, 0
        rows = spark.read.parquet(f"{path}/graph")
        top = rows.agg(F.max("layer").alias("m")).first()["m"]
        out.layers = [rows.filter(F.col("layer") == i) for i in range((top if top is not None else -1) + 1)]
        return out

    def search(self, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
        """qid, id, score, rank of the nearest rows that each query's beam finds; qids must be unique.

        compared counts, over all searches, the pairs of queries and rows whose score was worked out.
        """
        spark = queries.sparkSession
        score, descending = METRICS[self.metric]
        order = Window.partitionBy("qid").orderBy(F.desc("score") if descending else F.asc("score"), "id")
        asked, asked_at = kept_at(queries.select("qid", F.col("vector").alias("_query")).filter("qid is not null"), "graph-queries")
        top = self.layers[-1]
        self.compared += top.count() * asked.count()
        starts = dense_search(asked.select("qid", F.col("_query").alias("vector")), top, beam, self.metric).select("qid", "id", "score")
        held, at = kept_at(starts, "graph-beam")
        for graph in reversed(self.layers[:-1]):
            # Each query's beam, and whether links were followed; what leaves a beam never comes back, so of all
            # that a query has met in this layer only the ids are kept, a table a round that isn't written again.
            best, best_at = kept_at(held.withColumn("followed", F.lit(False)), "graph-best")
            met_at, pair = [best_at], best.select("qid", "id").schema
            while True:
                open_rows = best.filter(~F.col("followed")).select("qid", "id")
                followed = open_rows.join(graph.select("id", "links"), "id").select("qid", F.explode("links").alias("id")).distinct()
                met = spark.read.schema(pair).parquet(*met_at).join(sent(open_rows.select("qid").distinct()), "qid", "left_semi")
                fresh, fresh_at = kept_at(followed.join(met, ["qid", "id"], "left_anti"), "graph-met")
                n = fresh.count()
                met_at.append(fresh_at)
                if not n:
                    break
                self.compared += n
                scored = fresh.join(graph.select("id", "vector"), "id").join(asked, "qid").select("qid", "id", score(F.col("_query"), F.col("vector")).alias("score"), F.lit(True).alias("_new")).filter(F.col("score").isNotNull())
                both = best.select("qid", "id", "score", F.lit(False).alias("_new")).unionByName(scored)
                placed = both.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= beam)
                after, after_at = kept_at(placed.select("qid", "id", "score", (~F.col("_new")).alias("followed")), "graph-best")
                if best_at not in met_at:
                    discard(spark, best_at)
                best, best_at = after, after_at
            discard(spark, at)
            held, at = kept_at(best.select("qid", "id", "score"), "graph-beam")
            for old in {*met_at, best_at}:
                discard(spark, old)
        discard(spark, asked_at)
        return ranked(held, k, descending=descending)

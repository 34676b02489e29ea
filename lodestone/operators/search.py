"""Exact dense search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import METRICS
from lodestone.operators.kernel import matrix, scorer
from lodestone.operators.predicates import matching
from lodestone.operators.ranking import ranked
from lodestone.operators.tables import kept, shipped

#: Bytes of query vectors, in doubles, that are sent to every task at a time.
QUERY_BYTES = 32 << 20


def checked_metric(metric: str) -> str:
    if metric.upper() not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return metric.upper()


def query_blocks(queries: DataFrame, most_bytes: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Vectors and qids of queries (qid, vector), in blocks of one dimension that the driver holds one at a time.

    Queries whose vector is null, empty, or holds a null or a component that isn't finite are left out.
    """
    asked = queries.select("qid", "vector").filter(F.size("vector") > 0)
    sizes = sorted((r["d"], r["n"]) for r in asked.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).toLocalIterator())
    rows = {d: max(1, most_bytes // (8 * d)) for d, _ in sizes}
    if sum(-(-n // rows[d]) for d, n in sizes) > 1:
        asked = kept(asked, "queries")
    for d, n in sizes:
        blocks = -(-n // rows[d])
        own = asked.filter(F.size("vector") == d)
        for i in range(blocks):
            part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
            table = part.toArrow()
            vectors, places = matrix(table["vector"], d)
            if len(places):
                yield vectors, table["qid"].combine_chunks().take(pa.array(places))


def dense_search(queries: DataFrame, collection: DataFrame, k: int = 5, metric: str = "IP", threshold: float | None = None, expr: str | None = None, literal_threshold: bool = True, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, id, score, rank of each query's k nearest rows.

    queries: qid, vector.  collection: id, vector and what expr names; expr is applied
    before the cut, the threshold after it.  Queries go out in blocks of bounded size; the
    collection stays where it is, and each task gives its own k best of each query to the shuffle.
    Vectors that are null, of another dimension, or hold nulls or components that aren't finite
    take no part, nor do vectors of length 0 where the metric is cosine.
    """
    metric = checked_metric(metric)
    rows = matching(collection, expr).select("id", "vector")
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    shipped(spark)
    shape = f"qid {queries.schema['qid'].dataType.simpleString()}, id {kind}, score double"
    found = []
    for block in query_blocks(queries, query_bytes):
        sent = spark.sparkContext.broadcast(block)
        found.append(ranked(rows.mapInArrow(scorer(metric, k, lambda sent=sent: sent.value), shape), k, threshold, METRICS[metric][1], literal_threshold))
    if not found:
        return ranked(spark.createDataFrame([], shape), k)
    return reduce(DataFrame.unionByName, found)

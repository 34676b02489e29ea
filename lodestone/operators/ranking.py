"""Ranks within queries, with a defined order of ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, k: int, threshold: float | None = None, descending: bool = True, literal_threshold: bool = True) -> DataFrame:
    """qid, id, score, ... with rank: the best k a query, ties to the smaller id.

    The threshold applies after the cut and keeps scores at or above it.  Where smaller is
    nearer, literal_threshold=False turns it round.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score") if descending else F.asc("score"), "id")
    rows = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if threshold is None:
        return rows
    above = descending or literal_threshold
    return rows.filter(F.col("score") >= threshold if above else F.col("score") <= threshold)

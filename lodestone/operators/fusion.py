"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant that damps ranks.
RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 5, threshold: float | None = None, damping: int = RRF_K) -> DataFrame:
    """qid, id, score, rrf_score, rank.  Sums of 1 / (damping + rank) over the lists; ties keep
    the dense list's order, then the sparse one's; the score is the dense one where there is
    one.  The threshold is held against rrf_score after the cut."""
    a = dense.select("qid", "id", F.col("score").alias("_a"), F.col("rank").alias("_ra"))
    b = sparse.select("qid", "id", F.col("score").alias("_b"), F.col("rank").alias("_rb"))

    def share(rank: str):
        return F.coalesce(F.lit(1.0) / (F.lit(damping) + F.col(rank)), F.lit(0.0))

    both = a.join(b, ["qid", "id"], "full").select("qid", "id", F.coalesce("_a", "_b").alias("score"), (share("_ra") + share("_rb")).alias("rrf_score"), "_ra", "_rb")
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("_ra"), F.asc_nulls_last("_rb"))
    rows = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    rows = rows if threshold is None else rows.filter(F.col("rrf_score") >= threshold)
    return rows.select("qid", "id", "score", "rrf_score", "rank")

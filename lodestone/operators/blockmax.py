"""Sparse top-k over postings in blocks, each with the largest weight of every term in it.

Texts are dealt into blocks by a hash of their id.  For a query, the sum over its terms of the query's
weight and the block's largest one is what no text of the block can score above.  A search scores the
blocks whose sum is highest, takes the k-th score found, and then scores only the blocks whose sum
reaches it: the result is the exact one.  All postings of a block lie together, a row a term, so they
are shuffled once when they are dealt, sums by block are made where they lie, and what a search
shuffles of them is the rows of its own terms.  Blocks and what is asked of them meet by (term, block), so
a term that every text has is spread over as many keys as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.bm25 import PLACES, asked_only, sent
from lodestone.operators.ranking import ranked
from lodestone.operators.tables import kept, kept_at

#: Texts of a block, about, and blocks that a query scores before it knows what a score must reach.
BLOCK_TEXTS, FIRST_BLOCKS = 8, 8


def blocked(weights: DataFrame, block_texts: int = BLOCK_TEXTS, texts: int | None = None) -> DataFrame:
    """block, term, its postings (id, w) there and the largest w of them; `texts` is how many there are, about."""
    count = weights.agg(F.approx_count_distinct("id").alias("n")).first()["n"] if texts is None else texts
    blocks = max(1, -(-count // block_texts))
    placed = weights.select("id", "term", "w", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return placed.repartition("block").groupBy("block", "term").agg(F.collect_list(F.struct("id", "w")).alias("postings"), F.max("w").alias("most"))


class BlockedPostings:
    """Postings (id, term, w; w over 0) by block, and the largest w of each term in each block."""

    def __init__(self, weights: DataFrame, block_texts: int = BLOCK_TEXTS, texts: int | None = None):
        self.blocks = kept(blocked(weights, block_texts, texts), "blocks")
        self.read, self.all = 0, 0

    def save(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")

    @staticmethod
    def write(weights: DataFrame, path: str, texts: int | None = None) -> None:
        """Put down what save() would of an index that isn't searched now."""
        blocked(weights, texts=texts).write.mode("overwrite").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockedPostings:
        """What save() put down."""
        out = cls.__new__(cls)
        out.blocks, out.read, out.all = spark.read.parquet(f"{path}/blocks"), 0, 0
        return out

    def weights(self) -> DataFrame:
        """id, term, w of all postings."""
        return self.blocks.select("term", F.explode("postings").alias("_posting")).select("_posting.id", "term", "_posting.w")

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """qid, id, score, rank: like sparse_search over the same weights; queries (qid, term, w) have weights over 0.

        `allowed` ids are kept before the cut, the threshold applies after it.  Of all (query, block)
        pairs that share a term, `all` counts how many there were and `read` how many were scored.
        """
        asked, _ = kept_at(queries.select("qid", "term", F.col("w").alias("_qw")), "asked")
        sums = self.blocks.select("block", "term", "most").join(sent(asked), "term").groupBy("qid", "block").agg(F.sum(F.col("most") * F.col("_qw")).alias("_most"))
        order = Window.partitionBy("qid").orderBy(F.desc("_most"), "block")
        pairs, _ = kept_at(sums.withColumn("_place", F.row_number().over(order)), "block-sums")
        own = asked_only(self.blocks.select("block", "term", "postings"), asked)

        def scored(wanted: DataFrame) -> DataFrame:
            terms, _ = kept_at(wanted.select("qid", "block").join(sent(asked), "qid"), "asked-blocks")
            met = own.join(sent(terms), ["term", "block"]).select("qid", "_qw", F.explode("postings").alias("_posting")).select("qid", "_qw", "_posting.id", "_posting.w")
            if allowed is not None:
                met = met.join(allowed.select("id").distinct(), "id", "left_semi")
            return met.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("_qw")), PLACES).alias("score"))

        first, _ = kept_at(ranked(scored(pairs.filter(F.col("_place") <= FIRST_BLOCKS)), k).drop("rank"), "first-blocks")
        reached = first.groupBy("qid").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
        slack = 2 * 10.0**-PLACES  # sums of doubles in any order, and rounding
        open_pairs = pairs.filter(F.col("_place") > FIRST_BLOCKS).join(reached, "qid", "left")
        rest, _ = kept_at(open_pairs.filter(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("_most") * (1 + 1e-9) + slack >= F.col("_least"))).select("qid", "block"), "later-blocks")
        self.all += pairs.count()
        self.read += pairs.filter(F.col("_place") <= FIRST_BLOCKS).count() + rest.count()
        return ranked(first.unionByName(scored(rest)), k, threshold)

    def share_read(self) -> float:
        """Share of the pairs of queries and blocks that searches have scored so far."""
        return self.read / max(1, self.all)

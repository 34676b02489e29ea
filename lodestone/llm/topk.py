"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

Vectors are turned into integers floor(scale * x).  Cut two vectors into the same segments;
with means m, deviations s and length l of a segment, their squared distance is at least the
sum of l * ((m1 - m2)^2 + (s1 - s2)^2), so with the norms their inner product is at most

    (|q|^2 + |x|^2 - that sum) / 2  =  sum of l * (m1 * m2 + s1 * s2),

which for all pairs of two blocks is one product of small matrices.  Levels go from one
segment to many; pairs whose bound falls below the query's k-th best so far are dropped, rows
and queries without a pair left drop out of the next level, and exact integer products, also
block by block, decide among the survivors.

Queries come in blocks of bounded size, one after another: the driver holds one block at a
time, sends it out, and each candidate row meets it where it lies, so candidates are never
shuffled.  A first look at a bounded number of rows gives each query a k-th score that the
true one can't fall below; workers return at most their k best rows a query and none below
it, and what they found for a block is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, ready, stored

SCALE, K, LEVELS = 1024, 10, (1, 4, 16, 32)
#: Queries that are sent to the workers at a time, and rows of the first look.
QUERY_BLOCK, FIRST_LOOK = 8192, 4096
#: Queries of a block whose matrix with a batch of rows is worked out at a time.
QUERY_TILE = 512
#: Products and sums below this are exact in doubles.
EXACT = 2.0**53


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), x as double; still doubles, all of them whole."""
    return np.floor(scale * values.astype(np.float64))


def features(codes: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment times the root of its length, side by side."""
    cuts = np.linspace(0, codes.shape[1], min(segments, codes.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = codes[:, a:b]
        out += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(codes), 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and of b; Python's integers where doubles would not do."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        wide = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
        return wide[0] @ wide[1].T
    return a @ b.T


class Block:
    """Queries of one length, their statistics, and the best rows found for them."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, floor: np.ndarray | None = None):
        self.ids, self.codes, self.k = ids, codes, k
        self.levels = [n for n in levels if n < codes.shape[1]]  # at a segment a component the bound would be the product itself
        self.features = [features(codes, n) for n in self.levels]
        self.norms = np.sqrt((codes**2).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        self.pairs = self.exact = 0  # pairs met, and those that no bound dropped

    def meet(self, ids: np.ndarray, codes: np.ndarray) -> None:
        """Keep what these rows change in the best."""
        for at in range(0, len(self.ids), QUERY_TILE):
            self._meet(slice(at, at + QUERY_TILE), ids, codes)

    def _meet(self, tile: slice, ids: np.ndarray, codes: np.ndarray) -> None:
        slack = 1e-9 * np.outer(self.norms[tile], np.sqrt((codes**2).sum(axis=1))) + 1e-3
        alive = self.ids[tile, None] != ids[None, :]
        floor = self.floor[tile, None]
        self.pairs += int(alive.sum())
        q, x = np.arange(len(alive)), np.arange(len(ids))
        for n, own in zip(self.levels, self.features, strict=True):
            at = np.ix_(q, x) if alive.size != len(q) * len(x) else ...
            bound = own[tile][q] @ features(codes[x], n).T
            bound += slack[at]
            some = bound >= floor[q]
            some &= alive[at]
            alive[at] = some
            q, x = q[some.any(axis=1)], x[some.any(axis=0)]
            if not len(q):
                return
        score = products(self.codes[tile][q], codes[x])
        some = alive[np.ix_(q, x)]
        self.exact += int(some.sum())
        good = np.nonzero(some & (score >= floor[q]))
        a, b = q[good[0]] + tile.start, x[good[1]]
        found = score[good]
        if not len(a):
            return
        query, row = np.concatenate([self.query, a]), np.concatenate([self.row, ids[b]])
        score = np.concatenate([self.score, np.fromiter(map(int, found), object, len(found))])
        by_score = -score.astype(np.float64) if not len(score) or max(map(abs, score)) < EXACT else _places(score)
        order = np.lexsort((row, by_score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.concatenate(([True], query[1:] != query[:-1]))
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], [_below(v) for v in score[full]])
        keep = rank < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]


def _places(score: np.ndarray) -> np.ndarray:
    """Places of integers too large for doubles, the largest first, equal ones alike."""
    order = {v: i for i, v in enumerate(sorted(set(score.tolist()), reverse=True))}
    return np.array([order[v] for v in score.tolist()])


def _below(value: int) -> float:
    """The double nearest to an integer, or the next one under it if that is above."""
    near = float(value)
    return near if near <= value else float(np.nextafter(near, -np.inf))


def by_length(ids: list[int], vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by the vectors' length."""
    lengths, numbers = np.array([len(v) for v in vectors], np.int64), np.array(ids, np.int64)
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = numbers[at], np.array([vectors[i] for i in at.tolist()], np.float64).reshape(len(at), n)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, levels: tuple[int, ...] = LEVELS, query_block: int = QUERY_BLOCK, first_look: int = FIRST_LOOK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products, ties to the smaller vec_id.

    Both tables have vec_id and embedding.  Rows whose vector is null or holds null or
    non-finite components, or without a vec_id, take no part; vectors of other lengths than
    a query's never meet it.  Rows with a query's own vec_id are not its candidates; other
    rows that repeat are candidates each.  A query id that repeats is asked once, with its
    smallest vector; of equal scores the smaller vec_id goes first.  Scores that no 64-bit
    integer holds raise an error.  Vectors of any length, an empty table and other columns,
    whatever their names, are fine; with an empty table the result is empty.
    """
    spark = vectors.sparkSession
    ready(spark)

    def sound(df: DataFrame) -> DataFrame:
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)

    rows = sound(vectors)
    asked = sound(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked, asked_path = stored(asked, "queries")
    n_blocks = max(1, -(-asked.count() // query_block))
    look = rows.limit(first_look).toArrow()
    seen = by_length(look.column(0).to_pylist(), look.column(1).to_pylist())
    out = None
    for i in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).toArrow()  # about query_block rows; the block before is gone
        blocks = {}
        for length, (ids, values) in by_length(part.column(0).to_pylist(), part.column(1).to_pylist()).items():
            first = Block(ids, integers(values, scale), k, levels)
            if length in seen:
                first.meet(seen[length][0], integers(seen[length][1], scale))
            blocks[length] = (ids, values, first.floor)
        sent = spark.sparkContext.broadcast(blocks)
        found, _ = stored(rows.mapInArrow(_meet_block(sent, k, scale, levels), "query_id long, vec_id long, score long"), "block-hits")
        sent.destroy()
        out = found if out is None else out.union(found)
    discard(spark, asked_path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet_block(queries, k: int, scale: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {n: Block(ids, integers(values, scale), k, levels, floor.copy()) for n, (ids, values, floor) in queries.value.items()}
        for batch in batches:
            for length, (ids, values) in by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                if length in blocks:
                    blocks[length].meet(ids, integers(values, scale))
        for b in blocks.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.query], pa.int64()), pa.array(b.row, pa.int64()), pa.array(b.score.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

    return run

"""Scores of Arrow batches of vectors against a block of queries: one matrix product, exact in the end.

A matrix product adds up in an order of its own, so its last bits say nothing.  It only chooses:
every pair whose product may be among the best k, given how far rounding can go, is added up again
in doubles, component by component, and ranked by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Products that a task holds at a time.
PAIRS = 4_000_000


def matrix(values: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and their places in values.

    Vectors that are null, of another dimension than the first (or than the given one), or that
    hold a null or a component that isn't finite are left out.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = np.diff(values.offsets.to_numpy())
    whole = np.asarray(values.is_valid()) & (sizes > 0)
    if dimension is None:
        dimension = int(sizes[whole][0]) if whole.any() else 0
    whole &= sizes == dimension
    starts = values.offsets.to_numpy()[:-1][whole]
    places = np.flatnonzero(whole)
    if not len(places):
        return np.empty((0, dimension)), places
    flat = values.values
    numbers = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    rows = numbers[starts[:, None] + np.arange(dimension)]
    finite = np.isfinite(rows).all(axis=1)
    return rows[finite], places[finite]


def _fold(terms: Callable[[int], np.ndarray], dimension: int, n: int) -> np.ndarray:
    total = np.zeros(n)
    for i in range(dimension):
        total = total + terms(i)
    return total


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(_fold(lambda i: v[:, i] * v[:, i], v.shape[1], len(v)))


def exact_scores(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Score of each query with the vector beside it, added up in order; nan where there is none."""
    n, d = queries.shape
    if metric == "L2":
        return _fold(lambda i: (queries[:, i] - vectors[:, i]) * (queries[:, i] - vectors[:, i]), d, n)
    dots = _fold(lambda i: queries[:, i] * vectors[:, i], d, n)
    if metric == "IP":
        return dots
    lengths = _norms(queries) * _norms(vectors)
    return np.divide(dots, lengths, out=np.full(n, np.nan), where=lengths > 0)


class Best:
    """The k best rows of each query so far: larger is nearer here (L2 is turned round), ties to the smaller id."""

    def __init__(self, metric: str, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        """least: what a score must reach for its query, if that is known."""
        self.metric, self.queries, self.k = metric, queries, k
        self.sign = -1.0 if metric == "L2" else 1.0
        self.squares = (queries * queries).sum(axis=1)
        self.floor = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.compared = 0

    def _near(self, vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Query and vector of each pair that may be among the best."""
        queries = self.queries[asked]
        products = queries @ vectors.T
        squares = (vectors * vectors).sum(axis=1)
        spread = np.sqrt(self.squares[asked])[:, None] * np.sqrt(squares)[None, :]
        slack = 4e-16 * (vectors.shape[1] + 8) * (spread + 1e-300)  # of a sum of products in any order
        if self.metric == "L2":
            sums = self.squares[asked][:, None] + squares[None, :]
            products, slack = 2 * products - sums, 2 * slack + 4e-16 * (vectors.shape[1] + 8) * sums
        elif self.metric == "COSINE":
            with np.errstate(divide="ignore", invalid="ignore"):
                products, slack = products / spread, slack / spread + 1e-15
            products[spread == 0] = -np.inf
            slack[spread == 0] = 0
        floor = self.floor[asked]
        if vectors.shape[0] > self.k:
            low = products - slack
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        found = products + slack >= floor[:, None]
        if self.metric == "COSINE":
            found &= spread > 0
        return np.stack(np.nonzero(found))

    def add(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compare rows with the queries of these numbers, all if none are given."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        if not len(asked) or not len(ids):
            return
        self.compared += len(asked) * len(ids)
        step = max(self.k + 1, PAIRS // len(asked))
        for low in range(0, len(ids), step):
            own, rows = ids[low : low + step], vectors[low : low + step]
            q, v = self._near(rows, asked)
            score = self.sign * exact_scores(self.metric, self.queries[asked[q]], rows[v])
            query, score, held = np.r_[self.query, asked[q]], np.r_[self.score, score], own[v] if self.ids is None else np.r_[self.ids, own[v]]
            order = np.lexsort((held, -score, query))
            query, score, held = query[order], score[order], held[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            keep = place < self.k
            full = place == self.k - 1
            self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
            self.query, self.score, self.ids = query[keep], score[keep], held[keep]

    def scores(self) -> np.ndarray:
        return self.sign * self.score


def scorer(metric: str, k: int, block: Callable[[], tuple[np.ndarray, pa.Array]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over id, vector: qid, id, score of the k best of a task for each query.  block gives queries and qids there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = block()
        best = Best(metric, queries, k)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            vectors, places = matrix(batch.column(1), queries.shape[1])
            best.add(batch.column(0).to_numpy(zero_copy_only=False)[places], vectors)
        if best.ids is not None and len(best.ids):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), pa.array(best.ids, kind), pa.array(best.scores())], ["qid", "id", "score"])

    return run

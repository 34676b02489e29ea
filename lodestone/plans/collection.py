"""A searchable collection: a folder of Parquet with rows, term table and corpus size.

An insert writes a batch of rows, their term counts, and how many of its texts hold each term;
a commit in the log makes the batch count.  Writers may work at once, and what a lost one left
is never seen.  Corpus statistics are sums over the batches, so an append costs work in its own
batch alone: weights are worked out from counts and the statistics of the moment, for the terms
that a search asks for.  build_terms weighs all rows once and for all, in blocks, which searches
use as long as no later batch has been committed.  A collection at() a version reads what was
committed up to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ann import IVFIndex
from lodestone.operators.blockmax import BlockedPostings
from lodestone.operators.bm25 import asked_only, document_weights, idf_of, postings, query_weights, sparse_search, sparse_vectors
from lodestone.operators.chunks import with_dense_ids
from lodestone.operators.fusion import rrf
from lodestone.operators.graph import GraphIndex
from lodestone.operators.predicates import matching
from lodestone.operators.search import dense_search
from lodestone.operators.tables import kept
from lodestone.plans.commits import CommitLog
from lodestone.schema import MAX_TEXT_BYTES


class CollectionExistsError(Exception):
    pass


class Collection:
    """Rows (id, vector, text, metadata) under `path`."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "IP", pinned: int | None = None):
        self.spark, self.path, self.dimension, self.metric, self.pinned = spark, path.rstrip("/"), dimension, metric.upper(), pinned
        self.log = CommitLog(spark, f"{self.path}/log")

    def version(self) -> int:
        """The version that is read: the pinned or the latest one; 0 before the first insert."""
        return self.log.head().version if self.pinned is None else self.pinned

    def at(self, version: int) -> Collection:
        """The same collection as it was at a version, whatever is committed later; it can't be written."""
        return Collection(self.spark, self.path, self.dimension, self.metric, version)

    def _fs(self, part: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self) -> bool:
        fs, target = self._fs()
        return bool(fs.exists(target))

    def create(self) -> None:
        """An error if it is there already."""
        if self.exists():
            raise CollectionExistsError(f"集合已存在 (the collection exists): {self.path}")
        fs, target = self._fs()
        fs.mkdirs(target)

    def drop(self) -> None:
        """Nothing happens if it isn't there."""
        fs, target = self._fs()
        fs.delete(target, True)

    def _table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def _has(self, part: str) -> bool:
        fs, target = self._fs(part)
        return bool(fs.exists(target))

    def _committed(self, part: str) -> DataFrame:
        """Rows of the committed batches of a table, with the first id of their batch; the log is a row a batch."""
        return self._table(part).join(self.log.entries(self.pinned).select("batch", "first"), "batch")

    def _numbered(self, part: str) -> DataFrame:
        return self._committed(part).withColumn("id", F.col("id") + F.col("first")).drop("batch", "first")

    def rows(self) -> DataFrame:
        return self._numbered("rows")

    def insert(self, rows: DataFrame, source: str | None = None) -> DataFrame:
        """Append rows (text, metadata, vector) and return their new ids with the texts.

        Vectors must have the collection's dimension and texts at most 65,535 bytes: a row
        that doesn't fit fails the write, and nothing of it is kept.  Rows of a named source are
        appended once: if a batch of that name was committed before, nothing is written.
        """
        if not self.exists():
            raise FileNotFoundError(self.path)
        if self.pinned is not None:
            raise ValueError("a collection at a version can't be written")
        if source is not None and self.log.first_of(source) is not None:
            return self.rows().select("id", "text").limit(0)
        fits = (F.size("vector") == self.dimension) & (F.octet_length("text") <= MAX_TEXT_BYTES)
        checked = rows.withColumn("text", F.when(fits, F.col("text")).otherwise(F.raise_error(F.lit("a row doesn't fit the collection"))))
        batch = f"b{uuid.uuid4().hex}"
        place = {part: f"{part}/batch={batch}" for part in ("rows", "counts", "terms")}
        first = None
        try:
            numbered = with_dense_ids(checked, [F.xxhash64("text"), F.to_json("metadata")], "id")
            numbered.select("id", "vector", "text", "metadata").write.parquet(f"{self.path}/{place['rows']}")
            added = self._table(place["rows"])
            postings(added, "id", "text").write.parquet(f"{self.path}/{place['counts']}")
            counts = self._table(place["counts"])
            counts.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/{place['terms']}")
            first = self.log.commit(batch, added.count(), counts.agg(F.sum("tf").alias("n")).first()["n"] or 0, source)
        finally:
            if first is None:  # it failed, or another writer had the source first
                for part in place.values():
                    fs, target = self._fs(part)
                    fs.delete(target, True)
        if first is None:
            return self.rows().select("id", "text").limit(0)
        return added.select((F.col("id") + first).alias("id"), "text")

    def corpus_size(self) -> DataFrame:
        """One row: n texts and avgdl, 1 where no text has a token; from the log alone."""
        total = self.log.entries(self.pinned).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"))
        return total.select("n", F.coalesce(F.nullif(F.col("_tokens") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))

    def idf(self, asked: DataFrame | None = None) -> DataFrame:
        """term, df and idf over all committed batches; only of the terms of `asked` (term, ...) if it is given."""
        batches = self._committed("terms").select("term", "df")
        batches = batches if asked is None else asked_only(batches, asked)
        return idf_of(batches.groupBy("term").agg(F.sum("df").alias("df")), self.corpus_size())

    def build_terms(self) -> None:
        """Weigh all rows from their kept counts, in blocks that bound what a search reads; until the next insert."""
        covers, version = self.version(), uuid.uuid4().hex
        then = self.at(covers)
        then.idf().write.parquet(f"{self.path}/weights/{version}/terms")
        weights = document_weights(then._numbered("counts"), self._table(f"weights/{version}/terms"), then.corpus_size())
        BlockedPostings.write(weights, f"{self.path}/weights/{version}", then.count())
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(covers).alias("covers")).write.mode("overwrite").parquet(f"{self.path}/current")

    def _weighed(self) -> str | None:
        """Where the blocks lie that build_terms made of just the rows there are."""
        now = self._table("current").first() if self._has("current") else None
        return f"weights/{now['version']}" if now and now["covers"] == self.version() else None

    def build_index(self, nlist: int | None = None, graph: bool = False) -> None:
        """Deal all rows into the cells of an inverted file, or link them in a graph; run after inserts."""
        name = "graph-index" if graph else "index"
        (GraphIndex(self.rows(), self.metric) if graph else IVFIndex(self.rows(), nlist)).save(f"{self.path}/{name}")
        self.spark.range(1).select(F.lit(self.count()).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/{name}/covers")

    def _covered(self, name: str) -> bool:
        """Whether an index was built over as many rows as there are now; rows are only ever appended."""
        return self._has(f"{name}/covers") and self._table(f"{name}/covers").first()["rows"] == self.count()

    def approximate_search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, nprobe: int | None = None, beam: int | None = None) -> DataFrame:
        """Like search: among the rows of each query's nprobe nearest cells, or those that a beam over the graph finds."""
        if beam is not None:
            found = GraphIndex.load(self.spark, f"{self.path}/graph-index", self.metric).search(queries, k, beam)
        else:
            found = IVFIndex.load(self.spark, f"{self.path}/index").search(queries, k, nprobe, self.metric)
        return self._hits(found if threshold is None else found.filter(F.col("score") >= threshold))

    def count(self) -> int:
        """Rows; -1 if they can't be read."""
        return (self.log.entries(self.pinned).agg(F.sum("rows").alias("n")).first()["n"] or 0) if self.exists() else -1

    def sparse_vectors(self) -> DataFrame:
        """id and its map of term to weight, by the statistics of the rows there are; from what build_terms made of them, if it did."""
        place = self._weighed()
        weights = BlockedPostings.load(self.spark, f"{self.path}/{place}").weights() if place else document_weights(self._numbered("counts"), self.idf(), self.corpus_size())
        return self.rows().select("id").join(sparse_vectors(weights), "id", "left").withColumn("sparse_vector", F.coalesce("sparse_vector", F.expr("cast(map() as map<string,double>)")))

    def _hits(self, ranks: DataFrame) -> DataFrame:
        return ranks.join(self.rows().select("id", "text", "metadata"), "id")

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, expr: str | None = None) -> DataFrame:
        """queries (qid, vector) -> hits qid, id, text, metadata, score, rank; exact.

        Without expr, cells that can't hold a hit are left out if an inverted file covers all rows.
        """
        if expr is None and self._covered("index"):
            found = IVFIndex.load(self.spark, f"{self.path}/index").search(queries, k, None, self.metric)
            return self._hits(found if threshold is None else found.filter(F.col("score") >= threshold))
        return self._hits(dense_search(queries, self.rows(), k, self.metric, threshold, expr))

    def _sparse(self, queries: DataFrame, k: int, threshold: float | None, expr: str | None) -> DataFrame:
        allowed = matching(self.rows(), expr).select("id") if expr else None
        place = self._weighed()
        if place:
            weights = query_weights(queries, "qid", "question", self._table(f"{place}/terms"))
            return BlockedPostings.load(self.spark, f"{self.path}/{place}").search(weights, k, threshold, allowed)
        idf = kept(self.idf(postings(queries, "qid", "question")), "asked-idf")
        found = asked_only(self._numbered("counts"), idf)
        return sparse_search(query_weights(queries, "qid", "question", idf), document_weights(found, idf, self.corpus_size()), k, threshold, allowed)

    def keyword_search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, expr: str | None = None) -> DataFrame:
        """queries (qid, question) -> hits; a question without known terms has none."""
        return self._hits(self._sparse(queries, k, threshold, expr))

    def hybrid_search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, expr: str | None = None) -> DataFrame:
        """queries (qid, question, vector): k of either search, fused."""
        dense = dense_search(queries.select("qid", "vector"), self.rows(), k, self.metric, None, expr)
        return self._hits(rrf(dense, self._sparse(queries, k, None, expr), k, threshold))

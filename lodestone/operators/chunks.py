"""Documents to chunks, as table-generating operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.tables import kept, shipped
from lodestone.operators.splitting import SEPARATORS, greedy_split, recursive_split

#: Bytes of texts that a worker splits at a time.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class ChunkSettings:
    """Given values go before those of a settings file, and those before the defaults."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    min_chunk_length: int = 20
    separators: tuple[str, ...] = SEPARATORS

    @classmethod
    def of(cls, config: dict | None = None, **given) -> ChunkSettings:
        known = {k: v for k, v in (config or {}).items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**(known | {k: v for k, v in given.items() if v is not None}))


def fixed_windows(text: Column, settings: ChunkSettings) -> Column:
    """Array of windows, all in the JVM; none for null and empty texts."""
    size, step = settings.chunk_size, settings.chunk_size - settings.chunk_overlap
    step = step if step > 0 else size
    last = F.floor((F.char_length(text) - 1) / step).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.char_length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def give_back() -> None:
    """Free memory goes back to the machine: Spark keeps idle workers, and they what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
    if trim:
        trim(0)


def split_batches(settings: ChunkSettings, greedy: bool = False):
    """For mapInArrow over rows (..., text): the other columns, chunk_index and chunk, a row a chunk.

    The splitters carry state from piece to piece, so a text is split whole; of a batch, texts of some
    TOGETHER bytes are split at a time, so a worker holds no more chunks than those of that many.
    """
    split = greedy_split if greedy else recursive_split
    args = (settings.chunk_size, settings.chunk_overlap, settings.separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * TOGETHER // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                chunks = [split(t, *args) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
                sizes = list(map(len, chunks))
                rows = part.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                index = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)]))
                chunk = pa.array([c for x in chunks for c in x], pa.string())
                names = [*part.schema.names[:-1], "chunk_index", "chunk"]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], index, chunk], names)
                del part, chunks, rows, chunk
            give_back()

    return run


def exploded_chunks(docs: DataFrame, text: str, settings: ChunkSettings, how: str = "recursive") -> DataFrame:
    """docs without the text, with chunk_index and chunk; chunks that are too short are dropped after numbering."""
    others = docs.drop(text)
    if how == "fixed":
        rows = docs.withColumn("_parts", fixed_windows(F.col(text), settings)).drop(text).select("*", F.posexplode("_parts").alias("chunk_index", "chunk")).drop("_parts")
    else:
        shipped(docs.sparkSession)
        shape = T.StructType([*others.schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())])
        rows = docs.select(*[F.col(f"`{c}`") for c in others.columns], F.col(text)).mapInArrow(split_batches(settings, how == "greedy"), shape)
    return rows.filter(F.char_length("chunk") >= settings.min_chunk_length)


def with_dense_ids(rows: DataFrame, order: list, name: str = "chunk_id") -> DataFrame:
    """Ids 0, 1, 2, ... in the given order, without a one-partition sort.

    Rows are sorted by ranges and stored, as ids must not change if an executor is lost; each
    range's count gives where the next one starts, a row a range.
    """
    placed = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(total)]
        total += n
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_at")
    start = F.element_at(F.create_map(*starts), part)
    return placed.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def split_documents(fragments: DataFrame, settings: ChunkSettings = ChunkSettings(), how: str = "recursive", order: list | None = None) -> DataFrame:
    """Fragments to chunks (text, metadata with chunk_id and chunk_index).

    chunk_index counts within a fragment, dropped chunks too; chunk_id is dense over all.
    """
    order = order or [F.split("metadata.source", "/"), F.col("metadata.page"), F.col("chunk_index")]
    rows = with_dense_ids(exploded_chunks(fragments, "page_content", settings, how), order)
    meta = F.col("metadata").withField("chunk_id", F.col("chunk_id")).withField("chunk_index", F.col("chunk_index"))
    return rows.select(F.col("chunk").alias("text"), meta.alias("metadata"))


def chunk_statistics(chunks: DataFrame, source: str, files: int | None, settings: ChunkSettings) -> DataFrame:
    """One row: files, chunks, chunks a file to two places, and the settings."""
    n_files = F.lit(files).cast("long") if files is not None else F.count_distinct(source)
    row = chunks.agg(n_files.alias("files_processed"), F.count("*").alias("chunks_generated"))
    average = F.when(F.col("files_processed") > 0, F.round(F.col("chunks_generated") / F.col("files_processed"), 2)).otherwise(F.lit(0.0))
    return row.select("*", average.alias("avg_chunks_per_file"), F.lit(settings.chunk_size).alias("chunk_size"), F.lit(settings.chunk_overlap).alias("chunk_overlap"), F.lit(settings.min_chunk_length).alias("min_chunk_length"))

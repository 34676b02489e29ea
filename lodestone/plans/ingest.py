"""Jobs: a folder of files to chunks, chunks to a collection; also as commands.

    python -m lodestone.plans.ingest chunk --input-dir DIR --output FILE
    python -m lodestone.plans.ingest build --chunks-file FILE --collection DIR [--rebuild]
"""

from __future__ import annotations

import argparse
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import load_config, section
from lodestone.operators.chunks import ChunkSettings, chunk_statistics, split_documents
from lodestone.operators.embedding import Embedder, embedded, hashing_embedder
from lodestone.operators.tables import kept
from lodestone.plans.collection import Collection
from lodestone.sources.chunk_files import read_chunks, write_chunk_array, write_chunks, write_stats
from lodestone.sources.documents import PageReader, load_directory


def chunk_directory(spark: SparkSession, path: str, settings: ChunkSettings = ChunkSettings(), recursive: bool = True, pages: PageReader | None = None, how: str = "recursive") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, failed files and statistics of a folder."""
    fragments, failed = load_directory(spark, path, recursive, pages)
    order = [F.col("order"), F.col("metadata.page"), F.col("chunk_index")]
    chunks = split_documents(fragments, settings, how, order)
    files = fragments.select("metadata.source").distinct().count()
    return chunks, failed, chunk_statistics(chunks, "metadata.source", files, settings)


def build_collection(chunks: DataFrame, collection: Collection, embed: Embedder | None = None, rebuild: bool = False) -> dict:
    """Embed, insert and weigh chunks; with rebuild the old collection goes first, else rows are appended.

    Without chunks nothing happens but a warning.  Returns rows and seconds of each step.
    """
    if chunks.isEmpty():
        warnings.warn("there are no chunks to build from", stacklevel=2)
        return {"rows": 0}
    if rebuild:
        collection.drop()
    if not collection.exists():
        collection.create()
    began = time.perf_counter()
    rows = kept(embedded(chunks, "text", embed or hashing_embedder(collection.dimension), collection.dimension), "embedded")
    embedded_at = time.perf_counter()
    collection.insert(rows)
    inserted = time.perf_counter()
    collection.build_terms()
    return {"rows": collection.count(), "embed_seconds": embedded_at - began, "insert_seconds": inserted - embedded_at, "terms_seconds": time.perf_counter() - inserted, "total_seconds": time.perf_counter() - began}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    chunk = jobs.add_parser("chunk")
    chunk.add_argument("--input-dir", required=True)
    chunk.add_argument("--output", required=True)
    chunk.add_argument("--chunk-size", type=int)
    chunk.add_argument("--chunk-overlap", type=int)
    chunk.add_argument("--min-length", type=int)
    chunk.add_argument("--config", help="settings file, whose section 'chunking' stands behind the flags")
    chunk.add_argument("--lines", action="store_true", help="a folder of JSON lines, written by the executors, instead of one array")
    chunk.add_argument("--stats", help="file for the statistics, as JSON")
    build = jobs.add_parser("build")
    build.add_argument("--chunks-file", required=True)
    build.add_argument("--collection", required=True)
    build.add_argument("--dim", type=int, default=1536)
    build.add_argument("--rebuild", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.job == "chunk":
        settings = ChunkSettings.of(section(load_config(args.config), "chunking") if args.config else None, chunk_size=args.chunk_size, chunk_overlap=args.chunk_overlap, min_chunk_length=args.min_length)
        chunks, failed, stats = chunk_directory(spark, args.input_dir, settings)
        (write_chunks if args.lines else write_chunk_array)(chunks, args.output)
        for row in failed.toLocalIterator():
            print(f"skipped {row['path']}: {row['error']}")
        if args.stats:
            write_stats(stats, args.stats)
        print(stats.first().asDict())
    else:
        print(build_collection(read_chunks(spark, args.chunks_file), Collection(spark, args.collection, args.dim), rebuild=args.rebuild))


if __name__ == "__main__":
    main()

"""Embedding through a pluggable function, with batches, retries and a cache table."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.tables import kept

#: texts -> vectors, in order.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH, ATTEMPTS, FIRST_WAIT = 25, 3, 2.0


class ServiceError(Exception):
    """A failure of a remote service that is worth another attempt."""


class EmbeddingError(ServiceError):
    """One of the embedding service."""


def hashing_embedder(dimension: int = 1536) -> Embedder:
    """A deterministic embedder that needs no service: signed hashes of words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for word in (text or "").lower().split() or [""]:
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                v[h % dimension] += 1.0 if h >> 62 & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def with_retries(call: Callable[[list[str]], list], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> Callable[[list[str]], list]:
    """Waits 2, 4, ... seconds between attempts after a ServiceError; other errors go through at once."""

    def run(texts: list[str]) -> list:
        for attempt in range(attempts):
            try:
                return call(texts)
            except ServiceError:
                if attempt == attempts - 1:
                    raise
                time.sleep(first_wait * 2**attempt)
        return []

    return run


def embedded(rows: DataFrame, text: str, embed: Embedder, dimension: int, batch: int = BATCH) -> DataFrame:
    """rows with `vector`; a count or length that doesn't match is an error."""
    call = with_retries(embed)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "vector"), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, vectors = part[text].tolist(), []
            for at in range(0, len(texts), batch):
                vectors += call(texts[at : at + batch])
            if len(vectors) != len(texts) or any(len(v) != dimension for v in vectors):
                raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts, of {dimension} numbers each")
            yield part.assign(vector=vectors)

    return rows.mapInPandas(run, schema)


def cache_misses(texts: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts, by their hash, that the cache (text_hash, model, vector, ts) lacks for this model."""
    keyed = texts.select(F.sha2(text, 256).alias("text_hash"), F.col(text)).dropDuplicates(["text_hash"])
    return keyed.join(cache.filter(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")


def clear_cache(spark: SparkSession, path: str) -> None:
    """Remove a cache table that was stored at path; nothing happens if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def embed_cached(rows: DataFrame, text: str, embed: Embedder, dimension: int, cache: DataFrame, model: str, ttl_seconds: int | None = 3600, skip_cache: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with `vector`, and what the cache gains; entries past their time don't count."""
    if ttl_seconds is not None:
        cache = cache.filter(F.col("ts") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)")))
    cache = cache.limit(0) if skip_cache else cache
    fresh = embedded(cache_misses(rows, text, cache, model), text, embed, dimension)
    gained = kept(fresh.select("text_hash", F.lit(model).alias("model"), "vector", F.current_timestamp().alias("ts")), "gained")  # each text is embedded once
    known = cache.filter(F.col("model") == model).select("text_hash", "vector").unionByName(gained.select("text_hash", "vector")).dropDuplicates(["text_hash"])
    return rows.withColumn("text_hash", F.sha2(text, 256)).join(known, "text_hash", "left").drop("text_hash"), gained

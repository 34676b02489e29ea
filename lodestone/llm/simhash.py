"""SimHash near-duplicate detection by covering locality-sensitive hashing.

A family of bit masks is built so that any two fingerprints within the radius agree on all
bits of some mask.  Give each bit position i a vector p(i) in F2^(r+1) and let mask v hold
the positions with <p(i), v> = 1.  At most r positions differ in a close pair; their r
vectors can't span F2^(r+1), so some v != 0 is orthogonal to all of them and mask v leaves
every differing position out.  2^(r+1) - 1 tables therefore find every close pair, with no
chance involved.

Fingerprints are made distinct before anything is linked, so groups of copies cost nothing.
Buckets of more than `most` distinct fingerprints are dealt out again by a second covering
family over the bits that their mask leaves out.  With radius 2 what is left to vary in a
second-level bucket is 64 - 36 - 16 = 12 bits, so it holds 4096 fingerprints at most: the
bound follows from the masks, and no pair is lost on the way.  Within a bucket a search
gives a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.llm.common import ready, discard, stored

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Distinct fingerprints that one bucket may hold before it is dealt out again.
BUCKET = 4096


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions: any two values that differ in at most `radius` of them agree on all bits of one mask."""
    n = (1 << (radius + 1)) - 1
    vectors = {p: i % n + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, vector in vectors.items() if (vector & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        parts = [joined]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        parts = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], np.uint64)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the signed fingerprint of each text (null: no words)."""
    ready(docs.sparkSession)
    return docs.select("doc_id", fingerprint_udf("text").alias("fp"))


def close_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Indices of links that join all of `values` that chains of close pairs join; fewer than len(values)."""
    left, links = np.arange(len(values)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                links += [(at, x) for x in found]
                front += found
    return links


def _link_buckets(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        held_key, held_fp = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            if len(fps) > 1:
                starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
                ends = np.append(starts[1:], len(fps))
                for s, e in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
                    group = fps[s:e].view(np.uint64)
                    for x, y in close_forest(group, radius):
                        a.append(int(fps[s + x]))
                        b.append(int(fps[s + y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_key, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)])
            fps = np.concatenate([held_fp, batch.column(2).to_numpy(zero_copy_only=False)])
            if not len(fps):
                continue
            last = int(np.argmax((keys == keys[-1]).all(axis=1)))
            yield found(keys[:last], fps[:last])
            held_key, held_fp = keys[last:], fps[last:]
        yield found(held_key, held_fp)

    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join exactly what chains of pairs within the radius join."""
    first = covering_masks(list(range(BITS)), radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(first)])
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    crowded = keyed.groupBy("t", "k").count().filter(F.col("count") > most).select("t", "k")
    if not crowded.isEmpty():
        calm = keyed.join(crowded, ["t", "k"], "left_anti")
        finer = []
        for i, mask in enumerate(first):
            rest = covering_masks([p for p in range(BITS) if not mask >> p & 1], radius)
            finer.append(F.array(*[F.struct(F.lit((i + 1) * 100 + j).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask | m))).alias("k")) for j, m in enumerate(rest)]))
        again = keyed.join(crowded, ["t", "k"], "left_semi").select("fp", F.explode(F.element_at(F.array(*finer), F.col("t") + 1)).alias("x"))
        keyed = calm.unionByName(again.select("x.t", "x.k", "fp"))
    return keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_link_buckets(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links, by alternating large and small stars.

    Both steps are joins and grouped minima over links, so they are dealt out over the
    cluster; each round is written to the shared folder, which ends its lineage.
    """
    spark = links.sparkSession
    edges, path = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, large_path = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small, small_path = stored(small, "small-star")
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(spark, large_path)
        discard(spark, path)
        edges, path = small, small_path
        if (now["n"], now["s"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (now["n"], now["s"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that chains of fingerprints within the radius reach.

    Texts that are null, empty or without words have fingerprint 0 and are linked like any
    other.  Rows that repeat stay, each with the same class; null doc_ids never name a class
    unless no other id is in it.  An empty table gives an empty result.
    """
    marked, _ = stored(fingerprints(docs), "fingerprints")
    nodes, _ = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    stars = components(near_links(nodes.select("fp"), radius, most))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")

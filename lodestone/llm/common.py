"""What several operators share: tables in the shared folder, bounded Arrow batches,
attaching a small side, and ranks that no hot key can pile up in one task."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches stay this small, as a document can be far larger than the average.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def ready(spark: SparkSession) -> None:
    """What an operator with Python workers needs: this package on the executors, and Arrow
    batches small enough for several workers an executor."""
    context = spark.sparkContext
    if not any(x.startswith("lodestone-code") for x in context._python_includes):
        root = Path(__file__).resolve().parents[2]
        code = Path(tempfile.mkdtemp()) / f"lodestone-code-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(code, "w") as out:
            for source in sorted((root / "lodestone").rglob("*.py")):
                out.write(source, source.relative_to(root))
        context.addPyFile(str(code))
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    The cluster names it in spark.checkpoint.dir.  Where that is unset, a local master, whose
    executors are the driver itself, gets a temporary folder; any other one is an error, as
    executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no plan needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Memory that is free again goes back to the machine: Spark keeps idle workers, and they what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
    if trim:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, so that its worker gives back memory after each batch and at the end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        give_back()

    return whole


def text_key() -> list[Column]:
    """Two 64-bit hashes of the text: a key of equal texts that needs no unique or non-null id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("_key_a"), F.xxhash64(F.lit(1), text).alias("_key_b")]


def packed(docs: DataFrame) -> DataFrame:
    """_row with all columns but the text, and text: names of theirs can't clash with an operator's own."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row") if others else F.struct(F.lit(0)).alias("_row"), "text")


def unpacked(docs: DataFrame, leave: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs, in order, from what packed() made of it; those an operator gives itself are left."""
    return [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in leave]


def attach(left: DataFrame, side: DataFrame, on: list[str], rows: int, most_rows: int) -> DataFrame:
    """Left outer join of a side of `rows` counted rows; it is sent to all executors only up to
    most_rows rows, beyond that both are shuffled and adaptive execution splits hot keys."""
    return left.join(F.broadcast(side) if rows <= most_rows else side, on, "left")


def running_total(df: DataFrame, within: list[str], order: list[str], amount: str, out: str, buckets: int = 64) -> DataFrame:
    """Exclusive running total of `amount` per `within`, in an order that starts with a hash bucket.

    No task gets all rows of a `within` key: totals are made within (key, bucket), and the
    starts of the buckets, at most `buckets` a key, are added afterwards.  `order` must tell
    all rows of a key apart, or rows that it doesn't must be interchangeable.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*within, "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = df.alias("l").join(starts.alias("r"), same, "left")
    return joined.select("l.*", (F.col("l._inner") + F.col("r._start")).alias(out)).drop("_inner", "_bucket")

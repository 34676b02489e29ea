"""Chunks as JSON: a folder of JSON lines that scales, or one pretty array for other tools."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.schema import CHUNK


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("text", "metadata").write.mode("overwrite").json(path)


def write_chunk_array(chunks: DataFrame, path: str) -> None:
    """One local file in order of chunk_id, streamed row by row; for small results."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(chunks.select("text", "metadata").orderBy("metadata.chunk_id").toLocalIterator()):
            text = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write((",\n  " if i else "\n  ") + text)
        out.write("\n]" if out.tell() > 1 else "]")


def write_stats(stats: DataFrame, path: str) -> None:
    """The one row of chunk statistics as an indented JSON object in a local file."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(stats.first().asDict(), ensure_ascii=False, indent=2), encoding="utf-8")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Either form.  FileNotFoundError if there is nothing, ValueError if a lone file is not an array."""
    local = Path(path)
    if local.is_file():
        with local.open(encoding="utf-8") as f:
            if f.read(4096).lstrip()[:1] != "[":
                raise ValueError(f"{path} is not a list of chunks")
        return spark.read.schema(CHUNK).option("multiLine", True).json(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return spark.read.schema(CHUNK).json(path)

"""Tables between steps, in the folder that the cluster shares, and this package on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only a local master, whose executors are the driver, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table: worked out once, and lost executors cost nothing of it."""
    return kept_at(df, tag)[0]


def kept_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The same, and where it is, for discard()."""
    path = f"{shared_folder(df.sparkSession)}/lodestone-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a kept table that no plan needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shipped(spark: SparkSession) -> None:
    """This package's code on the executors, for operators with Python workers."""
    context = spark.sparkContext
    if not any(x.startswith("lodestone-code") for x in context._python_includes):
        root = Path(__file__).resolve().parents[2]
        code = Path(tempfile.mkdtemp()) / f"lodestone-code-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(code, "w") as out:
            for source in sorted((root / "lodestone").rglob("*.py")):
                out.write(source, source.relative_to(root))
        context.addPyFile(str(code))


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores first where they come in fewer files than there are cores: a file may
    be one row group, which a single task would read and work on."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows

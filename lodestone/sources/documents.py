"""Text, Markdown and PDF files as fragments.

Files are read as binary on the executors, so any store that Spark reaches will do.  PDF
pages come from an extractor that the caller gives: bytes -> list of page texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import FRAGMENT

SUPPORTED = ("pdf", "txt", "md")
WITH_ERROR = T.StructType([*FRAGMENT.fields, T.StructField("error", T.StringType())])
PageReader = Callable[[bytes], list[str]]


def suffix(path: Column) -> Column:
    """The file type in lower case; a name that is nothing but a dot and letters has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def _hidden(spark: SparkSession, path: str, recursive: bool) -> list[str]:
    """Paths of supported files that Spark's readers leave out: a part of their names begins with _ or a dot."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    root, found = fs.getFileStatus(target).getPath().toString().rstrip("/"), []
    listed = fs.listFiles(target, recursive)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        parts = name[len(root) + 1 :].split("/")
        if any(x.startswith(("_", ".")) for x in parts) and parts[-1].lower().endswith(tuple(f".{x}" for x in SUPPORTED)):
            found.append(name)
    return found


def _opened(names: DataFrame) -> DataFrame:
    """path and content of the files of names (path), read one at a time where the tasks run."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                scheme, _, rest = path.partition(":")
                if scheme == "file":
                    store, name = arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    host, _, inner = rest.removeprefix("//").partition("/")
                    store, base = arrow_fs.FileSystem.from_uri(f"{scheme}://{host}/")
                    name = f"{base.rstrip('/')}/{inner}"
                with store.open_input_stream(name, compression=None) as file:
                    yield pd.DataFrame({"path": [path], "content": [file.read()]})

    return names.mapInPandas(read, "path string, content binary")


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """path and content of the files of a folder, those with hidden names too; only names pass through the driver."""
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    names = _hidden(spark, path, recursive)
    if not names:
        return seen
    hidden = spark.createDataFrame([(x,) for x in names], "path string").join(seen.select("path"), "path", "left_anti")
    return seen.union(_opened(hidden))


def _status(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(target) if fs.exists(target) else None


def text_fragments(files: DataFrame) -> DataFrame:
    """page_content, metadata and error of text files: strict UTF-8, line ends as \\n, one fragment a file on page 1."""
    kind = suffix(F.col("path"))
    content = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    meta = F.struct(F.col("path").alias("source"), F.lit(1).alias("page"), kind.alias("file_type"), F.element_at(F.split("path", "/"), -1).alias("doc_name"))
    return files.filter(kind.isin("txt", "md")).select(F.when(valid, content).alias("page_content"), meta.alias("metadata"), F.when(~valid, F.lit("not UTF-8")).alias("error"))


def pdf_fragments(files: DataFrame, pages: PageReader | None, first_page: int = 1, keep_blank: bool = False) -> DataFrame:
    """A fragment a page; blank pages go unless kept.  A file that can't be read gives one row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                meta = {"source": path, "page": None, "file_type": "pdf", "doc_name": path.rsplit("/", 1)[-1]}
                try:
                    if pages is None:
                        raise RuntimeError("no PDF extractor was given")
                    for i, text in enumerate(pages(bytes(content))):
                        if keep_blank or text.strip():
                            rows.append((text, meta | {"page": i + first_page}, None))
                except Exception as e:  # one bad file must not end the scan: its error is its row
                    rows.append((None, meta, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_content", "metadata", "error"])

    return files.filter(suffix(F.col("path")) == "pdf").select("path", "content").mapInPandas(read, WITH_ERROR)


def load_directory(spark: SparkSession, path: str, recursive: bool = True, pages: PageReader | None = None, first_page: int = 1, keep_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fragments of all supported files, and the files that failed (path, error).

    NotADirectoryError if there is no such folder.  Fragments carry `order`, the parts of the
    path, and sort by it and the page like a walk of the sorted paths.
    """
    status = _status(spark, path)
    if status is None or not status.isDirectory():
        raise NotADirectoryError(path)
    files = _files(spark, path, recursive).filter(is_supported(F.col("path")))
    found = text_fragments(files)
    found = found.unionByName(pdf_fragments(files, pages, first_page, keep_blank))
    found = found.withColumn("order", F.split("metadata.source", "/"))
    failed = found.filter("error is not null").select(F.col("metadata.source").alias("path"), "error")
    return found.filter("error is null").drop("error"), failed


def load_document(spark: SparkSession, path: str, pages: PageReader | None = None, first_page: int = 1, keep_blank: bool = False) -> DataFrame:
    """Fragments of one file.  FileNotFoundError, or ValueError for a format that isn't supported."""
    if _status(spark, path) is None:
        raise FileNotFoundError(path)
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1][1:] else ""
    if kind not in SUPPORTED:
        raise ValueError(f"unsupported format: {kind or 'none'}")
    if kind == "pdf" and pages is None:
        raise RuntimeError("no PDF extractor was given")
    files = spark.read.format("binaryFile").load(path)
    if path.rsplit("/", 1)[-1].startswith(("_", ".")):  # Spark's readers leave such names out
        files = _opened(spark.createDataFrame([(_status(spark, path).getPath().toString(),)], "path string"))
    rows = text_fragments(files) if kind != "pdf" else pdf_fragments(files, pages, first_page, keep_blank)
    return rows.select("page_content", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("metadata")).alias("metadata"))

"""Listing folders of very many files by tasks [S2, S5].

Spark's readers keep every file of a load in the driver.  Here tasks list the folders, one level after the other, and
the driver learns only whether there is a further level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.session import materialise

# Folders a task lists, and files a task opens.
TASK_FOLDERS = 4
TASK_FILES = 500
ROWS = 10_000


def as_uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """File system, path in it, and what stands before such a path in a path of Spark."""
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    path = path.rstrip("/") or "/"
    start = uri.rstrip("/").removesuffix(path)
    return files, path, "file:" if start in ("file:", "file://") else start


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _listable(folder: str) -> bool:
    """Whether tasks can list it: a folder of a file system that is not only known to Spark's readers, and no pattern."""
    uri = as_uri(folder)
    try:
        files, path, _ = _opened(uri)
        return files.get_file_info(path).type == pyarrow.fs.FileType.Directory and uri.rstrip("/").endswith(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of all files below a folder, subfolders included; hidden and empty files are left out, as Spark does.

    What tasks cannot list is listed by Spark's reader, in the driver.
    """
    if not _listable(folder):
        return _binary(spark, folder).select("path", F.col("length").alias("size"))
    uri = as_uri(folder)
    _, path, start = _opened(uri)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _opened(uri)[0]
        for batch in batches:
            for inner in batch["path"].to_pylist():
                found = [f for f in tree.get_file_info(pyarrow.fs.FileSelector(inner)) if not _hidden(f.base_name)]
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    folders = pa.array([f.type == pyarrow.fs.FileType.Directory for f in part], pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array([f.size or 0 for f in part], pa.int64()), folders], ["path", "size", "folder"]
                    )

    level, levels, n = spark.createDataFrame([(path,)], "path string"), [], 1
    while n:
        below = level.repartition(-(-n // TASK_FOLDERS)).mapInArrow(entries, "path string, size long, folder boolean")
        levels.append(materialise(below, "listing"))
        level = levels[-1].filter("folder").select("path")
        n = level.count()
    found = reduce(DataFrame.unionByName, levels).filter("NOT folder AND size > 0")
    return found.select(F.concat(F.lit(start), "path").alias("path"), "size")


def list_digests(spark: SparkSession, folder: str) -> DataFrame:
    """`list_files` with `etag`, the md5 of each file's bytes; files are read by tasks, some hundred each."""
    if not _listable(folder):
        return _binary(spark, folder).select("path", F.col("length").alias("size"), F.md5("content").alias("etag"))
    uri = as_uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _, start = _opened(uri)

        def etag(path: str) -> str:
            with tree.open_input_file(path.removeprefix(start)) as data:
                return hashlib.file_digest(data, "md5").hexdigest()

        for batch in batches:
            etags = [etag(path) for path in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(etags, pa.string())], ["path", "size", "etag"])

    rows = materialise(list_files(spark, folder), "listed")
    tasks = max(1, -(-rows.count() // TASK_FILES))
    return rows.repartition(tasks, "path").mapInArrow(read, "path string, size long, etag string")

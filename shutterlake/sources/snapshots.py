"""Versioned snapshots of tables that change together [S7, S8, M16].

Folder N lives in `<root>/v=N/<table>` (or `batch=N`).  A marker file is written last,
so readers never see half of it, and a job that died leaves no trace.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "_COMMITTED"


class _Store:
    """File-system calls shared by the stores below."""

    prefix = ""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _exists(self, path: str) -> bool:
        fs, hadoop_path = self._fs(path)
        return fs.exists(hadoop_path)

    def _folder(self, number: int) -> str:
        return f"{self.root}/{self.prefix}={number}"

    def _complete(self) -> list[int]:
        """Numbers of all committed folders, ascending."""
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        names = [status.getPath().getName().split("=", 1) for status in fs.listStatus(root)]
        numbers = sorted(int(n[1]) for n in names if n[0] == self.prefix and len(n) == 2)
        return [n for n in numbers if self._exists(f"{self._folder(n)}/{MARKER}")]

    def _write(self, number: int, tables: Mapping[str, DataFrame], also: Callable[[], None] | None = None, partial: bool = False) -> None:
        """Write tables and, last, the marker.  `partial`: the other tables of the folder are written already."""
        if not partial and set(tables) != set(self.schemas):
            raise ValueError(f"exactly these tables are written together: {sorted(self.schemas)}")
        self._unmark(number)

        def write(name: str) -> None:
            columns = [F.col(f.name).cast(f.dataType) for f in self.schemas[name].fields]
            tables[name].select(*columns).write.mode("overwrite").parquet(f"{self._folder(number)}/{name}")

        # Tables are independent jobs; small ones would leave the cluster idle one after another.
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables))
        if also is not None:
            also()
        fs, marker = self._fs(f"{self._folder(number)}/{MARKER}")
        fs.create(marker, True).close()

    def _unmark(self, number: int) -> None:
        """Written again, a folder is incomplete until its new marker stands."""
        fs, marker = self._fs(f"{self._folder(number)}/{MARKER}")
        fs.delete(marker, False)

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[table])


class Snapshots(_Store):
    """Whole tables, published version by version."""

    prefix = "v"

    def version(self) -> int:
        """Greatest complete version; -1 when there is none."""
        return max(self._complete(), default=-1)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version (the newest by default); empty before the first one."""
        version = self.version() if version is None else version
        if version < 0:
            return self._empty(table)
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self._folder(version)}/{table}")

    def publish(self, tables: Mapping[str, DataFrame], version: int) -> None:
        """Write all tables of one version, then its marker."""
        self._write(version, tables)

    def publish_if_changed(self, tables: Mapping[str, DataFrame], changes: DataFrame) -> int:
        """[S8] A new version only when there is at least one change; the version then current."""
        current = self.version()
        if changes.isEmpty():
            return current
        self.publish(tables, current + 1)
        return current + 1

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """[M16] A table computed from the newest version, once per version."""
        path = f"{self._folder(self.version())}/_derived/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


class BatchLog(_Store):
    """Tables that only grow: each streaming batch adds its own rows.

    A batch costs what it adds, not the size of the tables.  A repeated batch
    overwrites itself and reads only earlier ones, so retries change nothing.
    """

    prefix = "batch"

    def append(self, batch: int, tables: Mapping[str, DataFrame], also: Callable[[], None] | None = None) -> None:
        """Write a batch's rows, then what `also` writes, then the marker of both."""
        self._write(batch, tables, also)

    def batches(self, before: int | None = None) -> list[int]:
        return [n for n in self._complete() if before is None or n < before]

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """Rows of all committed batches (those before `before`), with their `batch`."""
        numbers = self.batches(before)
        if not numbers:
            return self._empty(table).withColumn("batch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(self.schemas[table]).parquet(*[f"{self._folder(n)}/{table}" for n in numbers])
        number = F.regexp_extract(F.col("_metadata.file_path"), rf"/{self.prefix}=(-?\d+)/", 1).cast("long")
        return rows.select("*", number.alias("batch"))

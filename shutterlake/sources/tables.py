"""Catalogue tables, inventories, JSON records and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.schema import OBJECTS, TABLES, Catalogue
from shutterlake.sources.listing import list_digests, list_files


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """[S1] One catalogue table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_catalogue(spark: SparkSession, root: str) -> Catalogue:
    """[S1]"""
    return Catalogue(**{name: read_table(spark, root, name) for name in Catalogue._fields})


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """[S2] A stored inventory (key, etag, size)."""
    return spark.read.schema(OBJECTS).parquet(path)


def list_objects(spark: SparkSession, folder: str, with_etag: bool = True) -> DataFrame:
    """[S2] Inventory of a folder of files, listed and read by tasks.

    Without etags the contents are never read.
    """
    files = list_digests(spark, folder) if with_etag else list_files(spark, folder).withColumn("etag", F.lit(None).cast("string"))
    return files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("key"), "etag", "size")


def records(df: DataFrame, column: str, schema: T.StructType, keep: list[str | Column] = ()) -> DataFrame:
    """[S4] A JSON array of objects in `column` as rows, next to the columns in `keep`."""
    parsed = F.from_json(F.col(column), T.ArrayType(schema))
    return df.select(*keep, F.inline(parsed))


def write_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """[S9] Rows of a page or report as JSON or parquet."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_by_state(posts: DataFrame, path: str) -> None:
    """Posts laid out for the feed: one folder per `published`, sorted by time.

    Feed, key and time predicates then skip partitions and row groups.
    """
    (
        posts.repartitionByRange("published", "created_at", "id")
        .sortWithinPartitions("published", "created_at", "id")
        .write.mode("overwrite")
        .partitionBy("published")
        .parquet(path)
    )

"""First import of a folder of files named `author_date_time_id_nn.ext` [S6]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.accounts import profile_url
from shutterlake.sources.listing import list_files

PHOTO_FILES = r"(?i)\.(jpg|jpeg|png)\z"


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the photo files of a folder; contents are not read."""
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return list_files(spark, folder).select(name.alias("name"), "size").filter(F.regexp_like("name", F.lit(PHOTO_FILES)))


def group_files(files: DataFrame) -> DataFrame:
    """Files (name) to posts: all files with the same text before the last underscore.

    A group is one post's own files.
    """
    prefix = F.when(F.contains("name", F.lit("_")), F.regexp_extract("name", r"^(.*)_[^_]*\z", 1)).otherwise(F.col("name"))
    grouped = files.withColumn("prefix", prefix).groupBy("prefix").agg(
        F.array_sort(F.collect_list("name")).alias("media_keys")
    )
    parts = F.split(F.col("media_keys")[0], "_")
    author = F.nullif(parts[0], F.lit(""))
    day, post = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(4))
    url = F.when(F.coalesce(post, F.lit("")) != "", F.concat(profile_url(author), F.lit("/status/"), post))
    return grouped.select(
        F.col("prefix").alias("ref"),
        author.alias("author"),
        F.try_to_timestamp(day, F.lit("yyyyMMdd")).alias("created_at"),
        F.coalesce(url, profile_url(author)).alias("post_url"),
        profile_url(author).alias("author_url"),
        "media_keys",
    )

"""Catalogue statistics: authors, totals, storage, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.capacity import over_limit, usage_columns
from shutterlake.functions.media import photo_count, video_count

MEASURES = ("posts", "published", "pending", "photos", "videos", "photo_bytes", "video_bytes")


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def author_overview(posts: DataFrame) -> DataFrame:
    """[A2, A3, A4] One row per author plus the grand total, in a single pass.

    `is_total` marks the grand total.  Author names are compared byte by byte.
    """
    return (
        posts.rollup("author")
        .agg(
            F.grouping("author").cast("int").alias("is_total"),
            F.nullif(F.max("author_display_name"), F.lit("")).alias("author_display_name"),
            F.count(F.lit(1)).alias("posts"),
            F.count_if(F.col("published") == 1).alias("published"),
            F.count_if(F.col("published") == 0).alias("pending"),
            _total("photo_count").alias("photos"),
            _total("video_count").alias("videos"),
            _total("photo_bytes").alias("photo_bytes"),
            _total("video_bytes").alias("video_bytes"),
        )
        # An empty catalogue still has totals.
        .withColumn("author_display_name", F.when(F.col("is_total") == 0, F.col("author_display_name")))
    )


def overview_from_keys(posts: DataFrame) -> DataFrame:
    """[A9] The per-author part from raw keys, for rows whose counts are not stored.

    Differs from `author_overview` in two ways: the display name is the first one
    that is not empty, by id, and everything not exactly 1 is pending.
    """
    named = F.when(F.coalesce("author_display_name", F.lit("")) != "", F.col("id"))
    published = F.coalesce(F.col("published") == 1, F.lit(False))
    return posts.groupBy("author").agg(
        F.min_by("author_display_name", named).alias("author_display_name"),
        F.count(F.lit(1)).alias("posts"),
        F.count_if(published).alias("published"),
        F.count_if(~published).alias("pending"),
        _total(photo_count("media_keys")).alias("photos"),
        _total(video_count("media_keys")).alias("videos"),
        _total("photo_bytes").alias("photo_bytes"),
        _total("video_bytes").alias("video_bytes"),
    )


def author_bytes(overview: DataFrame) -> DataFrame:
    """[A10] Bytes per author from the overview."""
    rows = overview.filter("is_total = 0")
    total = F.col("photo_bytes") + F.col("video_bytes")
    return rows.select("author", "photo_bytes", "video_bytes", total.alias("total_bytes"))


def sort_overview(overview: DataFrame, measure: str, descending: bool = True) -> DataFrame:
    """[T6] Authors by any measure; names break ties."""
    if measure not in (*MEASURES, "author"):
        raise ValueError(f"unknown measure {measure!r}")
    key = F.col(measure).desc() if descending else F.col(measure).asc()
    return overview.filter("is_total = 0").orderBy(key, "author")


def published_authors(posts: DataFrame) -> DataFrame:
    """[A7, A19]"""
    return posts.filter("published = 1").select("author").distinct()


def all_authors(posts: DataFrame) -> DataFrame:
    """[A8, A19] Every author with the greatest display name."""
    return posts.groupBy("author").agg(F.max("author_display_name").alias("author_display_name"))


def storage_total(objects: DataFrame) -> DataFrame:
    """[A11] Bytes of all stored objects."""
    return objects.agg(_total("size").alias("total_bytes"))


def storage_usage(objects: DataFrame) -> DataFrame:
    """[A11, C12] Used, limit, remaining, percent."""
    return storage_total(objects).select(*[c.alias(n) for n, c in usage_columns("total_bytes").items()])


def admit_upload(objects: DataFrame, incoming: DataFrame) -> DataFrame:
    """[C13] One row: may this batch of incoming objects be stored?"""
    both = objects.select("size", F.lit(0).cast("long").alias("extra")).unionByName(
        incoming.select(F.lit(0).cast("long").alias("size"), F.col("size").alias("extra"))
    )
    sums = both.agg(_total("size").alias("total_bytes"), _total("extra").alias("incoming_bytes"))
    return sums.withColumn("rejected", over_limit(F.col("total_bytes"), F.col("incoming_bytes")))


def account_totals(accounts: DataFrame) -> DataFrame:
    """[A18]"""
    return accounts.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("enabled") == 1).alias("enabled_accounts")
    )

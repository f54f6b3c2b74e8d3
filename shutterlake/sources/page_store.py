"""A catalogue laid out for pages [F16, J2, M16, M17].

A version holds, under one marker,

* `posts` by (`published`, `span`): a span is a piece of time, rows in it are sorted by time and id;
* `zones`: for every (`published`, `span`) its rows, how many of them pass each media filter, and its time range;
* `links` sorted by post, `tags`, and `authors`: lower-case names of authors, and whether they have a published post.

So a page reads the spans that its key, its order and the zones' counts leave, and nothing reads all posts to know
their authors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.operators import filters
from shutterlake.schema import POST_TAGS, POSTS, TAGS, Catalogue
from shutterlake.sources.snapshots import Snapshots

# Media filters whose rows the zones count, by the name of their column.
MEASURES: dict[str, Callable[[], Column]] = {
    "rows": lambda: F.lit(True),
    "feed_photo": lambda: filters.feed_media("photo"),
    "feed_video": lambda: filters.feed_media("video"),
    "admin_photo": lambda: filters.admin_media("photo"),
    "admin_video": lambda: filters.admin_media("video"),
}
LAID_OUT = T.StructType([*POSTS.fields, T.StructField("span", T.StringType())])
ZONES = T.StructType(
    [T.StructField("published", T.IntegerType()), T.StructField("span", T.StringType())]
    + [T.StructField(m, T.LongType()) for m in MEASURES]
    + [T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("most_bytes", T.LongType())]
)
AUTHORS = T.StructType([T.StructField("name", T.StringType()), T.StructField("public", T.BooleanType())])
NO_TIME = "none"


def span_of(created_at: Column | str, unit: str) -> Column:
    """Name of the piece of time (`hour`, `day`, `month`, ...) that rows of one folder share; names sort like times."""
    return F.coalesce(F.date_format(F.date_trunc(unit, created_at), "yyyy-MM-dd-HH"), F.lit(NO_TIME))


class PageStore(Snapshots):
    """Versions of a catalogue laid out for pages; `unit` is the length of a span."""

    def __init__(self, spark: SparkSession, root: str, unit: str = "day"):
        tables = {"posts": POSTS, "zones": ZONES, "links": POST_TAGS, "tags": TAGS, "authors": AUTHORS}
        super().__init__(spark, root, tables)
        self.unit = unit

    def publish_catalogue(self, cat: Catalogue, version: int) -> None:
        """Lay out a catalogue as a new version: one shuffle of the posts, by range, and one of the links."""
        folder = self._folder(version)
        self._unmark(version)
        posts = cat.posts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in POSTS.fields])
        dealt = posts.withColumn("span", span_of("created_at", self.unit)).repartitionByRange("published", "span", "created_at", "id")
        ordered = dealt.sortWithinPartitions("published", "span", "created_at", "id")
        ordered.write.mode("overwrite").partitionBy("published", "span").parquet(f"{folder}/posts")
        stored = self.spark.read.schema(LAID_OUT).parquet(f"{folder}/posts")
        at = F.unix_micros("created_at")
        size = F.coalesce("photo_bytes", F.lit(0)) + F.coalesce("video_bytes", F.lit(0))
        zones = stored.groupBy("published", "span").agg(
            *[F.count_if(test()).alias(m) for m, test in MEASURES.items()], F.min(at).alias("low"), F.max(at).alias("high"), F.max(size).alias("most_bytes")
        )
        authors = stored.groupBy(F.lower("author").alias("name")).agg(F.bool_or(F.coalesce(F.col("published") == 1, F.lit(False))).alias("public"))
        links = cat.post_tags.repartitionByRange("post_id", "tag_id").sortWithinPartitions("post_id", "tag_id")
        self._write(version, {"zones": zones, "links": links, "tags": cat.tags, "authors": authors}, partial=True)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        if table != "posts":
            return super().read(table, version)
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], LAID_OUT)
        return self.spark.read.schema(LAID_OUT).parquet(f"{self._folder(version)}/posts")

    def authors(self, published_only: bool) -> DataFrame:
        """[F16] Lower-case author names, as `operators.tags.author_set` finds them, read from the version."""
        rows = self.read("authors")
        return (rows.filter("public") if published_only else rows).select("name")

    def zones(self, published: int) -> list:
        """Zones of one state: a row for each span."""
        return self.read("zones").filter(F.col("published") == published).collect()

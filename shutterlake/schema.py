"""Schemas of the catalogue tables and of the inputs around them [S1]."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_L, _I, _S, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()
_KEYS = T.ArrayType(T.StringType())

POSTS = _struct(
    ("id", _L, False),
    ("title", _S, True),
    ("media_keys", _KEYS, False),
    ("author", _S, False),
    ("author_display_name", _S, True),
    ("author_url", _S, True),
    ("post_url", _S, True),
    ("description", _S, True),
    ("likes", _L, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
    ("published", _I, True),
    ("photo_bytes", _L, True),
    ("video_bytes", _L, True),
    ("photo_count", _I, False),
    ("video_count", _I, False),
    ("media_count_version", _I, False),
)
TAGS = _struct(("id", _L, False), ("name", _S, False))
POST_TAGS = _struct(("post_id", _L, False), ("tag_id", _L, False))
ACCOUNTS = _struct(
    ("id", _L, False),
    ("username", _S, False),
    ("enabled", _I, True),
    ("crawl_all", _I, True),
    ("last_crawled_at", _TS, True),
    ("last_crawl_type", _S, True),
    ("last_crawl_mode", _S, True),
    ("last_crawl_count", _I, True),
    ("last_crawl_error", _S, True),
    ("created_at", _TS, True),
)
STORAGE = _struct(
    ("id", _I, False),
    ("total_bytes", _L, False),
    ("directory_version", _L, False),
    ("media_counts_ready", _I, False),
    ("updated_at", _TS, True),
)
ASSETS = _struct(
    ("id", _L, False),
    ("post_id", _L, False),
    ("key", _S, False),
    ("etag", _S, True),
    ("phash", _S, True),
    ("phash_version", _I, True),
    ("hashed_at", _TS, True),
)
OBJECTS = _struct(("key", _S, False), ("etag", _S, True), ("size", _L, True))

# One page of an account's media timeline, as the extractor writes it.  Post ids
# are declared as text, so that no JSON reader rounds them to a double.
_PERSON = T.StructType([T.StructField("nick", _S)])
MEDIA_ITEM = T.StructType(
    [
        T.StructField("tweet_id", _S),
        T.StructField("url", _S),
        T.StructField("type", _S),
        T.StructField("date", _S),
        T.StructField("content", _S),
        T.StructField("user", _PERSON),
        T.StructField("author", _PERSON),
    ]
)
TIMELINE_PAGE = T.StructType(
    [
        T.StructField("account", _S),
        T.StructField("page", _L),
        T.StructField("media", T.ArrayType(MEDIA_ITEM)),
        T.StructField("cursor", _S),
        T.StructField("completed", T.BooleanType()),
    ]
)

TABLES = {
    "posts": POSTS,
    "tags": TAGS,
    "post_tags": POST_TAGS,
    "accounts": ACCOUNTS,
    "storage": STORAGE,
    "assets": ASSETS,
}


class Catalogue(NamedTuple):
    """The tables that change together; a change returns a new `Catalogue`."""

    posts: DataFrame
    tags: DataFrame
    post_tags: DataFrame
    assets: DataFrame | None = None
    accounts: DataFrame | None = None

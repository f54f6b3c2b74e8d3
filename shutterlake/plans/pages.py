"""Feed, search and admin pages.

A page is found in two steps.  The first reads only the filter and sort columns
and keeps one page of ids (a distributed top-k).  The second fetches the wide
columns and the tags of those ids; ids and time range are literals by then, so
they reach the scan and skip row groups.  Nothing larger than a page is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions.media import card_columns
from shutterlake.functions.times import TEXT_FORMAT
from shutterlake.operators import filters, tags as tag_ops
from shutterlake.operators.skew import number_rows

# Page sizes [T7].
FEED_MAX, FEED_NEXT = 48, 24
SEARCH_DEFAULT, SEARCH_MAX = 48, 96
ADMIN_DEFAULT, ADMIN_MAX = 10, 100

PAGE_COLUMNS = (
    "id",
    "title",
    "media_keys",
    "author",
    "author_display_name",
    "author_url",
    "post_url",
    "description",
    "likes",
    "created_at",
    "updated_at",
)
PageKey = tuple[str, int]


@dataclass(frozen=True)
class Page:
    """Rows of one page, and how to go on [T4, T5]."""

    items: DataFrame
    has_more: bool
    next_key: PageKey | None = None
    total: int | None = None
    showing_start: int | None = None
    showing_end: int | None = None


def feed_limit(requested: int | None = None) -> int:
    """[T7]"""
    if requested is None:
        return FEED_MAX
    if requested < 1:
        raise ValueError("limit must be at least 1")
    return min(requested, FEED_MAX)


def search_limit(requested: int | None = None) -> int:
    """[T7]"""
    return SEARCH_DEFAULT if requested is None else min(max(requested, 1), SEARCH_MAX)


def admin_limit(requested: int | None = None) -> int:
    """[T7]"""
    return min(ADMIN_MAX, max(1, requested or ADMIN_DEFAULT))


def time_order(sort: str) -> list[Column]:
    """[T1] Newest or oldest first; ids break ties in the same direction."""
    if sort not in ("newest", "oldest"):
        raise ValueError(f"unknown sort {sort!r}")
    if sort == "oldest":
        return [F.col("created_at").asc(), F.col("id").asc()]
    return [F.col("created_at").desc(), F.col("id").desc()]


def total_bytes() -> Column:
    return F.coalesce("photo_bytes", F.lit(0)) + F.coalesce("video_bytes", F.lit(0))


def admin_order(sort: str) -> list[Column]:
    """[T2] Sizes in either direction; ties are newest first."""
    if sort == "size_desc":
        return [total_bytes().desc(), *time_order("newest")]
    if sort == "size_asc":
        return [total_bytes().asc(), *time_order("newest")]
    return time_order("oldest" if sort == "oldest" else "newest")


def page_ids(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """[T1-T3] Ids of one page, in page order."""
    ranked = rows.orderBy(*order)
    ranked = ranked.offset(offset) if offset else ranked
    return ranked.limit(limit).select("id", F.unix_micros("created_at").alias("at"))


def feed_rows(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    sort: str = "newest",
    media: str = "all",
    tag: str | None = None,
    author: str | None = None,
    after: PageKey | None = None,
) -> DataFrame:
    """[F1, F2, F4, F9, J1] Published posts that pass the feed's filters.

    A tag filter replaces the author filter.
    """
    if media not in ("all", "photo", "video"):
        raise ValueError(f"unknown media {media!r}")
    rows = posts.filter(filters.is_published() & filters.feed_media(media))
    if tag:
        rows = rows.join(tag_ops.posts_tagged(post_tags, tags, tag), "id", "left_semi")
    elif author:
        rows = rows.filter(filters.feed_author(author))
    if after:
        rows = rows.filter(filters.after_key(*after, oldest_first=sort == "oldest"))
    return rows


def feed_page(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    sort: str = "newest",
    after: PageKey | None = None,
    offset: int = 0,
    limit: int | None = None,
    **criteria,
) -> Page:
    """One page of the public feed.  An offset is ignored when a key is given."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows = feed_rows(posts, post_tags, tags, sort=sort, after=after, **criteria)
    return _fetch(
        posts, post_tags, tags, rows, time_order(sort), feed_limit(limit), 0 if after else offset, published_only=True
    )


def search_rows(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    q: str | None = None,
    work: str | None = None,
    tag: str | None = None,
    author: str | None = None,
    sort: str = "newest",
    after: PageKey | None = None,
) -> DataFrame:
    """[F1, F3, F7, F9, J3, J4] Published posts that pass every given criterion."""
    rows = posts.filter(filters.is_published())
    if author:
        rows = rows.filter(filters.any_case_author(author))
    for name in (tag, work):
        if name:
            rows = rows.join(tag_ops.posts_tagged_any_case(post_tags, tags, name), "id", "left_semi")
    if q:
        own = filters.keyword_in_columns(q, ("title", "description", "author", "author_display_name"))
        rows = rows.filter(own | tag_ops.has_tag_like(post_tags, tags, q))
    if after:
        rows = rows.filter(filters.after_key(*after, oldest_first=sort == "oldest"))
    return rows


def search_page(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    sort: str = "newest",
    after: PageKey | None = None,
    offset: int = 0,
    limit: int | None = None,
    **criteria,
) -> Page:
    """One page of search results."""
    sort = "oldest" if sort == "oldest" else "newest"
    rows = search_rows(posts, post_tags, tags, sort=sort, after=after, **criteria)
    skip = 0 if after else max(0, offset)
    return _fetch(posts, post_tags, tags, rows, time_order(sort), search_limit(limit), skip, published_only=True)


def admin_rows(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    published: int = 1,
    search: str = "",
    author: str = "",
    tag: str = "",
    media: str = "",
    counts_ready: bool = True,
) -> DataFrame:
    """[M17: F1, F3, F5, F6, F8, J5] Posts that pass the admin filters."""
    media_test = filters.admin_media if counts_ready else filters.admin_media_from_keys
    rows = posts.filter(filters.is_published(published) & media_test(media))
    if search:
        columns = ("title", "author", "description", "author_display_name")
        rows = rows.filter(filters.keyword_in_columns(search.strip().lower(), columns))
    if author:
        rows = rows.filter(filters.any_case_author(author))
    if tag:
        rows = rows.join(tag_ops.posts_tagged(post_tags, tags, tag), "id", "left_semi")
    return rows


def admin_page(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    *,
    sort: str = "newest",
    offset: int = 0,
    limit: int | None = None,
    known_total: int | None = None,
    **criteria,
) -> Page:
    """[M17] One admin page with its totals [A1, T5].

    `known_total` takes the count from a stored overview when no filter is set.
    """
    rows = admin_rows(posts, post_tags, tags, **criteria)
    unfiltered = not any(criteria.get(name) for name in ("search", "author", "tag", "media"))
    total = known_total if known_total is not None and unfiltered else rows.count()
    offset, size = max(0, offset), admin_limit(limit)
    page = _fetch(posts, post_tags, tags, rows, admin_order(sort), size, offset, published_only=False, probe=0)
    shown = page.showing_end
    return Page(
        page.items, offset + shown < total, None, total, offset + 1 if total > 0 else 0, offset + shown
    )


def _fetch(
    posts: DataFrame,
    post_tags: DataFrame,
    tags: DataFrame,
    rows: DataFrame,
    order: list[Column],
    limit: int,
    offset: int,
    *,
    published_only: bool,
    probe: int = 1,
) -> Page:
    """[J2, A5, F16, T4] Collect one page of ids, then read that page's rows and tags."""
    found = page_ids(rows, order, limit + probe, offset).collect()
    shown = found[:limit]
    ids = [row["id"] for row in shown]
    times = [row["at"] for row in shown if row["at"] is not None]
    wide = posts.filter(F.col("id").isin(ids))
    if ids and len(times) == len(ids):
        low, high = (F.timestamp_micros(F.lit(t)) for t in (min(times), max(times)))
        wide = wide.filter(F.col("created_at").between(low, high))
    links = post_tags.filter(F.col("post_id").isin(ids))
    visible = tag_ops.hide_author_tags(tags, tag_ops.author_set(posts, published_only))
    lists = tag_ops.tag_lists(links, visible)
    items = (
        wide.select(*PAGE_COLUMNS, "published", "photo_bytes", "video_bytes")
        .join(lists.withColumnRenamed("post_id", "id"), "id", "left")
        .orderBy(*order)
    )
    has_more = len(found) > limit
    next_key = None
    if has_more and times and shown[-1]["at"] is not None:
        next_key = (_micros_text(shown[-1]["at"]), shown[-1]["id"])
    return Page(items, has_more, next_key, showing_end=len(shown))


def _micros_text(micros: int) -> str:
    from datetime import datetime, timedelta, timezone

    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
    return at.strftime("%Y-%m-%d %H:%M:%S.%f")


def cards(items: DataFrame) -> DataFrame:
    """[C14, S9] Page rows with the columns a card shows, ready for a JSON sink."""
    shown = items.withColumns(card_columns("media_keys"))
    return shown.withColumn("created_at", F.date_format("created_at", TEXT_FORMAT))


def feed_index(posts: DataFrame, page_size: int = FEED_MAX) -> DataFrame:
    """[W9] For every page of the whole feed: its rows and the key of its last row.

    Global ranks come from chunk offsets, not from a window over one partition.
    """
    published = posts.filter(filters.is_published()).select("created_at", "id")
    ranked = number_rows(published, time_order("newest"), name="rn")
    page = F.ceil(F.col("rn") / F.lit(page_size)).cast("long").alias("page")
    last = F.max_by(F.struct("created_at", "id"), "rn")
    return (
        ranked.groupBy(page)
        .agg(F.count(F.lit(1)).alias("n_posts"), last.alias("last"))
        .select("page", "n_posts", F.col("last.created_at").alias("last_created_at"), F.col("last.id").alias("last_id"))
    )


def newest_per(posts: DataFrame, key: str, n: int) -> DataFrame:
    """[T8] The newest `n` published posts of every author (or other column).

    The rank filter is applied before the shuffle as well as after it, so a hot
    key sends at most `n` rows per map task.
    """
    w = W.partitionBy(key).orderBy(*time_order("newest"))
    ranked = posts.filter(filters.is_published()).select(key, "id", "created_at")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

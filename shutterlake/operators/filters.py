"""Row predicates on posts, accounts and logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import VIDEO_EXTENSIONS
from shutterlake.functions.text import ascii_fold, fold_text, like_any, quote
from shutterlake.functions.times import moment

# Fixed value: media types the ingest accepts.
ACCEPTED_TYPES = ("photo", "image", "video", "animated_gif", "gif")


def is_published(flag: int = 1) -> Column:
    """1 for published posts, 0 for pending ones."""
    return F.col("published") == flag


def feed_author(author: str) -> Column:
    """Exact, case-sensitive."""
    return F.col("author") == author


def any_case_author(author: str) -> Column:
    """ASCII case-insensitive, one leading `@` is dropped."""
    return ascii_fold("author") == fold_text(author[1:] if author.startswith("@") else author)


def feed_media(kind: str) -> Column:
    """Posts with at least one photo, or with at least one video."""
    return _pick(kind, photo=F.col("photo_count") > 0, video=F.col("video_count") > 0)


def admin_media(kind: str) -> Column:
    """Photo posts have no video; video posts have any."""
    photo = (F.col("photo_count") > 0) & (F.col("video_count") == 0)
    return _pick(kind, photo=photo, video=F.col("video_count") > 0)


def admin_media_from_keys(kind: str) -> Column:
    """The same from keys alone: a video extension anywhere in a key."""
    pattern = "|".join(quote(ext) for ext in VIDEO_EXTENSIONS)
    video = F.exists("media_keys", lambda k: F.regexp_like(ascii_fold(k), F.lit(pattern)))
    return _pick(kind, photo=~video, video=video)


def _pick(kind: str, photo: Column, video: Column) -> Column:
    if kind == "photo":
        return photo
    if kind == "video":
        return video
    return F.lit(True)


def keyword_in_columns(needle: str, columns: tuple[str, ...]) -> Column:
    """[F7, F8] LIKE on several columns; a NULL column does not match."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(like_any(column, needle), F.lit(False))
    return found


def after_key(created_at: datetime | str | Column, last_id: int | Column, oldest_first: bool = False) -> Column:
    """Rows behind the last row of the previous page."""
    at = created_at if isinstance(created_at, Column) else F.lit(created_at).cast("timestamp")
    c, i = F.col("created_at"), F.col("id")
    if oldest_first:
        return (c > at) | ((c == at) & (i > last_id))
    return (c < at) | ((c == at) & (i < last_id))


def id_range(low: int | None = None, high: int | None = None) -> Column:
    """`low < id <= high`, for incremental runs; both ends are optional."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("id") > low)
    if high is not None:
        inside = inside & (F.col("id") <= high)
    return inside


def with_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose id is in a table of ids, of any size."""
    return posts.join(ids.select("id"), "id", "left_semi")


def has_status_link() -> Column:
    """[F12]"""
    return F.coalesce(like_any("post_url", "/status/"), F.lit(False))


def several_media() -> Column:
    """[F13]"""
    return F.size("media_keys") > 1


def not_backfilled() -> Column:
    """[F15]"""
    return F.col("media_count_version") < 1


def accepted_media() -> Column:
    """Items with a URL and an accepted type."""
    url, kind = F.coalesce("url", F.lit("")), F.lower(F.coalesce("type", F.lit("")))
    return (url != "") & kind.isin(*ACCEPTED_TYPES)


def enabled_accounts(accounts: DataFrame, crawl_everything: bool = False) -> DataFrame:
    """Enabled accounts and whether their full history is wanted."""
    full = F.coalesce(F.col("crawl_all") == 1, F.lit(False)) | F.lit(crawl_everything)
    return accounts.filter(F.coalesce(F.col("enabled"), F.lit(0)) != 0).withColumn("full_history", full)


def recent_run(runs: DataFrame, event: str, now: datetime | Column, minutes: int = 60) -> DataFrame:
    """One row: did `event` run within the last minutes, both ends included?"""
    at = F.try_to_timestamp(F.col("created_at").cast("string"))
    inside = at.between(moment(now) - F.make_dt_interval(mins=F.lit(minutes)), moment(now))
    hits = F.count_if((F.col("event") == event) & F.coalesce(inside, F.lit(False)))
    return runs.agg((hits > 0).alias("recent"), hits.alias("runs"))

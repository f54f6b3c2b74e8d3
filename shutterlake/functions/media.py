"""Media keys, URLs and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.text import trim_all

# Extensions that count as video, and content types by extension.
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mov", ".m4v")
CONTENT_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".mp4": "video/mp4",
    ".webm": "video/webm",
    ".mov": "video/quicktime",
    ".m4v": "video/x-m4v",
}
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+"


def split_keys(c: Column | str) -> Column:
    """[C1] Comma-separated key text to an array without blanks."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_all)
    return F.filter(parts, lambda k: k != "")


def extension(key: Column | str) -> Column:
    """[C1] Lower-case extension with its dot, or an empty string."""
    return F.regexp_extract(F.lower(key), r"\.[a-z0-9]+\z", 0)


def is_video(key: Column | str) -> Column:
    return extension(key).isin(*VIDEO_EXTENSIONS)


def video_count(keys: Column | str) -> Column:
    """[C1]"""
    return F.coalesce(F.size(F.filter(keys, is_video)), F.lit(0))


def photo_count(keys: Column | str) -> Column:
    """[C1] Everything that is not a video counts as a photo."""
    return F.coalesce(F.size(F.filter(keys, lambda k: ~is_video(k))), F.lit(0))


def content_type(key: Column | str, fallback: str = "image/jpeg") -> Column:
    """[C2] Content type by extension."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(key)), F.lit(fallback))


def status_id(url: Column | str) -> Column:
    """[C6] Digits after the first `/status/`; NULL when there are none."""
    return F.nullif(F.regexp_extract(url, r"/status/([0-9]+)", 1), F.lit(""))


def _base_name(url: Column) -> Column:
    """Last part of the path, without slashes behind it; empty when there is none."""
    return F.regexp_extract(url, _URL + r"[^?#]*/([^/?#]+)/*(?:[?#]|\z)", 1)


def media_id(url: Column | str) -> Column:
    """[C7] Base name without extension; text that is no URL identifies itself."""
    url = F.col(url) if isinstance(url, str) else url
    base = F.regexp_replace(_base_name(url), r"\.[a-zA-Z0-9]+\z", "")
    return F.when(F.regexp_like(url, F.lit(_URL)), base).otherwise(url)


def url_extension(url: Column | str) -> Column:
    """[C7] `?format=` wins over the path's extension; `.jpg` when neither exists."""
    url = F.col(url) if isinstance(url, str) else url
    fmt = F.regexp_extract(url, _URL + r"[^?#]*\?(?:[^#]*&)?format=([^&#]+)", 1)
    # A dot in front does not start an extension.
    ext = F.regexp_extract(_base_name(url), r".(\.[^.]*)\z", 1)
    return F.when(fmt != "", F.concat(F.lit("."), fmt)).when(ext != "", ext).otherwise(".jpg")


def item_extension(kind: Column | str, url: Column | str) -> Column:
    """[C7] Videos and gifs are stored as `.mp4`, photos keep their extension."""
    lowered = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(lowered.isin("video", "gif", "animated_gif"), F.lit(".mp4")).otherwise(url_extension(url))


def object_key(author: Column | str, file_name: Column | str) -> Column:
    """[C8] Storage key: author, underscore, file name with unsafe characters replaced."""
    return F.concat(author, F.lit("_"), F.regexp_replace(file_name, r"[^a-zA-Z0-9._-]", "_"))


def first_file_name(name: Column | str) -> Column:
    """File name as the duplicate check sees it (underscores are unsafe there, too) [J15]."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9.-]", "_")


def card_columns(keys: Column | str) -> dict[str, Column]:
    """[C14] First key, number of media, photo/video flags and kind of cover."""
    keys = F.col(keys) if isinstance(keys, str) else keys
    first = F.coalesce(F.try_element_at(keys, F.lit(1)), F.lit(""))
    return {
        "first_key": first,
        "n_media": F.size(keys),
        "has_photo": photo_count(keys) > 0,
        "has_video": video_count(keys) > 0,
        "cover": F.when(first == "", "none").when(is_video(first), "video").otherwise("photo"),
    }

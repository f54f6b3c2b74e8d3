"""Pages of a stored catalogue by pruning [J2, F16, M17].

The rows of a page stand in few spans of time.  Which spans can hold them follows from the page's key, its order and
the zones' counts; only these are read, as partition filters.  Where a filter's hits are not counted (author, tag, text), spans
are read in growing windows, each span once, until the page is full.  The page's wide rows come from the spans it was found in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import tags as tag_ops
from shutterlake.plans import pages
from shutterlake.sources.page_store import NO_TIME, PageStore


def _spans(store: PageStore, published: int, oldest_first: bool, after: pages.PageKey | None) -> list:
    """Zones a page may touch, in page order; rows without a time are the oldest ones."""
    zones = sorted(store.zones(published), key=lambda z: (z["span"] != NO_TIME, z["span"]), reverse=not oldest_first)
    if after is None:
        return zones
    moment = store.spark.sql(f"SELECT unix_micros(CAST('{after[0]}' AS TIMESTAMP))").first()[0]
    if moment is None:
        return []
    timed = [z for z in zones if z["low"] is not None]
    return [z for z in timed if (z["high"] >= moment if oldest_first else z["low"] <= moment)]


def _find(rows_in: Callable[[list[str]], DataFrame], zones: list, order: list[Column], need: int, measure: str | None, keyed: bool = False) -> tuple[list, list[str]]:
    """First `need` rows in page order as (id, at, span), and the spans read for that.

    With a `measure` the zones' counts tell how many spans hold `need` rows; the first one counts as empty for
    a page behind a key, which lies inside it.  Else the number of spans doubles until there are enough rows.
    """
    found: list = []
    read: list[str] = []
    at, width = 0, 1
    while at < len(zones) and len(found) < need:
        end = at
        if measure is None:
            end = min(at + width, len(zones))
            width *= 2
        else:
            held = 0
            while end < len(zones) and held < need - len(found):
                held += 0 if keyed and end == 0 else zones[end][measure]
                end += 1
        window = [z["span"] for z in zones[at:end]]
        ranked = rows_in(window).orderBy(*order).limit(need - len(found))
        found += ranked.select("id", F.unix_micros("created_at").alias("at"), "span").collect()
        read += window
        at = end
    return found, read


def _page(store: PageStore, found: list, order: list[Column], published: int, published_only: bool) -> DataFrame:
    """[J2, A5, F16] Wide rows and visible tags of the rows found, read from their own spans."""
    ids = [r["id"] for r in found]
    spans = sorted({r["span"] for r in found})
    wide = store.read("posts").filter((F.col("published") == published) & F.col("span").isin(spans) & F.col("id").isin(ids))
    times = [r["at"] for r in found if r["at"] is not None]
    if ids and len(times) == len(ids):
        low, high = (F.timestamp_micros(F.lit(t)) for t in (min(times), max(times)))
        wide = wide.filter(F.col("created_at").between(low, high))
    links = store.read("links").filter(F.col("post_id").isin(ids))
    # Only the page's tags are held against the authors, and only names among them are looked up.
    tags = store.read("tags").join(F.broadcast(links.select(F.col("tag_id").alias("id")).distinct()), "id", "left_semi")
    lists = tag_ops.tag_lists(links, tag_ops.hide_author_tags(tags, store.authors(published_only)))
    rows = wide.select(*pages.PAGE_COLUMNS, "published", "photo_bytes", "video_bytes")
    return rows.join(lists.withColumnRenamed("post_id", "id"), "id", "left").orderBy(*order)


def _result(store: PageStore, found: list, order: list[Column], limit: int, published: int, published_only: bool) -> pages.Page:
    shown = found[:limit]
    more = len(found) > limit
    key = (pages._micros_text(shown[-1]["at"]), shown[-1]["id"]) if more and shown and shown[-1]["at"] is not None else None
    return pages.Page(_page(store, shown, order, published, published_only), more, key, showing_end=len(shown))


def _time_page(store: PageStore, select: Callable[[DataFrame], DataFrame], sort: str, after: pages.PageKey | None, offset: int, limit: int, measure: str | None) -> pages.Page:
    order = pages.time_order(sort)
    zones = _spans(store, 1, sort == "oldest", after)
    rows_in = lambda spans: select(store.read("posts").filter((F.col("published") == 1) & F.col("span").isin(spans)))
    found, _ = _find(rows_in, zones, order, offset + limit + 1, measure, after is not None)
    return _result(store, found[offset:], order, limit, 1, True)


def feed_page(
    store: PageStore,
    *,
    sort: str = "newest",
    media: str = "all",
    tag: str | None = None,
    author: str | None = None,
    after: pages.PageKey | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> pages.Page:
    """`pages.feed_page` of the stored version."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    links, tags = store.read("links"), store.read("tags")
    select = lambda posts: pages.feed_rows(posts, links, tags, sort=sort, media=media, tag=tag, author=author, after=after)
    counted = {"all": "rows", "photo": "feed_photo", "video": "feed_video"}.get(media)
    measure = None if tag or author else counted
    return _time_page(store, select, sort, after, 0 if after else offset, pages.feed_limit(limit), measure)


def search_page(store: PageStore, *, sort: str = "newest", after: pages.PageKey | None = None, offset: int = 0, limit: int | None = None, **criteria) -> pages.Page:
    """`pages.search_page` of the stored version."""
    sort = "oldest" if sort == "oldest" else "newest"
    links, tags = store.read("links"), store.read("tags")
    select = lambda posts: pages.search_rows(posts, links, tags, sort=sort, after=after, **criteria)
    measure = None if any(criteria.values()) else "rows"
    return _time_page(store, select, sort, after, 0 if after else max(0, offset), pages.search_limit(limit), measure)


def _by_size(rows_in: Callable[[list[str]], DataFrame], zones: list, order: list[Column], need: int) -> list:
    """Largest rows first: spans in the order of their largest row, until no other one can hold a row of the page."""
    zones = sorted(zones, key=lambda z: z["most_bytes"] or 0, reverse=True)
    found: list = []
    at, width = 0, 1
    size = pages.total_bytes().alias("size")
    while at < len(zones) and (len(found) < need or found[-1]["size"] <= (zones[at]["most_bytes"] or 0)):
        window = [z["span"] for z in zones[at : at + width]]
        rows = rows_in(window).orderBy(*order).limit(need).select("id", F.unix_micros("created_at").alias("at"), "span", size).collect()
        found = sorted(found + rows, key=lambda r: (r["size"], r["at"] is not None, r["at"] or 0, r["id"]), reverse=True)[:need]
        at, width = at + width, width * 2
    return found


def admin_page(store: PageStore, *, sort: str = "newest", offset: int = 0, limit: int | None = None, **criteria) -> pages.Page:
    """`pages.admin_page` of the stored version.

    Totals of one state, with or without a media filter, are sums over the zones; other filters are counted over the state's
    folders.  Largest posts are found by the zones' largest rows.
    """
    published = criteria.get("published", 1)
    media, ready = criteria.get("media", ""), criteria.get("counts_ready", True)
    links, tags = store.read("links"), store.read("tags")
    select = lambda posts: pages.admin_rows(posts, links, tags, **criteria)
    state = store.read("posts").filter(F.col("published") == published)
    zones = _spans(store, published, sort == "oldest", None)
    counted = {"photo": "admin_photo", "video": "admin_video"}.get(media, "rows")
    plain = not any(criteria.get(name) for name in ("search", "author", "tag")) and (ready or media not in ("photo", "video"))
    total = sum(z[counted] for z in zones) if plain else select(state).count()
    offset, size = max(0, offset), pages.admin_limit(limit)
    order = pages.admin_order(sort)
    rows_in = lambda spans: select(state.filter(F.col("span").isin(spans)))
    if sort == "size_desc":
        found = _by_size(rows_in, zones, order, offset + size)
    elif sort == "size_asc":
        found = select(state).orderBy(*order).limit(offset + size).select("id", F.unix_micros("created_at").alias("at"), "span").collect()
    else:
        found, _ = _find(rows_in, zones, order, offset + size, counted if plain else None)
    shown = found[offset:]
    end = offset + len(shown)
    return pages.Page(_page(store, shown, order, published, False), end < total, None, total, offset + 1 if total > 0 else 0, end)

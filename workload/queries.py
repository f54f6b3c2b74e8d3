"""Registered queries: each name has a Spark function and, where SQL can say it, a check.

Every query runs over whole tables.  `@query` records both; results are brought to
plain types (64-bit integers, text timestamps) so that both engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions import accounts as account_fn
from shutterlake.functions import capacity, media, times
from shutterlake.operators import accounts, audits, dedup, filters, overview, tagging
from shutterlake.operators import tags as tag_ops
from shutterlake.plans import pages, stored_pages
from workload.views import NOW, NOW_TEXT, SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as 64 bit, timestamps as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, times.TEXT_FORMAT)
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of `Views`; `sql` continues the WITH list of the views."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{sql}"
        return fn

    return register


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(c: str) -> str:
    return FOLD.format(c)


# --- feed -------------------------------------------------------------------------

FEED_COLUMNS = ("id", "author", "likes", "created_at", "tags_list")


def page_sql(where: str, order: str, limit: int, offset: int = 0, visible: str = "visible", extra: str = "") -> str:
    return f""",
page AS (SELECT i.id FROM posts i WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset})
SELECT i.id, i.author, i.likes, {stamp("i.created_at")} AS created_at, v.tags_list{extra}
FROM page p JOIN posts i ON i.id = p.id LEFT JOIN {visible} v ON v.post_id = i.id"""


NEWEST, OLDEST = "i.created_at DESC, i.id DESC", "i.created_at, i.id"
TAGGED = "i.id IN (SELECT pt.post_id FROM post_tags pt JOIN tags t ON t.id = pt.tag_id WHERE {})"


def feed(v: Views, **criteria) -> DataFrame:
    return stored_pages.feed_page(v.store(), **criteria).items.select(*FEED_COLUMNS)


query("feed_newest", page_sql("i.published = 1", NEWEST, 48))(lambda v: feed(v))
query("feed_oldest", page_sql("i.published = 1", OLDEST, 48))(lambda v: feed(v, sort="oldest"))
query("feed_tag", page_sql("i.published = 1 AND " + TAGGED.format("t.name = 'Voices'"), NEWEST, 48))(
    lambda v: feed(v, tag="Voices", author="ignored")
)
query("feed_author", page_sql("i.published = 1 AND i.author = 'src3'", NEWEST, 24))(
    lambda v: feed(v, author="src3", limit=24)
)
query("feed_photo", page_sql("i.published = 1 AND i.photo_count > 0", NEWEST, 48))(lambda v: feed(v, media="photo"))
query("feed_video", page_sql("i.published = 1 AND i.video_count > 0", OLDEST, 48))(
    lambda v: feed(v, media="video", sort="oldest")
)
_AFTER = "TIMESTAMP '2024-01-03 10:00:00'"
query(
    "feed_keyset",
    page_sql(
        f"i.published = 1 AND (i.created_at < {_AFTER} OR (i.created_at = {_AFTER} AND i.id < 500))", NEWEST, 24
    ),
)(lambda v: feed(v, after=("2024-01-03 10:00:00", 500), limit=24))
query(
    "feed_keyset_oldest",
    page_sql(
        f"i.published = 1 AND (i.created_at > {_AFTER} OR (i.created_at = {_AFTER} AND i.id > 500))", OLDEST, 48
    ),
)(lambda v: feed(v, after=("2024-01-03 10:00:00", 500), sort="oldest"))
query("feed_offset", page_sql("i.published = 1", NEWEST, 24, 100))(lambda v: feed(v, offset=100, limit=24))
query(
    "feed_page_index",
    f""",
ranked AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM posts WHERE published = 1)
SELECT CAST(ceil(rn / 48.0) AS BIGINT) AS page, count(*) AS n_posts, {stamp("arg_max(created_at, rn)")} AS last_created_at,
  arg_max(id, rn) AS last_id FROM ranked GROUP BY 1""",
)(lambda v: pages.feed_index(v.posts()))
query(
    "feed_top_per_author",
    f""",
ranked AS (SELECT author, id, {stamp("created_at")} AS created_at,
  row_number() OVER (PARTITION BY author ORDER BY posts.created_at DESC, id DESC) AS rank FROM posts WHERE published = 1)
SELECT * FROM ranked WHERE rank <= 5""",
)(lambda v: pages.newest_per(v.posts(), "author", 5))
query(
    "post_cards",
    """
SELECT p.id, coalesce((SELECT key FROM media m WHERE m.id = p.id AND m.pos = 0), '') AS first_key, p.n_media,
  p.photo_count > 0 AS has_photo, p.video_count > 0 AS has_video,
  CASE WHEN p.n_media = 0 THEN 'none' WHEN (SELECT video FROM media m WHERE m.id = p.id AND m.pos = 0) THEN 'video' ELSE 'photo' END AS cover,
  strftime(coalesce(p.updated_at, p.created_at), '%Y/%m/%d') AS shown_date
FROM posts p""",
)(
    lambda v: v.posts()
    .withColumns({**media.card_columns("media_keys"), "shown_date": times.display_date("updated_at", "created_at")})
    .select("id", "first_key", "n_media", "has_photo", "has_video", "cover", "shown_date")
)

# --- search and admin -------------------------------------------------------------


def search(v: Views, **criteria) -> DataFrame:
    return stored_pages.search_page(v.store(), **criteria).items.select(*FEED_COLUMNS)


def like_sql(needle: str, *columns: str) -> str:
    return "(" + " OR ".join(f"coalesce({fold(c)} LIKE '%{needle}%', false)" for c in columns) + ")"


_TEXT = ("i.title", "i.description", "i.author", "i.author_display_name")


def keyword_sql(needle: str) -> str:
    return "(" + like_sql(needle, *_TEXT) + " OR " + TAGGED.format(f"{fold('t.name')} LIKE '%{needle}%'") + ")"


query("search_keyword", page_sql(f"i.published = 1 AND {keyword_sql('tion% th_re')}", NEWEST, 48))(
    lambda v: search(v, q="Tion% tH_re")
)
query("search_keyword_tag", page_sql(f"i.published = 1 AND {keyword_sql('shor')}", OLDEST, 96))(
    lambda v: search(v, q="SHOR", sort="oldest", limit=500)
)
query(
    "search_tag_work",
    page_sql(
        f"i.published = 1 AND {TAGGED.format(fold('t.name') + chr(61) + chr(39) + 'voices' + chr(39))}"
        f" AND {TAGGED.format(fold('t.name') + chr(61) + chr(39) + 'fr' + chr(39))}",
        NEWEST,
        48,
    ),
)(lambda v: search(v, tag="VOICES", work="Fr"))
query("search_author_nocase", page_sql(f"i.published = 1 AND {fold('i.author')} = 'src7'", NEWEST, 48, 3))(
    lambda v: search(v, author="@SrC7", offset=3)
)


def admin(v: Views, **criteria) -> DataFrame:
    page = stored_pages.admin_page(v.store(), **criteria)
    facts = {"total": page.total, "first": page.showing_start, "last": page.showing_end, "more": page.has_more}
    return page.items.select(*FEED_COLUMNS).withColumns({k: F.lit(x) for k, x in facts.items()})


def admin_sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    total = f"(SELECT count(*) FROM posts i WHERE {where})"
    extra = (
        f", {total} AS total, CASE WHEN {total} > 0 THEN CAST({offset + 1} AS BIGINT) ELSE 0 END AS first,"
        f" {offset} + (SELECT count(*) FROM page) AS last, {offset} + (SELECT count(*) FROM page) < {total} AS more"
    )
    return page_sql(where, order, limit, offset, "visible_admin", extra)


_SIZE = "(coalesce(i.photo_bytes, 0) + coalesce(i.video_bytes, 0))"
_ADMIN_TEXT = ("i.title", "i.author", "i.description", "i.author_display_name")
query(
    "admin_posts",
    admin_sql(
        f"i.published = 1 AND i.photo_count > 0 AND i.video_count = 0 AND {like_sql('then', *_ADMIN_TEXT)}", NEWEST, 10
    ),
)(lambda v: admin(v, search=" Then ", media="photo"))
query("admin_size_desc", admin_sql("i.published = 1", f"{_SIZE} DESC, {NEWEST}", 100, 20))(
    lambda v: admin(v, sort="size_desc", limit=500, offset=20)
)
query("admin_size_asc", admin_sql("i.published = 1 AND i.video_count > 0", f"{_SIZE}, {NEWEST}", 50))(
    lambda v: admin(v, sort="size_asc", media="video", limit=50)
)
query("admin_pending", admin_sql("i.published = 0 AND " + TAGGED.format("t.name = 'en'"), OLDEST, 25))(
    lambda v: admin(v, published=0, tag="en", sort="oldest", limit=25)
)
query(
    "admin_media_from_keys",
    admin_sql("i.published = 1 AND i.video_count > 0 AND lower(i.author) = 'src5'", NEWEST, 100),
)(lambda v: admin(v, media="video", author="Src5", counts_ready=False, limit=100))

# --- statistics -------------------------------------------------------------------

_MEASURES = """count(*) AS posts, count(*) FILTER (WHERE published = 1) AS published, {pending} AS pending,
  CAST(sum(photo_count) AS BIGINT) AS photos, CAST(sum(video_count) AS BIGINT) AS videos,
  CAST(sum(photo_bytes) AS BIGINT) AS photo_bytes, CAST(sum(video_bytes) AS BIGINT) AS video_bytes"""
_BY_STATE = _MEASURES.format(pending="count(*) FILTER (WHERE published = 0)")
query(
    "author_overview_rollup",
    f"""
SELECT author, CAST(grouping(author) AS BIGINT) AS is_total,
  CASE WHEN grouping(author) = 0 THEN nullif(max(author_display_name), '') END AS author_display_name,
  {_BY_STATE} FROM posts GROUP BY ROLLUP (author)""",
)(lambda v: overview.author_overview(v.posts()))
query(
    "overview_from_keys",
    f"""
SELECT author, arg_min(author_display_name, id) FILTER (WHERE author_display_name <> '') AS author_display_name,
  {_MEASURES.format(pending="count(*) FILTER (WHERE published <> 1)")} FROM posts GROUP BY author""",
)(lambda v: overview.overview_from_keys(v.posts()))
query(
    "author_bytes",
    """
SELECT author, CAST(sum(photo_bytes) AS BIGINT) AS photo_bytes, CAST(sum(video_bytes) AS BIGINT) AS video_bytes,
  CAST(sum(photo_bytes) + sum(video_bytes) AS BIGINT) AS total_bytes FROM posts GROUP BY author""",
)(lambda v: overview.author_bytes(overview.author_overview(v.posts())))
query("directory_authors", " SELECT DISTINCT author FROM posts WHERE published = 1")(
    lambda v: overview.published_authors(v.posts())
)
query(
    "directory_all_authors",
    " SELECT author, max(author_display_name) AS author_display_name FROM posts GROUP BY author",
)(lambda v: overview.all_authors(v.posts()))
query("directory_tags", " SELECT id, name FROM tags")(lambda v: tag_ops.tag_table(v.tags()))
query("orphan_tags", " SELECT id, name FROM tags WHERE id NOT IN (SELECT tag_id FROM post_tags)")(
    lambda v: tag_ops.orphan_tags(v.tags(), v.post_tags())
)
query(
    "hidden_author_tags",
    " SELECT id, name FROM tags WHERE lower(trim(name)) NOT IN (SELECT lower(author) FROM posts)",
)(lambda v: tag_ops.hide_author_tags(v.tags(), tag_ops.author_set(v.posts(), False)))
query(
    "storage_usage",
    """,
total AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS b FROM objects)
SELECT b AS total_bytes, CAST(10000000000 AS BIGINT) AS limit_bytes, greatest(0, 10000000000 - b) AS remaining_bytes,
  floor(least(100.0, b / 10000000000.0::DOUBLE * 100) * 10 + 0.5) / 10.0::DOUBLE AS percent FROM total""",
)(lambda v: overview.storage_usage(v.objects()))
query(
    "upload_admission",
    """,
both_sums AS (SELECT CAST((SELECT sum(size) FROM objects) AS BIGINT) AS total_bytes,
  CAST((SELECT coalesce(sum(CAST(l_quantity AS BIGINT) * 1000), 0) FROM lineitem) AS BIGINT) AS incoming_bytes)
SELECT total_bytes, incoming_bytes, total_bytes + incoming_bytes >= 9500000000 AS rejected FROM both_sums""",
)(
    lambda v: overview.admit_upload(
        v.objects(), v.table("lineitem").select((F.col("l_quantity").cast("long") * 1000).alias("size"))
    )
)
query("account_totals", " SELECT count(*) AS accounts, count(*) FILTER (WHERE enabled = 1) AS enabled_accounts FROM accounts")(
    lambda v: overview.account_totals(v.accounts())
)
query(
    "pending_expiry",
    f"""
SELECT id, CAST(ceil((epoch_us(created_at) + 259200000000 - epoch_us(TIMESTAMP '{NOW_TEXT}')) / 3600000000.0) AS BIGINT) AS hours_left,
  ceil((epoch_us(created_at) + 259200000000 - epoch_us(TIMESTAMP '{NOW_TEXT}')) / 3600000000.0) < 24 AS critical
FROM posts WHERE published = 0""",
)(
    lambda v: v.posts()
    .filter("published = 0")
    .select(
        "id",
        times.hours_left("created_at", NOW).alias("hours_left"),
        times.expiry_critical("created_at", NOW).alias("critical"),
    )
)
query(
    "run_freshness",
    """
SELECT count(*) FILTER (WHERE event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-02 01:00:00') > 0 AS recent,
  count(*) FILTER (WHERE event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-02 01:00:00') AS runs
FROM events""",
)(
    lambda v: filters.recent_run(
        v.table("events").select(F.col("event_type").alias("event"), F.col("ts").alias("created_at")),
        "signup",
        datetime(2024, 1, 2, 1),
    )
)

# --- column jobs ------------------------------------------------------------------

query(
    "media_explode_counts",
    """
SELECT regexp_extract(lower(key), '\\.[a-z0-9]+\\z') AS ext,
  CASE regexp_extract(lower(key), '\\.[a-z0-9]+\\z') WHEN '.png' THEN 'image/png' WHEN '.webp' THEN 'image/webp' WHEN '.mp4' THEN 'video/mp4'
    WHEN '.webm' THEN 'video/webm' ELSE 'image/jpeg' END AS content_type,
  count(*) FILTER (WHERE video) AS videos, count(*) FILTER (WHERE NOT video) AS photos, count(DISTINCT id) AS n_posts
FROM media GROUP BY 1, 2""",
)(
    lambda v: dedup.media_rows(
        v.posts().withColumn("media_keys", media.split_keys(F.array_join("media_keys", " , ")))
    )
    .groupBy(media.extension("key").alias("ext"), media.content_type("key").alias("content_type"))
    .agg(
        F.count_if(media.is_video("key")).alias("videos"),
        F.count_if(~media.is_video("key")).alias("photos"),
        F.count_distinct("id").alias("n_posts"),
    )
)
query(
    "canonical_timestamps",
    f"""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1970-01-01 00:00:00' ELSE {stamp("o_orderdate")} END AS created_at FROM orders""",
)(
    lambda v: v.table("orders").select(
        "o_orderkey",
        times.canonical_timestamp(
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("not a date "), "o_orderpriority"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        ).alias("created_at"),
    )
)
query(
    "author_cleanup",
    """,
raw AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '　 ' || c_mktsegment || ' ' END AS nick,
  CASE WHEN c_acctbal < 0 THEN ' @@ ' ELSE ' @@' || c_name || ' ' END AS handle, c_acctbal, c_name FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS handle,
  CASE WHEN c_acctbal < 0 THEN coalesce(trim(nick, '　 '), '') ELSE coalesce(trim(nick, '　 '), '') || '@' || c_name END AS label,
  lower(trim(coalesce(trim(nick, '　 '), '') || ' ' || CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END)) AS search_text
FROM raw""",
)(
    lambda v: v.table("customer")
    .select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("　 "), "c_mktsegment", F.lit(" "))).alias("nick"),
        F.when(F.col("c_acctbal") < 0, " @@ ")
        .otherwise(F.concat(F.lit(" @@"), "c_name", F.lit(" ")))
        .alias("raw"),
    )
    .select(
        "c_custkey",
        account_fn.author_handle("raw").alias("handle"),
        account_fn.author_label("nick", "raw").alias("label"),
        account_fn.author_search_text("nick", "raw").alias("search_text"),
    )
)
query(
    "account_cleanup",
    """,
raw AS (SELECT url, regexp_extract(url, '^https?://[^/?#\\s]+/+([^/?#]+)', 1) AS seg FROM pages
  UNION ALL SELECT '@' || c_name, c_name FROM customer)
SELECT url, lower(CASE WHEN seg = '' THEN url ELSE seg END) AS account FROM raw""",
)(
    lambda v: v.table("pages")
    .select("url")
    .unionByName(v.table("customer").select(F.concat(F.lit("@"), "c_name").alias("url")))
    .select("url", account_fn.account_name("url").alias("account"))
)
query(
    "media_url_parts",
    """,
urls AS (SELECT url, type FROM timeline UNION ALL SELECT url, 'photo' FROM pages)
SELECT regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#\\s]+([^?#]*)', 1), '([^/]*)/*\\z', 1), '\\.[a-zA-Z0-9]+\\z', '') AS media_id,
  CASE WHEN type <> 'photo' THEN '.mp4' WHEN url LIKE '%?format=png' THEN '.png' WHEN url LIKE '%.html%' THEN '.html' ELSE '.jpg' END AS ext, count(*) AS n
FROM urls GROUP BY 1, 2""",
)(
    lambda v: v.timeline()
    .select("url", "type")
    .unionByName(v.table("pages").select("url", F.lit("photo").alias("type")))
    .groupBy(media.media_id("url").alias("media_id"), media.item_extension("type", "url").alias("ext"))
    .agg(F.count(F.lit(1)).alias("n"))
)
query(
    "object_keys",
    """
SELECT p_partkey, p_brand || '_' || regexp_replace(p_name || ' #' || p_size || '.JPG', '[^a-zA-Z0-9._-]', '_', 'g') AS key FROM part""",
)(
    lambda v: v.table("part").select(
        "p_partkey",
        media.object_key("p_brand", F.concat("p_name", F.lit(" #"), "p_size", F.lit(".JPG"))).alias("key"),
    )
)
query(
    "manual_tags",
    """,
raw AS (SELECT p_partkey, unnest(regexp_split_to_array(p_type || ', #' || p_brand || '  ' || p_name || ',' || p_type, '[\\s,]+')) AS t FROM part)
SELECT DISTINCT p_partkey, regexp_replace(t, '^#', '') AS tag FROM raw WHERE t <> ''""",
)(
    lambda v: v.table("part").select(
        "p_partkey",
        F.explode(
            tagging.manual_tags(F.concat("p_type", F.lit(", #"), "p_brand", F.lit("  "), "p_name", F.lit(","), "p_type"))
        ).alias("tag"),
    )
)
query(
    "status_ids",
    " SELECT id, regexp_extract(post_url, '/status/([0-9]+)', 1) AS status_id FROM posts",
)(lambda v: v.posts().filter(filters.has_status_link()).select("id", media.status_id("post_url").alias("status_id")))
query(
    "byte_sizes",
    """,
t AS (SELECT author, CAST(sum(photo_bytes) + sum(video_bytes) AS BIGINT) AS b FROM posts GROUP BY author)
SELECT author, b AS total_bytes, CASE WHEN b < 1000 THEN 'B' WHEN b < 1000000 THEN 'KB' WHEN b < 1000000000 THEN 'MB'
  WHEN b < 1000000000000 THEN 'GB' ELSE 'TB' END AS unit FROM t""",
)(
    lambda v: overview.author_bytes(overview.author_overview(v.posts())).select(
        "author", "total_bytes", F.split(capacity.format_bytes("total_bytes"), " ")[1].alias("unit")
    )
)

# --- audits -----------------------------------------------------------------------


def _crawl_output(v: Views) -> DataFrame:
    head = F.when(F.col("o_orderstatus") == "P", "INFO start\n").otherwise("")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Error: Rate Limit reached")
        .when(F.col("o_orderpriority") == "2-HIGH", " some Exception: HTTP ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Unauthorized ")
        .otherwise("status ")
    )
    tail = F.col("o_totalprice").cast("long").cast("string")
    return v.table("orders").select("o_orderkey", "o_custkey", F.concat(head, text, tail).alias("output"))


_OUTPUT = """,
outputs AS (SELECT o_orderkey, o_custkey, (CASE WHEN o_orderstatus = 'P' THEN 'INFO start' || chr(10) ELSE '' END) ||
  (CASE o_orderpriority WHEN '1-URGENT' THEN 'Error: Rate Limit reached' WHEN '2-HIGH' THEN ' some Exception: HTTP '
    WHEN '3-MEDIUM' THEN 'Unauthorized ' ELSE 'status ' END) || CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS output FROM orders)"""
query(
    "crawl_error_classes",
    _OUTPUT
    + """
SELECT o_orderkey, CASE WHEN contains(lower(output), 'rate limit') OR contains(output, '429') THEN 'rate_limit'
    WHEN contains(output, '401') OR contains(lower(output), 'unauthorized') THEN 'unauthorized'
    WHEN contains(output, '404') THEN 'not_found' WHEN contains(output, '403') THEN 'protected' ELSE 'other' END AS class,
  CASE WHEN lower(output) LIKE '%error:%' OR lower(output) LIKE '%exception%'
    THEN trim(regexp_replace(output, '^INFO start\\n', '')) ELSE output END AS line FROM outputs""",
)(
    lambda v: _crawl_output(v).select(
        "o_orderkey",
        audits.crawl_error_class("output").alias("class"),
        audits.crawl_error_line("output").alias("line"),
    )
)


def _crawl_results(v: Views) -> DataFrame:
    o = v.table("orders")
    return o.select(
        F.concat(F.lit("@Customer#"), F.lpad("o_custkey", 9, "0")).alias("username"),
        F.when(F.col("o_orderstatus") == "P", "manual").otherwise("cron").alias("run_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "all").otherwise("latest").alias("crawl_mode"),
        (F.col("o_totalprice").cast("long") - 100000).alias("new_images"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" failed "), "o_orderpriority")).alias("error"),
        F.col("o_orderdate").cast("timestamp").alias("finished_at"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )


_RESULTS = """,
results AS (SELECT 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k, o_orderdate, o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN 'manual' ELSE 'auto' END AS type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'all' ELSE 'latest' END AS mode,
  CAST(greatest(0, trunc(o_totalprice) - 100000) AS BIGINT) AS n,
  CASE WHEN o_orderstatus = 'F' THEN 'failed ' || o_orderpriority END AS error,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
merged AS (SELECT a.id, a.username, r.o_orderdate, r.type, r.mode, coalesce(r.n, 0) AS n, r.error,
  CASE WHEN EXISTS (SELECT 1 FROM results f WHERE f.k = lower(a.username) AND f.mode = 'all' AND f.error IS NULL)
    THEN 0 ELSE a.crawl_all END AS crawl_all
  FROM accounts a LEFT JOIN results r ON r.k = lower(a.username) AND r.back = 1)"""
query(
    "crawl_result_merge",
    _RESULTS
    + f"""
SELECT id, {stamp("o_orderdate")} AS last_crawled_at, type AS last_crawl_type, mode AS last_crawl_mode, n AS last_crawl_count,
  error AS last_crawl_error, CAST(crawl_all AS BIGINT) AS crawl_all FROM merged""",
)(
    lambda v: accounts.merge_crawl_results(v.accounts(), _crawl_results(v)).select(
        "id",
        "last_crawled_at",
        "last_crawl_type",
        "last_crawl_mode",
        "last_crawl_count",
        "last_crawl_error",
        "crawl_all",
    )
)
query(
    "account_texts",
    _RESULTS
    + """
SELECT id, coalesce('on ' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) || ' ' || type || ' crawl, ' ||
  CASE mode WHEN 'all' THEN 'full history' ELSE 'latest' END || ' (+' || n || ')', '') AS last_crawl_text,
  coalesce(error, '') AS last_crawl_error FROM merged""",
)(
    lambda v: audits.last_crawl_text(accounts.merge_crawl_results(v.accounts(), _crawl_results(v))).select(
        "id", "last_crawl_text", "last_crawl_error"
    )
)


def _probes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(
        (F.max("l_discount") < 0.1).alias("is_valid"),
        F.sum("l_quantity").alias("duration"),
        F.when(F.max("l_linestatus") == "O", "h264").otherwise("hevc").alias("codec"),
        F.sum(F.col("l_partkey")).alias("size"),
    )


_PROBE = """SELECT l_orderkey AS key, max(l_discount) < 0.1 AS is_valid, sum(l_quantity) AS duration,
  CASE WHEN max(l_linestatus) = 'O' THEN 'h264' ELSE 'hevc' END AS codec, CAST(sum(l_partkey) AS BIGINT) AS size FROM lineitem"""
query(
    "transcode_audit",
    f""",
o AS ({_PROBE} GROUP BY 1), n AS ({_PROBE} WHERE l_returnflag <> 'A' GROUP BY 1),
j AS (SELECT o.key, o.size, n.size AS new_size, CASE WHEN n.size IS NULL THEN 'no output' WHEN NOT n.is_valid THEN 'invalid output'
    WHEN n.codec <> 'h264' THEN 'wrong codec' WHEN n.size < 1024 THEN 'output too small'
    WHEN o.duration > 0 AND abs(n.duration - o.duration) > greatest(1.5, o.duration * 0.05) THEN 'duration differs'
    WHEN n.size > o.size * 0.85 THEN 'too little saved' END AS reason FROM o LEFT JOIN n USING (key))
SELECT key, reason, reason IS NULL AS accepted, CASE WHEN reason IS NULL THEN size - new_size ELSE 0 END AS saved_bytes FROM j""",
)(
    lambda v: audits.transcode_audit(
        _probes(v.table("lineitem")), _probes(v.table("lineitem").filter("l_returnflag <> 'A'"))
    ).select("key", "reason", "accepted", "saved_bytes")
)


def _detections(v: Views) -> DataFrame:
    """One detection per stored image; its label and score come from the vector."""
    rows = v.table("embeddings").select("vec_id", F.col("label").alias("class"), F.col("embedding")[0].alias("x"))
    return rows.select(
        (F.floor(F.col("vec_id") / 2) + 1).cast("long").alias("post_id"),
        F.concat(F.lit("e"), "vec_id", F.when(F.col("class") == 1, ".mp4").otherwise(".jpg")).alias("key"),
        F.when(F.col("class") < 4, "person").otherwise("cat").alias("label"),
        (F.col("x") + 0.6).alias("score"),
        F.when(F.col("class") == 2, " no.").when(F.col("class") == 3, "YES").alias("answer"),
    )


_VERDICTS = """,
judged AS (SELECT vec_id // 2 + 1 AS post_id, label, 'e' || vec_id || CASE WHEN label = 1 THEN '.mp4' ELSE '.jpg' END AS key,
  label < 4 AND CAST(embedding[1] AS DOUBLE) + 0.6 >= 0.5 AND label <> 2 AS passes FROM embeddings)"""


def _image_verdicts(v: Views) -> DataFrame:
    detections = _detections(v)
    seen = audits.person_seen(detections)
    answers = detections.select("post_id", "key", "answer")
    joined = seen.join(answers, ["post_id", "key"])
    return joined.select("post_id", "key", audits.image_passes("has_person", "answer").alias("passes"))


query("image_verdicts", _VERDICTS + " SELECT post_id, key, passes FROM judged")(_image_verdicts)
query(
    "post_verdicts",
    _VERDICTS
    + """
SELECT post_id, count(*) FILTER (WHERE label <> 1 AND NOT passes) = 0 AS publish,
  CASE WHEN count(*) FILTER (WHERE label <> 1) = 0 THEN 'video-only post'
    ELSE coalesce(string_agg(key || ': non-portrait', ' ' ORDER BY key) FILTER (WHERE label <> 1 AND NOT passes), '') END AS reasons
FROM judged GROUP BY post_id""",
)(
    lambda v: audits.post_verdicts(_detections(v).select("post_id", "key"), _image_verdicts(v)).select(
        "post_id", "publish", F.array_join("reasons", " ").alias("reasons")
    )
)

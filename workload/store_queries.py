"""Registered queries of tables in the shared folder, id ranges, account flags and page probes."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import hashing
from shutterlake.operators import changes, filters, ingest, overview
from shutterlake.plans import near_duplicates, pages
from shutterlake.plans.overview import directory, known_total, stored_overview
from shutterlake.schema import POST_TAGS, POSTS, TAGS
from shutterlake.session import fresh_path, materialise
from shutterlake.sources import folder_import, tables
from shutterlake.sources import timeline as timeline_source
from shutterlake.sources.catalogue_store import BUCKETS, CatalogueStore
from shutterlake.sources.snapshots import Snapshots
from workload.change_queries import NOW, _feed, _fetched, _ingest_rules, _ingest_state, drawn_cells
from workload.queries import ORACLES, query, stamp
from workload.views import Views

query("id_range", " SELECT id, author FROM posts WHERE id > 100 AND id <= 700")(
    lambda v: v.posts().filter(filters.id_range(100, 700)).select("id", "author")
)
query("id_range_open", " SELECT id FROM posts WHERE id > 500")(lambda v: v.posts().filter(filters.id_range(500)).select("id"))
query(
    "crawl_accounts",
    " SELECT username, coalesce(crawl_all = 1, false) AS full_history FROM accounts WHERE coalesce(enabled, 0) <> 0",
)(lambda v: filters.enabled_accounts(v.accounts()).select("username", "full_history"))
query(
    "overview_sorted",
    """
SELECT author, CAST(sum(photo_bytes) AS BIGINT) AS photo_bytes, CAST(row_number() OVER (ORDER BY sum(photo_bytes) DESC, author) AS BIGINT) AS place
FROM posts GROUP BY author ORDER BY place LIMIT 12""",
)(lambda v: _places(overview.sort_overview(overview.author_overview(v.posts()), "photo_bytes"), 12))


def _places(ordered: DataFrame, n: int) -> DataFrame:
    """The first authors of a sorted overview with their places (a report of n rows)."""
    rows = ordered.select("author", "photo_bytes").limit(n).collect()
    numbered = [(r["author"], r["photo_bytes"], k) for k, r in enumerate(rows, 1)]
    return ordered.sparkSession.createDataFrame(numbered, "author string, photo_bytes long, place long")


PROBE = f""",
ranked AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM posts WHERE published = 1)
SELECT (SELECT count(*) FROM ranked) > 24 AS has_more, {stamp("created_at")} AS next_at, id AS next_id FROM ranked WHERE rn = 24"""


def _probe(v: Views) -> DataFrame:
    """[T4] What a page says about the next one."""
    page = pages.feed_page(*v.feed(), limit=24)
    at, last = page.next_key
    return v.spark.createDataFrame([(page.has_more, at[:19], last)], "has_more boolean, next_at string, next_id long")


query("feed_probe", PROBE)(_probe)


def _stored(v: Views) -> tuple[Snapshots, str]:
    """A store in the shared folder with the catalogue as its first version."""
    root = fresh_path(v.spark, "store")
    store = Snapshots(v.spark, root, {"posts": POSTS, "tags": TAGS, "post_tags": POST_TAGS})
    store.publish({"posts": v.posts(), "tags": v.tags(), "post_tags": v.post_tags()}, 0)
    return store, root


def _catalogue_read(v: Views) -> DataFrame:
    _, root = _stored(v)
    posts = tables.read_table(v.spark, f"{root}/v=0", "posts")
    return posts.select("id", "author", "likes", F.array_join("media_keys", ",").alias("media_keys"))


query("catalogue_read", " SELECT id, author, CAST(likes AS BIGINT) AS likes, media_keys FROM posts")(_catalogue_read)


def _publish_changed(v: Views) -> DataFrame:
    """[S8] No change gives no version; a change gives one, and the old one stays as it was."""
    store, _ = _stored(v)
    posts, tags, links = (store.read(t) for t in ("posts", "tags", "post_tags"))
    none, some = posts.filter("likes < 0"), posts.filter("likes > 50")
    store.publish_if_changed({"posts": posts, "tags": tags, "post_tags": links}, none)
    fewer = {"posts": posts.filter("likes <= 50"), "tags": tags, "post_tags": links}
    now = store.publish_if_changed(fewer, some)
    return store.read("posts").select("id", F.lit(now).alias("version")).unionByName(store.read("posts", 0).select("id", F.lit(0).alias("version")))


query(
    "publish_changed",
    " SELECT id, CAST(1 AS BIGINT) AS version FROM posts WHERE likes <= 50 UNION ALL SELECT id, CAST(0 AS BIGINT) FROM posts",
)(_publish_changed)


def _publish_touched(v: Views) -> DataFrame:
    """[S8, M3, M5] Posts after two changes, their links and assets, and the version whose folder holds each."""
    store = CatalogueStore(v.spark, fresh_path(v.spark, "catalogue-store"))
    store.load(v.catalogue())
    gone = v.table("labels").filter("toxic = 1").select((F.col("doc_id") + 1).alias("id"))
    store.rewrite(gone, lambda cat: changes.delete_posts(cat, gone))
    waiting = store.read("posts").filter("published = 0 AND likes > 80").select("id")
    store.rewrite(waiting, lambda cat: cat._replace(posts=changes.approve(cat.posts, waiting)))

    def per_post(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    held = F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/posts/", 1).cast("long").alias("held_in")
    posts = store.read("posts").select("id", "published", held)
    joined = posts.join(per_post(store.read("post_tags"), "n_tags"), "id", "left").join(per_post(store.read("assets"), "n_assets"), "id", "left")
    return joined.select("id", "published", "held_in", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tags", "n_assets")])


query(
    "publish_touched",
    f""",
gone AS (SELECT doc_id + 1 AS id FROM labels WHERE toxic = 1),
waiting AS (SELECT id FROM posts WHERE published = 0 AND likes > 80 AND id NOT IN (SELECT id FROM gone)),
links AS (SELECT post_id, count(*) AS n FROM post_tags GROUP BY 1),
held AS (SELECT post_id, count(*) AS n FROM assets GROUP BY 1)
SELECT p.id, CAST(CASE WHEN w.id IS NOT NULL THEN 1 ELSE p.published END AS BIGINT) AS published,
  CAST(CASE WHEN p.id % {BUCKETS} IN (SELECT id % {BUCKETS} FROM waiting) THEN 2
    WHEN p.id % {BUCKETS} IN (SELECT id % {BUCKETS} FROM gone) THEN 1 ELSE 0 END AS BIGINT) AS held_in,
  coalesce(l.n, 0) AS n_tags, coalesce(h.n, 0) AS n_assets
FROM posts p LEFT JOIN waiting w ON w.id = p.id LEFT JOIN links l ON l.post_id = p.id LEFT JOIN held h ON h.post_id = p.id
WHERE p.id NOT IN (SELECT id FROM gone)""",
)(_publish_touched)


def _storage_after_ingest(v: Views) -> DataFrame:
    """[M15, C13] The counter after a load, an arrival, an arrival that is refused, and a removal."""
    posts = v.posts()
    first, late = posts.filter("published = 1"), posts.filter("published = 0 AND likes < 50")
    size = F.coalesce("photo_bytes", F.lit(0)) + F.coalesce("video_bytes", F.lit(0))
    room = first.unionByName(late).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    store = CatalogueStore(v.spark, fresh_path(v.spark, "catalogue-store"), buckets=32, limit_bytes=room * 100 // 90 + 10)
    cat = v.catalogue()
    copies = first.withColumn("id", F.col("id") + 10_000_000)
    gone = v.table("labels").filter("toxic = 1").select((F.col("doc_id") + 1).alias("id"))

    def arrive(new: DataFrame):
        return store.rewrite(new.select("id"), lambda old: old._replace(posts=old.posts.unionByName(new.select(*old.posts.columns))))

    steps = [("load", store.load(cat._replace(posts=first)))]
    steps.append(("arrival", arrive(late)))
    steps.append(("refused", arrive(copies)))
    steps.append(("removal", store.rewrite(gone, lambda old: changes.delete_posts(old, gone))))
    rows = [(name, w.version, w.refused, w.total_bytes, store.read("posts", w.version).count()) for name, w in steps]
    told = v.spark.createDataFrame(rows, "step string, version long, refused boolean, total_bytes long, n_posts long")
    return told.join(store.history().select("version", "delta_bytes"), "version", "left")


query(
    "storage_after_ingest",
    """,
gone AS (SELECT doc_id + 1 AS id FROM labels WHERE toxic = 1),
sized AS (SELECT *, photo_bytes + video_bytes AS b FROM posts),
totals AS (
  SELECT CAST(sum(b) FILTER (WHERE published = 1) AS BIGINT) AS s0, CAST(coalesce(sum(b) FILTER (WHERE published = 0 AND likes < 50), 0) AS BIGINT) AS b1,
    CAST(coalesce(sum(b) FILTER (WHERE (published = 1 OR likes < 50) AND id IN (SELECT id FROM gone)), 0) AS BIGINT) AS d,
    count(*) FILTER (WHERE published = 1) AS n0, count(*) FILTER (WHERE published = 0 AND likes < 50) AS n1,
    count(*) FILTER (WHERE (published = 1 OR likes < 50) AND id IN (SELECT id FROM gone)) AS nd FROM sized)
SELECT 'load' AS step, CAST(0 AS BIGINT) AS version, false AS refused, s0 AS total_bytes, n0 AS n_posts, s0 AS delta_bytes FROM totals
UNION ALL SELECT 'arrival', 1, false, s0 + b1, n0 + n1, b1 FROM totals
UNION ALL SELECT 'refused', 1, true, s0 + b1, n0 + n1, b1 FROM totals
UNION ALL SELECT 'removal', 2, false, s0 + b1 - d, n0 + n1 - nd, -d FROM totals""",
)(_storage_after_ingest)


def _overview_version(v: Views) -> DataFrame:
    """[M16] The stored overview of a version, read a second time from its file."""
    store, _ = _stored(v)
    stored_overview(store)
    return stored_overview(store)


query("overview_version")(_overview_version)
ORACLES["overview_version"] = ORACLES["author_overview_rollup"]


def _version_totals(v: Views) -> DataFrame:
    store, _ = _stored(v)
    kept = stored_overview(store)
    names = directory(store.read("posts"), store.read("tags"))
    counts = [(known_total(kept, 1), known_total(kept, 0), names.authors.count(), names.tags.count())]
    return v.spark.createDataFrame(counts, "published long, pending long, authors long, tags long")


query(
    "version_totals",
    """
SELECT count(*) FILTER (WHERE published = 1) AS published, count(*) FILTER (WHERE published = 0) AS pending,
  count(DISTINCT author) FILTER (WHERE published = 1) AS authors, (SELECT count(*) FROM tags) AS tags FROM posts""",
)(_version_totals)


def _json_sink(v: Views) -> DataFrame:
    """[S9] Rows written as JSON and read again."""
    path = fresh_path(v.spark, "json-sink")
    rows = v.posts().select("id", "author", "media_keys")
    tables.write_rows(rows, path)
    return v.spark.read.schema(rows.schema).json(path).select("id", "author", F.array_join("media_keys", ",").alias("media_keys"))


query("json_sink", " SELECT id, author, media_keys FROM posts")(_json_sink)


def _folder_groups(v: Views) -> DataFrame:
    """[S6] File names of line items, `author_date_time_id_nn.jpg`, grouped to posts."""
    day = F.date_format("l_shipdate", "yyyyMMdd")
    name = F.concat_ws("_", F.concat(F.lit("acct"), "l_suppkey"), day, F.lit("120000"), F.col("l_orderkey").cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".jpg")))
    found = folder_import.group_files(v.table("lineitem").select(name.alias("name")))
    return found.select("ref", "author", "created_at", "post_url", F.array_join("media_keys", ",").alias("media_keys"))


query(
    "folder_groups",
    """,
named_files AS (SELECT 'acct' || l_suppkey AS author, l_shipdate, l_orderkey,
    'acct' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m%d') || '_120000_' || l_orderkey AS ref, l_linenumber FROM lineitem)
SELECT ref, author, strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at, 'https://x.com/' || author || '/status/' || l_orderkey AS post_url,
  string_agg(ref || '_' || l_linenumber || '.jpg', ',' ORDER BY l_linenumber) AS media_keys FROM named_files GROUP BY ref, author, l_shipdate, l_orderkey""",
)(_folder_groups)


def _replay(v: Views) -> DataFrame:
    """[Q7] What a batch adds when it meets its own result: nothing, so no rows and no changed marks."""
    items, state = _feed(v.timeline()), _ingest_state(v)
    new = ingest.ingest_pages(items, state, _fetched(v, items), _ingest_rules(v), NOW)
    held = state._replace(
        posts=state.posts.unionByName(new.posts.select(*state.posts.columns)),
        tags=state.tags.unionByName(new.tags),
        known_media=state.known_media.unionByName(new.known_media),
        marks=state.marks.join(new.marks, "account", "left_anti").unionByName(new.marks),
    )
    again = ingest.ingest_pages(items, held, _fetched(v, items), _ingest_rules(v), NOW)
    return again.posts.agg(F.count(F.lit(1)).alias("posts")).crossJoin(again.post_tags.agg(F.count(F.lit(1)).alias("links")))


query("ingest_replay", " SELECT CAST(0 AS BIGINT) AS posts, CAST(0 AS BIGINT) AS links")(_replay)


# --- the layout behind the pages ---------------------------------------------------

query(
    "page_zones",
    """
SELECT CAST(published AS BIGINT) AS published, strftime(date_trunc('day', created_at), '%Y-%m-%d-00') AS span, count(*) AS "rows",
  count(*) FILTER (WHERE photo_count > 0) AS feed_photo, count(*) FILTER (WHERE video_count > 0) AS feed_video,
  count(*) FILTER (WHERE photo_count > 0 AND video_count = 0) AS admin_photo, count(*) FILTER (WHERE video_count > 0) AS admin_video,
  epoch_us(min(created_at)) AS low, epoch_us(max(created_at)) AS high, max(photo_bytes + video_bytes) AS most_bytes
FROM posts GROUP BY 1, 2""",
)(lambda v: v.store().read("zones"))

# --- timeline pages as JSON --------------------------------------------------------

PAGE = 40
query(
    "timeline_pages",
    f"""
SELECT account, CAST((pos - 1) // {PAGE} AS BIGINT) AS page, CAST((pos - 1) % {PAGE} AS BIGINT) AS place, tweet_id, url, type, date, content, nick FROM timeline""",
)(lambda v: _timeline_pages(v))


def _timeline_pages(v: Views) -> DataFrame:
    """[S3] Line items written as pages of an account's timeline, one JSON document each, and read back."""
    feed = W.partitionBy("account").orderBy("pos")
    items = v.timeline().withColumn("_at", F.row_number().over(feed).cast("long") - 1)
    person = F.struct("nick")
    item = F.struct((F.col("_at") % PAGE).alias("place"), "tweet_id", "url", "type", "date", "content", person.alias("author"))
    # A page has at most PAGE items.
    pages_ = items.groupBy("account", F.floor(F.col("_at") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("media"))
    path = fresh_path(v.spark, "timeline-pages")
    pages_.select(F.upper("account").alias("account"), "page", F.transform("media", lambda m: m.dropFields("place")).alias("media")).write.option("compression", "gzip").json(path)
    rows = timeline_source.explode_pages(timeline_source.read_pages(v.spark, path))
    return rows.select("account", "pos.page", F.col("pos.place").cast("long").alias("place"), "tweet_id", "url", "type", "date", "content", "nick")


def _save(rows: DataFrame, folder: str) -> None:
    """Write (`name`, `data`) as one file each, in folders where names have some; a task that runs again writes the same files."""

    def save(batches):
        for batch in batches:
            files, root = pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
            for inner in {f"{root}/{name}".rpartition("/")[0] for name in batch["name"]}:
                files.create_dir(inner)
            for name, data in zip(batch["name"], batch["data"]):
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
            yield pd.DataFrame({"files": [len(batch)]})

    rows.mapInPandas(save, "files long").agg(F.sum("files")).collect()


def _draw(pixels: list[int]) -> bytes:
    """A 32x32 grey image as an uncompressed 24-bit BMP file (bottom row first)."""
    rows = [pixels[i : i + 32] for i in range(0, 1024, 32)]
    body = b"".join(bytes(p for grey in row for p in (grey,) * 3) for row in reversed(rows))
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 32, 32, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _hash_listed(v: Views) -> DataFrame:
    """[X12, S5, J8] Vectors drawn as image files, a third of them hashed before; runs until one opens no file."""
    folder = fresh_path(v.spark, "images")

    def files(batches):
        for batch in batches:
            yield pd.DataFrame({"name": [f"v{n}.bmp" for n in batch["vec_id"]], "data": [_draw(list(p)) for p in batch["pixels"]]})

    _save(drawn_cells(v).mapInPandas(files, "name string, data binary"), folder)
    keys = F.transform(F.array("id"), lambda i: F.format_string("v%d.bmp", i - 1))
    posts = v.posts().withColumn("media_keys", keys)
    known = v.table("embeddings").filter("vec_id % 3 = 0").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("post_id"), F.format_string("v%d.bmp", "vec_id").alias("key"),
        F.lit(None).cast("string").alias("etag"), F.lit("0" * 16).alias("phash"), F.lit(1).alias("phash_version"), F.lit(None).cast("timestamp").alias("hashed_at"),
    )
    cat = v.catalogue()._replace(posts=materialise(posts, "posts"), assets=known)
    opened, backlog = 0, near_duplicates.hash_backlog(cat, folder)
    while (run := near_duplicates.hash_listed_media(cat, folder, limit=1_000, backlog=backlog)).opened:
        opened += run.opened
    cat = near_duplicates.store_hashes(cat, backlog.hashed(), NOW)
    cat = cat._replace(assets=materialise(cat.assets, "assets"))
    new = cat.assets.filter("hashed_at is not null")
    return new.select("post_id", "key", hashing.hash_from_hex("phash").alias("hash"), F.lit(opened).cast("long").alias("opened"))


_DRAWN = ORACLES["image_phash"]
_AT = _DRAWN.rindex("SELECT c.vec_id")
ORACLES["hash_listed"] = f"""{_DRAWN[:_AT].rstrip()},
drawn AS ({_DRAWN[_AT:]}),
fresh AS (SELECT p.id AS post_id, 'v' || d.vec_id || '.bmp' AS key, d.hash FROM drawn d JOIN posts p ON p.id = d.vec_id + 1
  WHERE p.published = 1 AND d.vec_id % 3 <> 0)
SELECT *, (SELECT count(*) FROM fresh) AS opened FROM fresh"""
query("hash_listed")(_hash_listed)


FOLDERS = 256


def _object_listing(v: Views) -> DataFrame:
    """[S2] Texts as objects of a folder, listed with sizes and digests, and once more with no object opened."""
    folder = fresh_path(v.spark, "objects")
    # In folders by the number's last digits, as large stores lie, so that tasks list them and not the driver alone.
    name = F.format_string("%02x/d%d.txt", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(FOLDERS)), "doc_id")
    _save(v.table("documents").select(name.alias("name"), F.col("text").cast("binary").alias("data")), folder)
    sizes = tables.list_objects(v.spark, folder, with_etag=False).select("key", F.col("size").alias("listed_size"))
    return tables.list_objects(v.spark, folder).join(sizes, "key")


query(
    "object_listing",
    """
SELECT 'd' || doc_id || '.txt' AS key, md5(text) AS etag, CAST(strlen(text) AS BIGINT) AS size, CAST(strlen(text) AS BIGINT) AS listed_size FROM documents""",
)(_object_listing)

"""The catalogue as views over the given tables, in Spark and in SQL.

Both sides use the same integer formulas.  `h` is a 60-bit number taken from the md5
of a document's whole text, so copies of a text share it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.media import photo_count, video_count
from shutterlake.schema import Catalogue
from shutterlake.session import fresh_path, tune
from shutterlake.sources.page_store import PageStore

NOW = datetime(2024, 1, 5, 12, 30)
NOW_TEXT = "2024-01-05 12:30:00"
BASE_ID = 2039917506295648359
EXTENSIONS = (".jpg", ".png", ".MP4", ".webm", ".jpeg", ".webp")

# (ord, tag, parent, mode, keyword): sample rules in the languages of the corpus.
FLAT_RULES = [
    (1, "thinking", None, "substring", "though"),
    (2, "ending", None, "substring", "ending"),
    (2, "ending", None, "substring", "endend"),
    (3, "francais", None, "substring", "éle"),
    (3, "francais", None, "substring", "que "),
    (4, "tabular", None, "substring", "|"),
    (5, "percent", None, "substring", "100%"),
    (5, "percent", None, "substring", "%%%"),
]
WORK_RULES = [
    (11, "Voices", None, "word", "the"),
    (12, "Der Bote", "Voices", "word", "der"),
    (13, "La Reine", "Voices", "word", "la"),
    (13, "La Reine", "Voices", "word", "des"),
    (21, "Numbers", None, "word", "is it"),
    (22, "Triple", "Numbers", "regex", "[0-9]{3}-?[0-9]{4}"),
    (23, "Accent", "Numbers", "substring", "ère"),
    (31, "Rare", None, "word", "re-er"),
    (32, "Stone", "Rare", "word", "stone"),
]
RULES = FLAT_RULES + WORK_RULES

_RULE_ROWS = ",\n    ".join(
    "({}, '{}', {}, '{}', '{}')".format(o, t, f"'{p}'" if p else "CAST(NULL AS VARCHAR)", m, k) for o, t, p, m, k in RULES
)

SQL = f"""
docs AS (
  SELECT *, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h FROM documents),
posts0 AS (
  SELECT d.doc_id + 1 AS id, d.*,
    CASE WHEN d.n_chars % 7 = 0 THEN upper('src' || (h % 20)) ELSE 'src' || (h % 20) END AS author,
    CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 5 = 1 THEN '' ELSE 'Nick ' || d.source END AS author_display_name,
    (CASE WHEN h % 3 = 0 THEN 'https://twitter.com/' ELSE 'https://x.com/' END) || 'src' || (h % 20) || '/status/' || h AS post_url,
    (d.doc_id * 13) % 101 AS likes,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((d.doc_id * 37) % 97 AS INTEGER)) AS created_at,
    CASE WHEN l.quality = 0 THEN 0 ELSE 1 END AS published,
    coalesce(l.toxic, 0) AS toxic,
    d.n_chars % 5 + CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_media
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id),
media AS (
  SELECT p.id, k AS pos,
    'm' || p.doc_id || '_' || (CASE WHEN p.likes % 3 = 0 THEN CAST(p.h AS VARCHAR) ELSE 'x' END) || '_' || k
      || list_extract(['.jpg', '.png', '.MP4', '.webm', '.jpeg', '.webp'], CAST((p.n_chars + k) % 6 + 1 AS INTEGER)) AS key,
    md5(p.text || CAST(k % 2 AS VARCHAR)) AS etag,
    1000 + (p.n_chars * 7919 + k * 104729) % 5000000 AS size,
    (p.n_chars + k) % 6 IN (2, 3) AS video,
    p.toxic = 1 AND k = 1 AS lost
  FROM posts0 p, LATERAL (SELECT unnest(range(CAST(p.n_media AS BIGINT))) AS k)),
sums AS (
  SELECT id, count(*) FILTER (WHERE NOT video) AS photo_count, count(*) FILTER (WHERE video) AS video_count,
    coalesce(sum(size) FILTER (WHERE NOT video), 0) AS photo_bytes, coalesce(sum(size) FILTER (WHERE video), 0) AS video_bytes,
    string_agg(key, ',' ORDER BY pos) AS media_keys
  FROM media GROUP BY id),
posts AS (
  SELECT p.id, '@' || p.author || ' #' || p.doc_id AS title, p.author, p.author_display_name,
    'https://x.com/' || p.author AS author_url, p.post_url, p.text AS description, p.likes, p.created_at,
    CASE WHEN p.doc_id % 9 = 0 THEN p.created_at + INTERVAL 1 DAY END AS updated_at, p.published, p.n_media,
    CAST(coalesce(s.photo_count, 0) AS BIGINT) AS photo_count, CAST(coalesce(s.video_count, 0) AS BIGINT) AS video_count,
    CAST(coalesce(s.photo_bytes, 0) AS BIGINT) AS photo_bytes, CAST(coalesce(s.video_bytes, 0) AS BIGINT) AS video_bytes,
    coalesce(s.media_keys, '') AS media_keys, p.doc_id, p.source, p.lang, p.n_chars, p.h
  FROM posts0 p LEFT JOIN sums s ON s.id = p.id),
objects AS (SELECT key, etag, size FROM media WHERE NOT lost),
named AS (
  SELECT id AS post_id, lang AS name FROM posts
  UNION SELECT id, source FROM posts
  UNION SELECT id, 'short' FROM posts WHERE n_chars < 500
  UNION SELECT id, 'Voices' FROM posts WHERE lang <> 'en'
  UNION SELECT id, 'busy' FROM posts WHERE n_media > 3 AND published = 0),
tags AS (
  SELECT CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) AS id, name
  FROM (SELECT name FROM named UNION SELECT 'unused ' || p_brand FROM part UNION SELECT n_name FROM nation)),
post_tags AS (SELECT n.post_id, t.id AS tag_id FROM named n JOIN tags t ON t.name = n.name),
public_authors AS (SELECT DISTINCT lower(author) AS name FROM posts WHERE published = 1),
visible AS (
  SELECT pt.post_id, string_agg(t.name, ',' ORDER BY t.name) AS tags_list
  FROM post_tags pt JOIN tags t ON t.id = pt.tag_id
  WHERE lower(trim(t.name)) NOT IN (SELECT name FROM public_authors) GROUP BY pt.post_id),
visible_admin AS (
  SELECT pt.post_id, string_agg(t.name, ',' ORDER BY t.name) AS tags_list
  FROM post_tags pt JOIN tags t ON t.id = pt.tag_id
  WHERE lower(trim(t.name)) NOT IN (SELECT lower(author) FROM posts) GROUP BY pt.post_id),
rules(ord, tag, parent, mode, keyword) AS (VALUES
    {_RULE_ROWS}),
accounts AS (
  SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS username,
    CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS enabled,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS crawl_all FROM customer),
timeline AS (
  SELECT 'acct' || l_suppkey AS account,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS pos,
    CAST({BASE_ID} + 1000 * l_orderkey AS VARCHAR) AS tweet_id,
    'https://media.example/' || l_suppkey || '/' || (l_partkey % 20) || CASE l_returnflag WHEN 'A' THEN '?format=png' WHEN 'N' THEN '.mp4?tag=1' ELSE '.gif' END AS url,
    CASE l_returnflag WHEN 'A' THEN 'photo' WHEN 'N' THEN 'Video' ELSE 'animated_gif' END AS type,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date,
    'item ' || l_linenumber AS content, CASE WHEN l_linestatus = 'O' THEN ' Nick ' || l_suppkey ELSE '' END AS nick
  FROM lineitem),
likes_log AS (
  SELECT user_id + 1 AS post_id, event_id, ts,
    CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 END AS delta
  FROM events WHERE event_type IN ('click', 'error')),
vectors AS (
  SELECT vec_id, label, c, (list_sort(c)[32] + list_sort(c)[33]) / 2 AS med
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings)),
hashes AS (
  SELECT vec_id, label, list_reduce(list_transform(range(64), lambda i: CASE WHEN c[i + 1] > med
    THEN (CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << i END)
    ELSE CAST(0 AS BIGINT) END), lambda x, y: x | y) AS hash
  FROM vectors),
assets AS (
  SELECT 'e' || vec_id || '_' || v AS key, vec_id // 2 + v * 3 + 1 AS post_id, vec_id, label, v,
    xor(hash, (CAST(1 AS BIGINT) << CAST(v * (vec_id % 4) AS BIGINT)) - 1) AS hash
  FROM hashes, range(3) w(v)),
images AS (
  SELECT a.key, a.post_id, a.hash, p.likes, p.title FROM assets a JOIN posts p ON p.id = a.post_id WHERE p.published = 1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(c: Column | str) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


_STORES: dict[tuple[str, str], PageStore] = {}


class Views:
    """The catalogue of one scale; every view is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _base(self) -> DataFrame:
        docs = self.table("documents").withColumn("h", hash60("text"))
        labels = self.table("labels")
        d, n = F.col("doc_id"), F.col("n_chars")
        origin = F.concat(F.lit("src"), F.col("h") % 20)
        host = F.when(F.col("h") % 3 == 0, "https://twitter.com/").otherwise("https://x.com/")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        return docs.join(labels, "doc_id", "left").select(
            (d + 1).alias("id"),
            F.when(n % 7 == 0, F.upper(origin)).otherwise(origin).alias("author"),
            F.when(d % 5 == 1, "").when(d % 5 > 1, F.concat(F.lit("Nick "), "source")).alias("author_display_name"),
            F.concat(host, origin, F.lit("/status/"), "h").alias("post_url"),
            ((d * 13) % 101).alias("likes"),
            F.timestamp_seconds(F.unix_seconds(start) + ((d * 37) % 97) * 3600).alias("created_at"),
            F.when(F.col("quality") == 0, 0).otherwise(1).alias("published"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
            (n % 5 + F.when(d % 11 == 0, 1).otherwise(0)).alias("n_media"),
            "doc_id",
            "text",
            "lang",
            "source",
            "n_chars",
            "h",
        )

    @staticmethod
    def _positions() -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.col("n_media") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_media") - 1)).otherwise(none)

    @staticmethod
    def _key(k: Column) -> Column:
        mark = F.when(F.col("likes") % 3 == 0, F.col("h").cast("string")).otherwise("x")
        ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), ((F.col("n_chars") + k) % 6 + 1).cast("int"))
        return F.concat(F.lit("m"), "doc_id", F.lit("_"), mark, F.lit("_"), k, ext)

    @staticmethod
    def _size(k: Column) -> Column:
        return F.lit(1000) + (F.col("n_chars") * 7919 + k * 104729) % 5000000

    def posts(self) -> DataFrame:
        base = self._base().withColumn("media_keys", F.transform(self._positions(), self._key))

        def total(video: bool) -> Column:
            chosen = F.filter(self._positions(), lambda k: ((F.col("n_chars") + k) % 6).isin(2, 3) == F.lit(video))
            return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, k: acc + self._size(k))

        return base.select(
            "id",
            F.concat(F.lit("@"), "author", F.lit(" #"), "doc_id").alias("title"),
            "media_keys",
            "author",
            "author_display_name",
            F.concat(F.lit("https://x.com/"), "author").alias("author_url"),
            "post_url",
            F.col("text").alias("description"),
            "likes",
            "created_at",
            F.when(F.col("doc_id") % 9 == 0, F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
            "published",
            total(False).alias("photo_bytes"),
            total(True).alias("video_bytes"),
            photo_count("media_keys").alias("photo_count"),
            video_count("media_keys").alias("video_count"),
            F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("media_count_version"),
        )

    def objects(self, lost: bool = True) -> DataFrame:
        """Stored objects; those of the second medium of toxic posts were removed."""
        rows = self._base().select("*", F.explode(self._positions()).alias("k"))
        if lost:
            rows = rows.filter(~((F.col("toxic") == 1) & (F.col("k") == 1)))
        k = F.col("k")
        etag = F.md5(F.concat("text", (k % 2).cast("string")))
        return rows.select(self._key(k).alias("key"), etag.alias("etag"), self._size(k).alias("size"))

    def named_tags(self) -> DataFrame:
        """(post_id, name)"""
        names = F.array(
            F.col("lang"),
            F.col("source"),
            F.when(F.col("n_chars") < 500, F.lit("short")),
            F.when(F.col("lang") != "en", F.lit("Voices")),
            F.when((F.col("n_media") > 3) & (F.col("published") == 0), F.lit("busy")),
        )
        return self._base().select(F.col("id").alias("post_id"), F.explode(F.array_distinct(F.array_compact(names))).alias("name"))

    def tags(self) -> DataFrame:
        names = self.named_tags().select("name")
        names = names.unionByName(self.table("part").select(F.concat(F.lit("unused "), "p_brand").alias("name")))
        names = names.unionByName(self.table("nation").select(F.col("n_name").alias("name")))
        return names.distinct().select(hash60("name").alias("id"), "name")

    def post_tags(self) -> DataFrame:
        return self.named_tags().select("post_id", hash60("name").alias("tag_id"))

    def catalogue(self) -> Catalogue:
        return Catalogue(self.posts(), self.tags(), self.post_tags(), self.asset_rows(), self.accounts())

    def store(self) -> PageStore:
        """The catalogue laid out for pages; a session lays out each scale once."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORES:
            store = PageStore(self.spark, fresh_path(self.spark, "page-store"))
            store.publish_catalogue(self.catalogue(), 0)
            _STORES[key] = store
        return _STORES[key]

    def feed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.posts(), self.post_tags(), self.tags()

    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, "ord int, tag string, parent string, mode string, keyword string")

    def accounts(self) -> DataFrame:
        c = self.table("customer")
        never = F.lit(None)
        return c.select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_nationkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("username"),
            F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("enabled"),
            F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("crawl_all"),
            never.cast("timestamp").alias("last_crawled_at"),
            never.cast("string").alias("last_crawl_type"),
            never.cast("string").alias("last_crawl_mode"),
            F.lit(0).alias("last_crawl_count"),
            never.cast("string").alias("last_crawl_error"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        )

    def timeline(self) -> DataFrame:
        return self.timeline_rows(self.table("lineitem"))

    @staticmethod
    def timeline_rows(li: DataFrame) -> DataFrame:
        """One row per line item; an account's feed runs from the newest shipment back.

        `pos` packs the order into one sortable value, so no global numbering is needed.
        """
        flag, part = F.col("l_returnflag"), (F.col("l_partkey") % 20).cast("string")
        end = F.when(flag == "A", "?format=png").when(flag == "N", ".mp4?tag=1").otherwise(".gif")
        seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
        rest = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        pos = F.struct((-seconds).alias("s"), (-F.col("l_orderkey")).alias("o"), *rest)
        return li.select(
            F.concat(F.lit("acct"), "l_suppkey").alias("account"),
            pos.alias("pos"),
            (F.lit(BASE_ID) + 1000 * F.col("l_orderkey")).cast("string").alias("tweet_id"),
            F.concat(F.lit("https://media.example/"), "l_suppkey", F.lit("/"), part, end).alias("url"),
            F.when(flag == "A", "photo").when(flag == "N", "Video").otherwise("animated_gif").alias("type"),
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
            F.concat(F.lit("item "), "l_linenumber").alias("content"),
            F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" Nick "), "l_suppkey")).otherwise("").alias("nick"),
        )

    def like_events(self) -> DataFrame:
        kind = F.col("event_type")
        action = F.when(kind == "click", "like").when(kind == "error", "unlike").otherwise("other")
        return self.table("events").select((F.col("user_id") + 1).alias("post_id"), action.alias("action"), "ts", "event_id")

    def asset_hashes(self) -> DataFrame:
        """(key, post_id, hash): three variants of every vector's hash."""
        from shutterlake.functions.hashing import phash_from_coefficients

        e = self.table("embeddings").withColumn("_hash", phash_from_coefficients("embedding"))
        v = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v")
        rows = e.select("vec_id", "_hash", v)
        mask = F.expr("shiftleft(1L, cast(v * (vec_id % 4) as int)) - 1")
        return rows.select(
            F.concat(F.lit("e"), "vec_id", F.lit("_"), "v").alias("key"),
            (F.floor(F.col("vec_id") / 2) + F.col("v") * 3 + 1).cast("long").alias("post_id"),
            F.col("_hash").bitwiseXOR(mask).alias("hash"),
        )

    def asset_rows(self) -> DataFrame:
        from shutterlake.functions.hashing import hash_to_hex

        rows = self.asset_hashes()
        return rows.select(
            hash60("key").alias("id"),
            "post_id",
            "key",
            F.lit(None).cast("string").alias("etag"),
            hash_to_hex("hash").alias("phash"),
            F.lit(1).alias("phash_version"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("hashed_at"),
        )

    def images(self) -> DataFrame:
        from shutterlake.operators.similarity import hashed_assets

        return hashed_assets(self.asset_rows(), self.posts())

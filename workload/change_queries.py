"""Registered queries, second part: tagging, duplicates, similarity, changes, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions import hashing
from shutterlake.operators import accounts, changes, counters, dedup, ingest, ledger, similarity, tagging, timeline
from shutterlake.operators import tags as tag_ops
from shutterlake.plans import maintenance, near_duplicates
from shutterlake.schema import POSTS, Catalogue
from shutterlake.session import drop_path, fresh_path, materialise
from shutterlake.sources import images as image_source
from shutterlake.sources import tables
from shutterlake.streaming import ingest as ingest_stream_job
from shutterlake.streaming import likes as like_stream_job
from workload.queries import query, stamp
from workload.views import NOW, NOW_TEXT, RULES, Views

# --- tagging ----------------------------------------------------------------------


def keyword_sql(mode: str, keyword: str, column: str = "lower(description)") -> str:
    if mode == "substring":
        return f"contains({column}, '{keyword}')"
    if mode == "regex":
        return f"regexp_matches({column}, '{keyword}')"
    return f"regexp_matches({column}, '(^|[^a-z0-9_]){keyword}([^a-z0-9_]|\\z)')"


def rule_links_sql() -> str:
    """(post_id, name) by plain OR lists, the work of a character included."""
    parts = []
    for _, tag, parent, mode, keyword in RULES:
        for name in {tag, parent} - {None}:
            parts.append(f"SELECT id AS post_id, '{name}' AS name FROM posts WHERE {keyword_sql(mode, keyword)}")
    return "\n  UNION ".join(parts)


RULE_LINKS = f""",
found AS ({rule_links_sql()})"""
TAG_ORDER = "CASE name " + " ".join(
    f"WHEN '{t}' THEN {i}" for i, t in enumerate(dict.fromkeys(x for _, tag, parent, _, _ in RULES for x in ([parent, tag] if parent else [tag])))
) + " END"


def _rules(v: Views) -> list[tagging.Rule]:
    return tagging.load_rules(v.rules())


# 1,200 keywords drawn from the texts themselves; half of them match whole words only.
MANY = 1200
query(
    "tag_many_keywords",
    f""",
many AS (
  SELECT w, substr(md5(w), 1, 1) < '8' AS part FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(description), '[a-z]{{6,}}')) AS w FROM posts)
  ORDER BY md5(w), w LIMIT {MANY})
SELECT 'has ' || w AS name, count(*) AS n FROM posts p JOIN many m ON CASE WHEN m.part THEN contains(lower(p.description), m.w)
  ELSE regexp_matches(lower(p.description), '(^|[^a-z0-9_])' || m.w || '([^a-z0-9_]|\\z)') END GROUP BY 1""",
)(lambda v: tagging.assign_tags(v.posts(), _many_rules(v)).groupBy("name").agg(F.count(F.lit(1)).alias("n")))


def _many_rules(v: Views, n: int = MANY) -> list[tagging.Rule]:
    words = v.posts().select(F.explode(F.regexp_extract_all(F.lower("description"), F.lit("([a-z]{6,})"))).alias("w")).distinct()
    first = words.orderBy(F.md5("w"), "w").limit(n)
    mode = F.when(F.substring(F.md5("w"), 1, 1) < "8", "substring").otherwise("word")
    ordinal = F.row_number().over(W.orderBy("w")).cast("int")  # of the n words
    return tagging.load_rules(first.select(ordinal.alias("ord"), F.concat(F.lit("has "), "w").alias("tag"), F.lit(None).cast("string").alias("parent"), mode.alias("mode"), F.col("w").alias("keyword")))


query(
    "tag_rules",
    RULE_LINKS
    + f"""
SELECT p.id, coalesce((SELECT string_agg(name, ',' ORDER BY {TAG_ORDER}) FROM found f WHERE f.post_id = p.id), '') AS tag_names FROM posts p""",
)(
    lambda v: v.posts().select(
        "id", F.array_join(tagging.tag_column("description", _rules(v)), ",").alias("tag_names")
    )
)
query("tag_links", RULE_LINKS + " SELECT post_id, name FROM found")(
    lambda v: tagging.assign_tags(v.posts(), _rules(v))
)
query(
    "tag_backfill",
    RULE_LINKS
    + """,
new_names AS (SELECT name, row_number() OVER (ORDER BY name) AS rn FROM (SELECT DISTINCT name FROM found) WHERE name NOT IN (SELECT name FROM tags)),
all_tags AS (SELECT id, name FROM tags UNION ALL SELECT (SELECT max(id) FROM tags) + rn, name FROM new_names)
SELECT t.id AS tag_id, t.name, count(*) AS n_links, (SELECT count(*) FROM posts) AS scanned,
  (SELECT count(*) FROM found f WHERE NOT EXISTS (SELECT 1 FROM post_tags pt JOIN tags x ON x.id = pt.tag_id WHERE pt.post_id = f.post_id AND x.name = f.name)) AS added
FROM (SELECT DISTINCT post_id, tag_id FROM (SELECT post_id, tag_id FROM post_tags UNION ALL SELECT f.post_id, a.id FROM found f JOIN all_tags a ON a.name = f.name)) l
JOIN all_tags t ON t.id = l.tag_id GROUP BY 1, 2""",
)(lambda v: _tag_backfill(v))


def _tag_backfill(v: Views) -> DataFrame:
    after, report = changes.tag_backfill(v.catalogue(), _rules(v))
    counts = after.post_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = counts.join(after.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.withColumns({c: report.select(c).scalar() for c in ("scanned", "added")})


query(
    "browse_works",
    """
SELECT DISTINCT coalesce(parent, tag) AS work FROM rules WHERE coalesce(parent, tag) IN (SELECT name FROM tags)
  OR tag IN (SELECT name FROM tags) OR (mode <> 'regex' AND keyword IN (SELECT name FROM tags))""",
)(lambda v: tagging.browse_works(v.rules(), v.tags()))
query(
    "active_work_posts",
    """,
active AS (SELECT parent AS work FROM rules WHERE tag = 'Triple' LIMIT 1)
SELECT a.work, count(*) AS n_tags FROM active a JOIN tags t ON lower(t.name) <> lower(a.work) GROUP BY a.work""",
)(
    lambda v: v.tags()
    .withColumn("work", tagging.active_work(v.rules(), None, "Triple").scalar())
    .filter(F.lower("name") != F.lower("work"))
    .groupBy("work")
    .agg(F.count(F.lit(1)).alias("n_tags"))
)
query(
    "generic_tags",
    """
SELECT id, name FROM tags WHERE lower(name) NOT IN (SELECT name FROM public_authors)
  AND lower(name) NOT IN (SELECT lower(tag) FROM rules UNION SELECT lower(parent) FROM rules WHERE parent IS NOT NULL
    UNION SELECT lower(keyword) FROM rules WHERE mode <> 'regex')""",
)(lambda v: tagging.generic_tags(v.tags(), tag_ops.author_set(v.posts(), True), v.rules()))

# --- exact duplicates -------------------------------------------------------------

GROUPS = """,
groups AS (SELECT post_url, min(id) AS first_id, count(*) AS n_posts FROM posts WHERE contains(lower(post_url), '/status/') GROUP BY 1 HAVING count(*) > 1)"""
LOSERS = (
    GROUPS
    + """,
sigs AS (SELECT m.id, CASE WHEN count(*) = count(o.etag) THEN string_agg(o.etag, '|' ORDER BY o.etag) END AS sig
  FROM media m LEFT JOIN objects o ON o.key = m.key GROUP BY m.id),
members AS (SELECT p.id, p.post_url, s.sig, coalesce((SELECT bool_or(contains(m.key, CAST(p.h AS VARCHAR))) FROM media m WHERE m.id = p.id), false) AS exact
  FROM posts p JOIN groups g ON g.post_url = p.post_url LEFT JOIN sigs s ON s.id = p.id),
kept AS (SELECT post_url, id AS keep_id, sig FROM (SELECT *, row_number() OVER (PARTITION BY post_url ORDER BY exact DESC, id) AS rn FROM members) WHERE rn = 1),
losers AS (SELECT m.post_url, k.keep_id, m.id AS delete_id FROM members m JOIN kept k ON k.post_url = m.post_url WHERE m.id <> k.keep_id AND m.sig = k.sig)"""
)
LOST_KEYS = (
    LOSERS
    + """,
lost AS (SELECT DISTINCT l.keep_id, m.key FROM losers l JOIN media m ON m.id = l.delete_id
  WHERE NOT EXISTS (SELECT 1 FROM media k WHERE k.id = l.keep_id AND k.key = m.key)),
lost_keys AS (SELECT l.keep_id, l.key, coalesce(o.size, 0) AS size,
  EXISTS (SELECT 1 FROM media m WHERE m.key = l.key AND m.id NOT IN (SELECT delete_id FROM losers)) AS still_used
  FROM lost l LEFT JOIN objects o ON o.key = l.key)"""
)
query("duplicate_groups", GROUPS + " SELECT p.id, p.post_url, g.first_id, g.n_posts FROM posts p JOIN groups g ON g.post_url = p.post_url")(
    lambda v: dedup.posts_in_groups(v.posts()).select("id", "post_url", "first_id", "n_posts")
)
query("duplicate_posts", LOSERS + " SELECT post_url, keep_id, delete_id FROM losers")(
    lambda v: dedup.duplicate_posts(v.posts(), v.objects())
)
query("duplicate_post_keys", LOST_KEYS + " SELECT keep_id, key, size, still_used FROM lost_keys")(
    lambda v: dedup.post_fixes(v.posts(), v.objects()).keys
)
query(
    "duplicate_post_summary",
    LOST_KEYS
    + """
SELECT l.post_url, l.keep_id, count(*) AS n_posts, coalesce((SELECT count(*) FROM lost_keys k WHERE k.keep_id = l.keep_id), 0) AS n_keys,
  CAST(coalesce((SELECT sum(size) FROM lost_keys k WHERE k.keep_id = l.keep_id), 0) AS BIGINT) AS freed_bytes FROM losers l GROUP BY 1, 2""",
)(lambda v: dedup.post_fixes(v.posts(), v.objects()).summary)
DUP_MEDIA = """,
dup AS (SELECT m.id, first_value(m.key) OVER w AS keep_key, m.key, m.pos, o.size, row_number() OVER w AS rn, m.video
  FROM media m JOIN objects o ON o.key = m.key JOIN posts p ON p.id = m.id AND p.n_media > 1 WINDOW w AS (PARTITION BY m.id, o.etag ORDER BY m.pos))"""
query("duplicate_media", DUP_MEDIA + " SELECT id, keep_key, key, pos, size FROM dup WHERE rn > 1")(
    lambda v: dedup.duplicate_media(v.posts(), v.objects())
)
query(
    "duplicate_media_applied",
    DUP_MEDIA
    + """,
fixed AS (SELECT DISTINCT id FROM dup WHERE rn > 1),
rest AS (SELECT m.id, m.key, m.pos, m.video, coalesce(o.size, 0) AS size FROM media m JOIN fixed f ON f.id = m.id LEFT JOIN objects o ON o.key = m.key
  WHERE NOT EXISTS (SELECT 1 FROM dup d WHERE d.id = m.id AND d.key = m.key AND d.rn > 1)),
sums2 AS (SELECT id, string_agg(key, ',' ORDER BY pos) AS media_keys, count(*) FILTER (WHERE NOT video) AS pc, count(*) FILTER (WHERE video) AS vc,
  coalesce(sum(size) FILTER (WHERE NOT video), 0) AS pb, coalesce(sum(size) FILTER (WHERE video), 0) AS vb FROM rest GROUP BY id)
SELECT p.id, coalesce(s.media_keys, p.media_keys) AS media_keys, coalesce(s.pc, p.photo_count) AS photo_count, coalesce(s.vc, p.video_count) AS video_count,
  CAST(coalesce(s.pb, p.photo_bytes) AS BIGINT) AS photo_bytes, CAST(coalesce(s.vb, p.video_bytes) AS BIGINT) AS video_bytes
FROM posts p LEFT JOIN sums2 s ON s.id = p.id""",
)(
    lambda v: dedup.apply_media_fixes(
        v.catalogue(), v.objects(), dedup.duplicate_media(v.posts(), v.objects())
    ).posts.select(
        "id", F.array_join("media_keys", ",").alias("media_keys"), "photo_count", "video_count", "photo_bytes", "video_bytes"
    )
)
query(
    "duplicate_merge",
    LOSERS
    + """,
grp AS (SELECT keep_id, delete_id AS id FROM losers UNION SELECT keep_id, keep_id FROM losers),
best AS (SELECT g.keep_id, max(p.likes) AS likes, max(p.published) AS published FROM grp g JOIN posts p ON p.id = g.id GROUP BY 1),
kept_bytes AS (SELECT m.id, coalesce(sum(o.size) FILTER (WHERE NOT video), 0) AS pb, coalesce(sum(o.size) FILTER (WHERE video), 0) AS vb
  FROM media m LEFT JOIN objects o ON o.key = m.key WHERE m.id IN (SELECT keep_id FROM losers) GROUP BY m.id),
moved AS (SELECT DISTINCT coalesce(l.keep_id, pt.post_id) AS post_id, pt.tag_id FROM post_tags pt LEFT JOIN losers l ON l.delete_id = pt.post_id)
SELECT p.id, coalesce(b.likes, p.likes) AS likes, CAST(coalesce(b.published, p.published) AS BIGINT) AS published,
  CAST(coalesce(k.pb, p.photo_bytes) AS BIGINT) AS photo_bytes, CAST(coalesce(k.vb, p.video_bytes) AS BIGINT) AS video_bytes,
  (SELECT count(*) FROM moved m WHERE m.post_id = p.id) AS n_tags
FROM posts p LEFT JOIN best b ON b.keep_id = p.id LEFT JOIN kept_bytes k ON k.id = p.id WHERE p.id NOT IN (SELECT delete_id FROM losers)""",
)(lambda v: _merged(v))


def _merged(v: Views) -> DataFrame:
    after = maintenance.remove_copies(v.catalogue(), v.objects())
    n_tags = after.post_tags.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"))
    rows = after.posts.join(n_tags, "id", "left")
    return rows.select("id", "likes", "published", "photo_bytes", "video_bytes", F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


# --- near duplicates --------------------------------------------------------------

query("phash_from_coefficients", " SELECT vec_id, hash FROM hashes")(
    lambda v: v.table("embeddings").select("vec_id", hashing.phash_from_coefficients("embedding").alias("hash"))
)
query(
    "image_phash",
    """,
basis AS (SELECT u, b, sum(cos((2 * x + 1) * u * pi() / 64)) * (CASE WHEN u = 0 THEN 1 / sqrt(2.0) ELSE 1.0 END) AS w
  FROM range(8) t(u), (SELECT x, x // 4 AS b FROM range(32) r(x)) GROUP BY u, b),
cells AS (SELECT vec_id, i, CAST(floor((c[i + 1] + 1) * 127) AS BIGINT) AS p FROM vectors, range(64) t(i)),
coef AS (SELECT vec_id, bu.u * 8 + bv.u AS i, 0.25 * sum(p * bu.w * bv.w) AS v FROM cells
  JOIN basis bu ON bu.b = i // 8 JOIN basis bv ON bv.b = i % 8 GROUP BY 1, 2),
med AS (SELECT vec_id, (list_sort(list(v))[32] + list_sort(list(v))[33]) / 2 AS m FROM coef GROUP BY vec_id)
SELECT c.vec_id, bit_or(CASE WHEN c.v > m.m THEN (CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << i END) ELSE CAST(0 AS BIGINT) END) AS hash
FROM coef c JOIN med m USING (vec_id) GROUP BY c.vec_id""",
)(lambda v: _image_phash(v))


def drawn_cells(v: Views) -> DataFrame:
    """Vectors drawn as 8x8 grey cells of 4x4 pixels: `vec_id`, `pixels`."""
    cell = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int"))
    index = F.sequence(F.lit(0), F.lit(1023))

    def draw(cells):
        return F.transform(index, lambda i: cells[(F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int")])

    return v.table("embeddings").select("vec_id", F.transform(F.array(cell), draw)[0].alias("pixels"))


def _image_phash(v: Views) -> DataFrame:
    """Drawn vectors, hashed like any image."""
    coefficients = image_source.dct_coefficients(drawn_cells(v))
    return coefficients.select("vec_id", hashing.phash_from_coefficients("coefficients").alias("hash"))


query(
    "hamming_to_first",
    """,
base_hash AS (SELECT hash AS h0 FROM hashes WHERE vec_id = 0)
SELECT vec_id, CAST(bit_count(xor(hash, h0)) AS BIGINT) AS distance, (64 - bit_count(xor(hash, h0))) * 100.0::DOUBLE / 64 AS similarity_pct FROM hashes, base_hash""",
)(lambda v: _to_first(v))


def _to_first(v: Views) -> DataFrame:
    rows = v.table("embeddings").select("vec_id", hashing.hash_to_hex(hashing.phash_from_coefficients("embedding")).alias("hex"))
    pivot = rows.filter("vec_id = 0").select("hex").scalar()
    d = rows.withColumn("first", pivot).withColumn("distance", hashing.hamming_hex("hex", "first"))
    return d.select("vec_id", "distance", hashing.similarity_pct(F.col("distance")).alias("similarity_pct"))


query(
    "unhashed_media",
    """
SELECT m.id AS post_id, m.key, p.title, p.likes FROM media m JOIN posts p ON p.id = m.id
WHERE p.published = 1 AND NOT m.video AND m.key NOT IN (SELECT key FROM assets)""",
)(lambda v: similarity.unhashed_media(v.posts(), v.asset_rows()))
query("hashed_assets", " SELECT post_id, key, hash, likes, title FROM images")(lambda v: v.images())
PAIRS = """,
distinct_hashes AS (SELECT hash, count(*) AS n, min(post_id) AS lo, max(post_id) AS hi FROM images GROUP BY hash),
pairs AS (SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance
  FROM distinct_hashes a JOIN distinct_hashes b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= {t}
  WHERE NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo))"""
IMAGE_PAIRS = """,
image_pairs AS (SELECT a.post_id AS pa, a.key AS ka, a.likes AS la, a.title AS ta, b.post_id AS pb, b.key AS kb, b.likes AS lb, b.title AS tb,
    CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance
  FROM images a JOIN images b ON (a.post_id < b.post_id) AND bit_count(xor(a.hash, b.hash)) <= {t})"""


def _links(v: Views, threshold: int) -> DataFrame:
    groups = materialise(similarity.hash_groups(v.images()), "groups")
    return similarity.linked_hashes(groups, similarity.similar_hashes(groups, threshold, carry=similarity.POSTS_OF_HASH))


for _t in (3, 10, 20):
    query(
        f"similar_pairs_t{_t}",
        PAIRS.format(t=_t) + " SELECT hash_a, hash_b, distance, (64 - distance) * 100.0::DOUBLE / 64 AS similarity_pct FROM pairs",
    )(
        lambda v, t=_t: similarity.describe_pairs(_links(v, t)).drop("similarity")
    )
query("pair_total", IMAGE_PAIRS.format(t=18) + " SELECT count(*) AS total_pairs FROM image_pairs")(
    lambda v: _pair_total(v)
)


def _pair_total(v: Views) -> DataFrame:
    images = materialise(v.images(), "images")
    return similarity.pair_total(images, similarity.similar_hashes(similarity.hash_groups(images), 18, carry=["n"]), 18)


query(
    "sample_pairs",
    IMAGE_PAIRS.format(t=10)
    + """
SELECT ka AS first_key, kb AS second_key, CASE WHEN lb > la THEN pb ELSE pa END AS preferred_post, CASE WHEN lb > la THEN tb ELSE ta END AS preferred_title,
  CASE WHEN lb > la THEN pa ELSE pb END AS candidate_post, CASE WHEN lb > la THEN ta ELSE tb END AS candidate_title, distance,
  (64 - distance) * 100.0::DOUBLE / 64 AS similarity_pct
FROM image_pairs ORDER BY pa, ka, pb, kb LIMIT 100""",
)(lambda v: _sample(v))


def _sample(v: Views) -> DataFrame:
    images = materialise(v.images(), "images")
    pairs = similarity.similar_hashes(similarity.hash_groups(images), 10)
    return similarity.sample_pairs(images, pairs).drop("similarity")


CLUSTERS = (
    PAIRS.format(t=18)
    + """,
edges AS (SELECT hash_a AS u, hash_b AS v FROM pairs UNION ALL SELECT hash_b, hash_a FROM pairs),
reach AS (SELECT hash AS node, hash AS root FROM distinct_hashes UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.root),
parts AS (SELECT node AS hash, min(root) AS component FROM reach GROUP BY node),
members AS (SELECT p.component, i.post_id, max(i.likes) AS likes FROM images i JOIN parts p ON p.hash = i.hash GROUP BY 1, 2)"""
)
query("similar_clusters", CLUSTERS + " SELECT component, post_id, likes FROM members", recursive=True)(
    lambda v: similarity.cluster_posts(v.images(), 18)
)
query(
    "duplicate_verdicts",
    CLUSTERS
    + """,
judged AS (SELECT post_id, row_number() OVER (PARTITION BY component ORDER BY likes DESC, post_id) > 1 AS lost FROM members)
SELECT post_id, CASE WHEN bool_or(lost) THEN 'pending' ELSE 'keeper' END AS verdict FROM judged GROUP BY post_id""",
    recursive=True,
)(lambda v: similarity.verdicts(similarity.cluster_posts(v.images(), 18)))
query(
    "review_applied",
    CLUSTERS
    + f""",
judged AS (SELECT post_id, row_number() OVER (PARTITION BY component ORDER BY likes DESC, post_id) > 1 AS lost FROM members),
pending AS (SELECT post_id FROM judged GROUP BY 1 HAVING bool_or(lost))
SELECT id, CAST(CASE WHEN id IN (SELECT post_id FROM pending) THEN 0 ELSE published END AS BIGINT) AS published,
  CASE WHEN published = 1 AND id IN (SELECT post_id FROM pending) THEN '{NOW_TEXT}' ELSE {stamp("updated_at")} END AS updated_at FROM posts""",
    recursive=True,
)(
    lambda v: near_duplicates.apply_review(
        v.catalogue(), similarity.verdicts(similarity.cluster_posts(v.images(), 18)), NOW
    ).posts.select("id", "published", "updated_at")
)

# --- catalogue changes ------------------------------------------------------------

RENAMES = """,
renames AS (SELECT DISTINCT source AS old, 'new_' || source AS new FROM documents),
renamed AS (SELECT p.id, coalesce(r.new, p.author) AS author, coalesce('https://x.com/' || r.new, p.author_url) AS author_url,
  CASE WHEN r.new IS NULL THEN p.post_url ELSE replace(replace(p.post_url, 'https://x.com/' || r.old || '/status/', 'https://x.com/' || r.new || '/status/'),
    'https://twitter.com/' || r.old || '/status/', 'https://x.com/' || r.new || '/status/') END AS post_url,
  CASE WHEN r.new IS NULL THEN p.title ELSE replace(p.title, '@' || r.old, '@' || r.new) END AS title
  FROM posts p LEFT JOIN renames r ON r.old = lower(p.author))"""
query("rename_account", RENAMES + " SELECT * FROM renamed")(lambda v: _renamed(v))


def _renamed(v: Views) -> DataFrame:
    wanted = v.table("documents").select(
        F.concat(F.lit("@"), "source").alias("old_name"), F.concat(F.lit("https://x.com/New_"), "source").alias("new_name")
    )
    after = maintenance.rename(v.catalogue(), wanted.distinct())
    return after.posts.select("id", "author", "author_url", "post_url", "title")


query(
    "rename_account_table",
    """,
pairs AS (SELECT lower(c_name) AS old, lower(c_mktsegment) || '_' || c_custkey AS new FROM customer)
SELECT a.id, p.new AS username FROM accounts a JOIN pairs p ON p.old = lower(a.username)""",
)(
    lambda v: accounts.rename_accounts(
        v.accounts(),
        accounts.valid_renames(
            v.accounts(),
            v.table("customer").select(
                F.col("c_name").alias("old_name"), F.concat_ws("_", "c_mktsegment", "c_custkey").alias("new_name")
            ),
        ),
    ).select("id", "username")
)
query(
    "add_accounts",
    """,
wanted AS (SELECT lower(s_name) AS username, s_suppkey AS seq FROM supplier UNION ALL SELECT lower(c_name), c_custkey FROM customer
  UNION ALL SELECT lower(source), doc_id FROM documents),
fresh AS (SELECT username, min(seq) AS seq FROM wanted WHERE username NOT IN (SELECT lower(username) FROM accounts) GROUP BY 1)
SELECT id, username, enabled, crawl_all FROM (SELECT id, username, CAST(enabled AS BIGINT) AS enabled, CAST(crawl_all AS BIGINT) AS crawl_all FROM accounts
  UNION ALL SELECT (SELECT max(id) FROM accounts) + row_number() OVER (ORDER BY seq, username), username, 1, 0 FROM fresh)""",
)(lambda v: _add_accounts(v))


def _add_accounts(v: Views) -> DataFrame:
    wanted = v.table("supplier").select(F.concat(F.lit("@"), "s_name").alias("input"), F.col("s_suppkey").alias("seq"))
    wanted = wanted.unionByName(v.table("customer").select(F.upper("c_name").alias("input"), F.col("c_custkey").alias("seq")))
    wanted = wanted.unionByName(v.table("documents").select(F.col("source").alias("input"), F.col("doc_id").alias("seq")))
    return accounts.add_accounts(v.accounts(), wanted, NOW).select("id", "username", "enabled", "crawl_all")


query(
    "account_flags",
    """,
flags AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS enabled,
  arg_max(1, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS crawl_all FROM orders GROUP BY 1)
SELECT a.id, CAST(coalesce(f.enabled, a.enabled) AS BIGINT) AS enabled, CAST(coalesce(f.crawl_all, a.crawl_all) AS BIGINT) AS crawl_all
FROM accounts a LEFT JOIN flags f ON f.o_custkey = a.id""",
)(
    lambda v: accounts.set_flags(
        v.accounts(),
        v.table("orders").select(
            F.concat(F.lit("Customer#"), F.lpad("o_custkey", 9, "0")).alias("input"),
            F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 0).alias("enabled"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("crawl_all"),
            F.col("o_orderkey").alias("seq"),
        ),
    ).select("id", "enabled", "crawl_all")
)
query(
    "delete_accounts",
    " SELECT id, username FROM accounts WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)(
    lambda v: accounts.delete_accounts(
        v.accounts(),
        v.table("orders")
        .filter("o_orderpriority = '1-URGENT'")
        .select(F.concat(F.lit("customer#"), F.lpad("o_custkey", 9, "0")).alias("input")),
    ).select("id", "username")
)
LINKS = """,
stored AS MATERIALIZED (SELECT DISTINCT l_suppkey * 1000000000 + l_orderkey AS id, 'acct' || l_suppkey AS account,
  CAST(CAST(CAST(2039917506295648359 + 1000 * l_orderkey AS DOUBLE) AS BIGINT) AS VARCHAR) AS stored_id FROM lineitem),
last_ids AS MATERIALIZED (SELECT account, CAST(tweet_id AS DOUBLE) AS num, arg_max(tweet_id, pos) AS true_id FROM timeline GROUP BY 1, 2),
repairs AS MATERIALIZED (SELECT s.id, s.stored_id, t.true_id, 'https://x.com/' || s.account || '/status/' || t.true_id AS new_url
  FROM stored s JOIN last_ids t ON t.account = s.account AND t.num = CAST(s.stored_id AS DOUBLE) WHERE t.true_id <> s.stored_id)"""


def _stored_links(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_suppkey", "l_orderkey").distinct()
    true_id = F.lit(2039917506295648359) + 1000 * F.col("l_orderkey")
    account = F.concat(F.lit("acct"), "l_suppkey")
    return rows.select(
        (F.col("l_suppkey") * 1000000000 + F.col("l_orderkey")).alias("id"),
        account.alias("author"),
        F.concat(F.lit("https://x.com/"), account, F.lit("/status/"), true_id.cast("double").cast("long")).alias("post_url"),
    )


query("link_repair", LINKS + " SELECT id, stored_id, true_id, new_url FROM repairs")(
    lambda v: accounts.link_repairs(_stored_links(v), v.timeline())
)
query(
    "link_repair_applied",
    LINKS
    + """
SELECT s.id, coalesce(r.new_url, 'https://x.com/' || s.account || '/status/' || s.stored_id) AS post_url FROM stored s LEFT JOIN repairs r ON r.id = s.id""",
)(
    lambda v: changes.set_links(
        _stored_links(v), accounts.link_repairs(_stored_links(v), v.timeline())
    ).select("id", "post_url")
)
query(
    "expire_pending",
    f""",
gone AS (SELECT id FROM posts WHERE published = 0 AND created_at < TIMESTAMP '{NOW_TEXT}' - INTERVAL 3 DAY),
rest AS (SELECT * FROM post_tags WHERE post_id NOT IN (SELECT id FROM gone)),
lost_keys AS (SELECT DISTINCT m.key FROM media m JOIN gone g ON g.id = m.id)
SELECT (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) FROM posts) - (SELECT count(*) FROM gone) AS n_posts,
  (SELECT count(*) FROM rest) AS n_links, (SELECT count(*) FROM tags WHERE id IN (SELECT tag_id FROM rest)) AS n_tags,
  (SELECT count(*) FROM assets WHERE post_id NOT IN (SELECT id FROM gone)) AS n_assets,
  (SELECT count(*) FROM lost_keys) AS keys,
  CAST((SELECT coalesce(sum(o.size), 0) FROM lost_keys k JOIN objects o ON o.key = k.key) AS BIGINT) AS freed_bytes""",
)(lambda v: _expired(v))


def _expired(v: Views) -> DataFrame:
    done = maintenance.cleanup(v.catalogue(), v.objects(), NOW)

    def n(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    cat = done.catalogue
    counts = {"deleted": done.deleted, "n_posts": cat.posts, "n_links": cat.post_tags, "n_tags": cat.tags, "n_assets": cat.assets}
    return done.freed.withColumns({name: n(df) for name, df in counts.items()})


query(
    "count_backfill",
    """
SELECT id, photo_count, video_count, CAST(1 AS BIGINT) AS media_count_version, (SELECT count(*) FROM posts WHERE doc_id % 4 = 0) AS updated FROM posts""",
)(lambda v: _count_backfill(v))


def _count_backfill(v: Views) -> DataFrame:
    stale = F.col("media_count_version") == 0
    before = v.posts().withColumns(
        {c: F.when(stale, 0).otherwise(F.col(c)) for c in ("photo_count", "video_count")}
    )
    report = changes.backfill_report(before, before)
    return changes.count_backfill(before).select("id", "photo_count", "video_count", "media_count_version").withColumn(
        "updated", report.select("updated").scalar()
    )


query("size_backfill", " SELECT id, photo_bytes, video_bytes, photo_count, video_count FROM posts")(
    lambda v: changes.size_backfill(
        v.posts().withColumns({"photo_bytes": F.lit(0).cast("long"), "video_bytes": F.lit(0).cast("long")}),
        v.objects(lost=False),
    ).select("id", "photo_bytes", "video_bytes", "photo_count", "video_count")
)
query("missing_objects", " SELECT DISTINCT key FROM media WHERE lost")(
    lambda v: changes.missing_objects(v.posts(), v.objects())
)
query(
    "approve_pending",
    " SELECT id, CAST(CASE WHEN l.toxic = 0 THEN 1 ELSE published END AS BIGINT) AS published FROM posts p LEFT JOIN labels l ON l.doc_id = p.doc_id",
)(
    lambda v: changes.approve(
        v.posts(), v.table("labels").filter("toxic = 0").select((F.col("doc_id") + 1).alias("id"))
    ).select("id", "published")
)
query(
    "approve_changed",
    " SELECT p.id FROM posts p JOIN labels l ON l.doc_id = p.doc_id WHERE l.toxic = 0 AND p.published = 0",
)(
    lambda v: changes.changed_rows(
        v.posts(),
        changes.approve(v.posts(), v.table("labels").filter("toxic = 0").select((F.col("doc_id") + 1).alias("id"))),
        ["published"],
    )
)
query(
    "delete_posts",
    """,
gone AS (SELECT doc_id + 1 AS id FROM labels WHERE toxic = 1)
SELECT p.id, (SELECT count(*) FROM post_tags pt WHERE pt.post_id = p.id) AS n_tags, (SELECT count(*) FROM assets a WHERE a.post_id = p.id) AS n_assets
FROM posts p WHERE p.id NOT IN (SELECT id FROM gone)""",
)(lambda v: _deleted(v))


def _deleted(v: Views) -> DataFrame:
    after = changes.delete_posts(
        v.catalogue(), v.table("labels").filter("toxic = 1").select((F.col("doc_id") + 1).alias("id"))
    )

    def per_post(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    joined = after.posts.select("id").join(per_post(after.post_tags, "n_tags"), "id", "left")
    joined = joined.join(per_post(after.assets, "n_assets"), "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tags", "n_assets")])


query(
    "upsert_hashes",
    """,
last AS (SELECT 'e' || (vec_id // 2) || '_1' AS key, arg_max(vec_id, vec_id) + 1 AS post_id, arg_max(hash, vec_id) AS hash FROM hashes GROUP BY 1),
fresh AS (SELECT l.*, row_number() OVER (ORDER BY key) AS rn FROM last l WHERE key NOT IN (SELECT key FROM assets))
SELECT a.key, coalesce(l.post_id, a.post_id) AS post_id, coalesce(l.hash, a.hash) AS hash FROM assets a LEFT JOIN last l ON l.key = a.key
UNION ALL SELECT key, post_id, hash FROM fresh""",
)(lambda v: _upserted(v))


def _upserted(v: Views) -> DataFrame:
    hashed = v.table("embeddings").select("vec_id", hashing.phash_from_coefficients("embedding").alias("hash"))
    new = hashed.select(
        (F.col("vec_id") + 1).alias("post_id"),
        F.concat(F.lit("e"), F.floor(F.col("vec_id") / 2), F.lit("_1")).alias("key"),
        F.upper(hashing.hash_to_hex("hash")).alias("phash"),
        F.col("vec_id").alias("seq"),
    )
    bad = new.withColumn("phash", F.lit("not a hash")).withColumn("seq", F.col("seq") + 10_000_000)
    after = changes.upsert_hashes(v.asset_rows(), new.unionByName(bad), NOW)
    return after.select("key", "post_id", hashing.hash_from_hex("phash").alias("hash"))


query(
    "insert_posts",
    """,
new AS (SELECT (SELECT max(id) FROM posts) + row_number() OVER (ORDER BY p_partkey) AS id, p_partkey, p_name, p_type, p_brand, p_size FROM part)
SELECT n.id, '@' || p_brand || ' 推文' AS title, p_brand AS author, 'https://x.com/' || p_brand AS author_url, CAST(1 AS BIGINT) AS photo_count,
  CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS video_count, CAST(1 AS BIGINT) AS published,
  (SELECT count(*) FROM (SELECT DISTINCT unnest(regexp_split_to_array(p_type || ' ' || p_name, '[\\s,]+')))) AS n_tags FROM new n""",
)(lambda v: _inserted(v))


def _new_posts(v: Views) -> DataFrame:
    photo = F.concat(F.lit("p"), "p_partkey", F.lit(".jpg"))
    video = F.when(F.col("p_size") > 25, F.concat(F.lit("p"), "p_partkey", F.lit(".mp4")))
    return v.table("part").select(
        F.col("p_partkey").alias("ref"),
        F.lit(None).cast("string").alias("title"),
        F.array_compact(F.array(photo, video)).alias("media_keys"),
        F.col("p_brand").alias("author"),
        F.lit(None).cast("string").alias("author_display_name"),
        F.lit("").alias("author_url"),
        F.lit(None).cast("string").alias("post_url"),
        F.col("p_name").alias("description"),
        F.lit(None).cast("timestamp").alias("created_at"),
        tagging.manual_tags(F.concat("p_type", F.lit(" "), "p_name")).alias("tag_names"),
    )


def _inserted(v: Views) -> DataFrame:
    after = changes.insert_posts(v.catalogue(), _new_posts(v), v.objects(), NOW)
    top = v.posts().agg(F.max("id")).scalar()
    n_tags = after.post_tags.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"))
    rows = after.posts.filter(F.col("id") > top).join(n_tags, "id", "left")
    return rows.select("id", "title", "author", "author_url", "photo_count", "video_count", "published", "n_tags")


query(
    "edit_posts",
    f""",
e AS (SELECT p.id, p.n_media FROM posts p JOIN labels l ON l.doc_id = p.doc_id WHERE l.quality = 0 AND p.n_media > 0),
k AS (SELECT m.id, string_agg(m.key, ',' ORDER BY m.pos) AS keys, coalesce(sum(o.size) FILTER (WHERE NOT video), 0) AS pb, coalesce(sum(o.size) FILTER (WHERE video), 0) AS vb
  FROM media m LEFT JOIN objects o ON o.key = m.key WHERE m.pos > 0 AND m.id IN (SELECT id FROM e) GROUP BY m.id)
SELECT p.id, CASE WHEN e.id IS NULL THEN p.media_keys ELSE coalesce(k.keys || ',', '') || 'extra' || p.id || '.gif' END AS media_keys,
  CAST(CASE WHEN e.id IS NULL THEN p.published ELSE 1 END AS BIGINT) AS published, CASE WHEN e.id IS NULL THEN p.title ELSE 'edited' END AS title,
  CASE WHEN e.id IS NULL THEN {stamp("p.updated_at")} ELSE '{NOW_TEXT}' END AS updated_at,
  CAST(CASE WHEN e.id IS NULL THEN p.photo_bytes ELSE coalesce(k.pb, 0) END AS BIGINT) AS photo_bytes,
  CAST(CASE WHEN e.id IS NULL THEN p.video_bytes ELSE coalesce(k.vb, 0) END AS BIGINT) AS video_bytes,
  CASE WHEN e.id IS NULL THEN (SELECT count(*) FROM post_tags pt WHERE pt.post_id = p.id) ELSE 2 END AS n_tags
FROM posts p LEFT JOIN e ON e.id = p.id LEFT JOIN k ON k.id = p.id""",
)(lambda v: _edited(v))


def _edited(v: Views) -> DataFrame:
    """Posts of low quality lose their first medium and get a new one."""
    poor = v.table("labels").filter("quality = 0").select((F.col("doc_id") + 1).alias("id"))
    chosen = v.posts().join(poor, "id", "left_semi").filter(F.size("media_keys") > 0)
    kept = F.slice("media_keys", 2, F.size("media_keys"))
    edits = chosen.select(
        "id",
        F.lit("edited").alias("title"),
        *["author", "author_display_name", "author_url", "post_url", "description"],
        kept.alias("kept_keys"),
        F.array(F.concat(F.lit("extra"), "id", F.lit(".gif"))).alias("added_keys"),
        F.array(F.lit("short"), F.lit("reviewed")).alias("tag_names"),
    )
    after = changes.edit_posts(v.catalogue(), edits, v.objects(), NOW)
    n_tags = after.post_tags.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"))
    return after.posts.join(n_tags, "id", "left").select(
        "id",
        F.array_join("media_keys", ",").alias("media_keys"),
        "published",
        "title",
        "updated_at",
        "photo_bytes",
        "video_bytes",
        "n_tags",
    )


# --- counters ---------------------------------------------------------------------

query(
    "like_counter_floor",
    """,
s AS (SELECT post_id, event_id, sum(delta) OVER w AS total FROM likes_log WINDOW w AS (PARTITION BY post_id ORDER BY ts, event_id))
SELECT post_id, event_id, CAST(total - least(0, min(total) OVER (PARTITION BY post_id ORDER BY l.ts, s.event_id)) AS BIGINT) AS value
FROM s JOIN likes_log l USING (post_id, event_id)""",
)(
    lambda v: counters.running_counter(counters.like_deltas(v.like_events()), "post_id", ["ts", "event_id"]).select(
        "post_id", "event_id", "value"
    )
)
LIKES_AFTER = """,
s AS (SELECT post_id, delta, sum(delta) OVER (PARTITION BY post_id ORDER BY ts, event_id) AS total FROM likes_log),
f AS (SELECT post_id, sum(delta) AS d, sum(delta) - min(total) AS fl FROM s GROUP BY 1)
SELECT p.id, CAST(CASE WHEN f.d IS NULL THEN p.likes ELSE greatest(p.likes + f.d, f.fl) END AS BIGINT) AS likes FROM posts p LEFT JOIN f ON f.post_id = p.id"""
query("likes_applied", LIKES_AFTER)(
    lambda v: counters.apply_likes(v.posts(), v.like_events(), ["ts", "event_id"]).select("id", "likes")
)
query(
    "storage_ledger",
    """,
moves AS (SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN -4 ELSE 1 END * trunc(value) AS BIGINT) AS bytes FROM events),
s AS (SELECT bytes, sum(bytes) OVER (ORDER BY event_id) AS total FROM moves)
SELECT CAST(greatest(500 + sum(bytes), sum(bytes) - min(total)) AS BIGINT) AS total_bytes FROM s""",
)(
    lambda v: ledger.counter_after(
        F.lit(500),
        v.table("events").select(
            "event_id",
            (
                F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "view", -4).otherwise(1)
                * F.col("value").cast("long")
            ).alias("bytes"),
        ),
        ["event_id"],
    )
)
query("like_stream", LIKES_AFTER)(lambda v: _like_stream(v))


def _like_stream(v: Views, spans: int = 6) -> DataFrame:
    """Events as a stream: a run for each span of time; the last batch is repeated."""
    root = fresh_path(v.spark, "like-stream")
    rows = v.table("events")
    kind = F.col("event_type")
    action = F.when(kind == "click", "like").when(kind == "error", "unlike").otherwise("other")
    log = like_stream_job.like_log(v.spark, f"{root}/log")

    def run() -> None:
        stream = v.spark.readStream.schema(rows.schema).parquet(f"{root}/feed/*")
        events = stream.select((F.col("user_id") + 1).alias("post_id"), action.alias("action"), "ts", "event_id")
        like_stream_job.start_like_stream(events, log, f"{root}/checkpoint", ["ts", "event_id"]).awaitTermination()

    ends = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (ends["high"] - ends["low"]) / spans
    cuts = [ends["low"] + step * k for k in range(spans)]
    for k, low in enumerate(cuts):
        span = F.col("ts") >= F.lit(low) if k else F.lit(True)
        span = span if k + 1 == spans else span & (F.col("ts") < F.lit(cuts[k + 1]))
        rows.filter(span).write.parquet(f"{root}/feed/span={k}")
        run()
    drop_path(v.spark, f"{root}/checkpoint/commits/{spans - 1}")
    run()
    return like_stream_job.current_likes(v.posts(), log).select("id", "likes")


# --- timelines and ingest ---------------------------------------------------------

ACCEPTED = """,
parts AS (SELECT *, regexp_extract(url, '/([0-9]+)[.?]', 1) AS media_id, CASE WHEN type = 'photo' THEN '.png' ELSE '.mp4' END AS ext FROM timeline),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, tweet_id, media_id ORDER BY pos) AS seen FROM parts) WHERE seen = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY account, tweet_id ORDER BY pos) AS nn FROM firsts)"""
query("timeline_dedupe", ACCEPTED + " SELECT account, tweet_id, media_id, url, type, date, ext FROM firsts")(
    lambda v: timeline.first_seen(timeline.accepted(v.timeline())).select(
        "account", "tweet_id", "media_id", "url", "type", "date", "ext"
    )
)
query(
    "timeline_ordinals",
    ACCEPTED + " SELECT account, tweet_id, media_id, nn, tweet_id || '_' || nn || ext AS file_name FROM numbered",
)(
    lambda v: timeline.with_ordinals(timeline.first_seen(timeline.accepted(v.timeline()))).select(
        "account", "tweet_id", "media_id", "nn", "file_name"
    )
)
LATEST = """,
latest AS (SELECT account, arg_min(tweet_id, pos) AS post_id, arg_min(date, pos) AS date FROM timeline GROUP BY account),
marks AS (SELECT account, arg_min(tweet_id, pos) AS post_id, arg_min(date, pos) AS date FROM timeline WHERE date < '2000-01-01' GROUP BY account
  UNION ALL SELECT 'acct' || s_suppkey, l.post_id, '' FROM supplier JOIN latest l ON l.account = 'acct' || s_suppkey WHERE s_acctbal < 0),
known AS (SELECT account, post_id, date FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date) AS rn FROM marks) WHERE rn = 1)"""


def _known(v: Views) -> DataFrame:
    """Stored marks: where the feed stood in 2000; indebted accounts are up to date."""
    items = v.timeline()
    old = timeline.latest_signature(items.filter("date < '2000-01-01'"))
    current = timeline.latest_signature(items).withColumn("date", F.lit(""))
    names = v.table("supplier").filter("s_acctbal < 0").select(F.concat(F.lit("acct"), "s_suppkey").alias("account"))
    fresh = current.join(names, "account", "left_semi")
    both = old.unionByName(fresh.select("account", "post_id", "date"))
    return both.groupBy("account").agg(F.min_by("post_id", "date").alias("post_id"), F.min("date").alias("date"))


query("timeline_latest", LATEST + " SELECT account, post_id, date FROM latest")(
    lambda v: timeline.latest_signature(v.timeline())
)
query(
    "timeline_unchanged",
    LATEST
    + " SELECT l.account FROM latest l JOIN known k ON k.account = l.account AND k.post_id = l.post_id WHERE k.date = '' OR l.date = '' OR k.date = l.date",
)(lambda v: timeline.unchanged_accounts(timeline.latest_signature(v.timeline()), _known(v)))
query(
    "timeline_newer",
    LATEST
    + """
SELECT t.account, t.tweet_id, count(*) AS n FROM timeline t LEFT JOIN known k ON k.account = t.account
WHERE k.post_id IS NULL OR CAST(t.tweet_id AS HUGEINT) > CAST(k.post_id AS HUGEINT) GROUP BY 1, 2""",
)(
    lambda v: timeline.newer_than_known(v.timeline(), _known(v))
    .groupBy("account", "tweet_id")
    .agg(F.count(F.lit(1)).alias("n"))
)
query(
    "timeline_post_meta",
    """
SELECT account, tweet_id, arg_min(content, pos) AS description, arg_min(date, pos) AS created_at, trim(arg_min(nick, pos)) AS nick FROM timeline GROUP BY 1, 2""",
)(lambda v: timeline.post_meta(v.timeline()))
query(
    "account_nicks",
    " SELECT account, coalesce(trim(arg_min(nick, pos) FILTER (WHERE trim(nick) <> '')), account) AS nick FROM timeline GROUP BY account",
)(lambda v: timeline.account_nicks(v.timeline()))
query(
    "media_mix",
    """
SELECT account, count(*) FILTER (WHERE type = 'photo') AS photos, count(*) FILTER (WHERE type = 'Video') AS videos,
  count(*) FILTER (WHERE type = 'animated_gif') AS gifs FROM timeline GROUP BY account""",
)(lambda v: timeline.media_mix(v.timeline()))

def _fetched(v: Views, items: DataFrame) -> DataFrame:
    """Fetch results by URL: some gifs of accounts ending in 9 fail, one video per account is too large."""
    url = F.col("url")
    size = F.when(F.contains(url, F.lit("/7.mp4")), 100_000_000).otherwise(F.length("url") * 1000)
    return items.select("url").distinct().select(
        "url", size.cast("long").alias("size"), (~F.contains(url, F.lit("9/13.gif"))).alias("ok")
    )


CRAWLED = (
    ACCEPTED
    + """,
archive AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS media_id FROM part WHERE p_brand = 'Brand#3' AND p_size < 5),
tried AS (SELECT *, CASE WHEN media_id IN (SELECT media_id FROM archive) THEN 'skipped' WHEN contains(url, '9/13.gif') THEN 'failed' ELSE 'downloaded' END AS status,
  CASE WHEN contains(url, '/7.mp4') THEN 100000000 ELSE length(url) * 1000 END AS size FROM numbered),
outcomes AS (SELECT account, tweet_id, count(*) FILTER (WHERE status = 'downloaded') AS downloaded, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'failed') AS failed, max(size) FILTER (WHERE status = 'downloaded') AS max_size FROM tried GROUP BY 1, 2),
judged AS (SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN downloaded = 0 THEN 'skipped' WHEN max_size > 99614720 THEN 'oversize' ELSE 'ready' END AS outcome FROM outcomes)"""
)


def _archive(v: Views) -> DataFrame:
    parts = v.table("part").filter("p_brand = 'Brand#3' and p_size < 5")
    return parts.select(F.col("p_size").cast("string").alias("media_id")).distinct()


def _outcomes(v: Views) -> DataFrame:
    items = v.timeline()
    wanted = timeline.with_ordinals(timeline.first_seen(timeline.accepted(items)))
    return timeline.post_outcomes(ingest.with_results(wanted, _archive(v), _fetched(v, items)))


query("post_outcomes", CRAWLED + " SELECT account, tweet_id, downloaded, skipped, failed, outcome FROM judged")(
    lambda v: _outcomes(v).drop("max_size")
)
TOTALS = """ SELECT account, CAST(sum(downloaded) AS BIGINT) AS downloaded,
  CAST(sum(skipped + CASE WHEN outcome = 'oversize' THEN downloaded ELSE 0 END) AS BIGINT) AS skipped,
  CAST(sum(CASE WHEN outcome IN ('ready', 'oversize') THEN downloaded ELSE 0 END) AS BIGINT) AS processed,
  CAST(sum(CASE WHEN outcome = 'ready' THEN downloaded ELSE 0 END) AS BIGINT) AS uploaded,
  CAST(sum(failed) AS BIGINT) AS failed, bool_and(failed = 0) AS advance FROM judged GROUP BY account"""
query("crawl_totals", CRAWLED + TOTALS)(lambda v: timeline.crawl_totals(_outcomes(v)))

# Feed of the ingest queries: sixth items without an id, seventh ones of a type that is not accepted; accounts
# of which some are switched off and some want their full history; marks of earlier runs.
ACTIVE = """,
active AS (SELECT 'acct' || s_suppkey AS account, s_suppkey % 3 = 0 AS full_history FROM supplier WHERE s_suppkey % 7 <> 3),
odd AS (SELECT * REPLACE (CASE WHEN content = 'item 6' THEN NULL ELSE tweet_id END AS tweet_id, CASE WHEN content = 'item 7' THEN 'text' ELSE type END AS type) FROM timeline)"""
HEADS = """,
heads AS (SELECT account, arg_min(tweet_id, pos) AS post_id, arg_min(date, pos) AS date FROM odd WHERE tweet_id IS NOT NULL GROUP BY account),
unchanged AS (SELECT h.account FROM heads h JOIN known k ON k.account = h.account AND k.post_id = h.post_id WHERE k.date = '' OR h.date = '' OR k.date = h.date)"""
NAMED = ", coalesce(o.tweet_id, 'undefined') AS tweet_id"
WANTED = f""",
wanted AS (SELECT o.* EXCLUDE (tweet_id){NAMED} FROM odd o JOIN active a ON a.account = o.account LEFT JOIN known k ON k.account = o.account
  WHERE o.account NOT IN (SELECT account FROM unchanged) AND o.type <> 'text'
  AND (a.full_history OR k.post_id IS NULL OR o.tweet_id IS NULL OR CAST(o.tweet_id AS HUGEINT) > CAST(k.post_id AS HUGEINT)))"""
FIRST_WANTED = f""",
wanted AS (SELECT o.* EXCLUDE (tweet_id){NAMED} FROM odd o JOIN active a ON a.account = o.account WHERE o.type <> 'text')"""
FROM_WANTED = CRAWLED.replace("AS ext FROM timeline)", "AS ext FROM wanted)")
BATCH = LATEST + ACTIVE + HEADS + WANTED + FROM_WANTED

CANDIDATES = (
    f""",
nicks AS (SELECT account, coalesce(trim(arg_min(nick, pos) FILTER (WHERE trim(nick) <> '')), account) AS nick FROM tried GROUP BY account),
files AS (SELECT t.account, t.tweet_id, string_agg(t.account || '_' || t.tweet_id || '_' || t.nn || t.ext, ',' ORDER BY t.nn) AS media_keys,
  arg_min(t.tweet_id || '_' || t.nn || t.ext, t.nn) AS first_file,
  count(*) FILTER (WHERE t.ext = '.png') AS photo_count, count(*) FILTER (WHERE t.ext = '.mp4') AS video_count,
  coalesce(sum(t.size) FILTER (WHERE t.ext = '.png'), 0) AS photo_bytes, coalesce(sum(t.size) FILTER (WHERE t.ext = '.mp4'), 0) AS video_bytes
  FROM tried t JOIN judged j USING (account, tweet_id) WHERE j.outcome = 'ready' AND t.status = 'downloaded' GROUP BY 1, 2),
metas AS (SELECT account, tweet_id, CASE WHEN tweet_id = 'undefined' THEN '' ELSE arg_min(content, pos) END AS description,
  CASE WHEN tweet_id = 'undefined' THEN '2024-01-05 12:30:00' ELSE arg_min(date, pos) END AS date, CASE WHEN tweet_id = 'undefined' THEN '' ELSE trim(arg_min(nick, pos)) END AS nick FROM tried GROUP BY 1, 2),
candidates AS (SELECT f.*, m.description, m.date, coalesce(nullif(m.nick, ''), n.nick) AS nick, CASE WHEN f.tweet_id = 'undefined' THEN '' ELSE 'https://x.com/' || f.account || '/status/' || f.tweet_id END AS post_url
  FROM files f JOIN metas m USING (account, tweet_id) JOIN nicks n USING (account)),
stored_posts AS (SELECT DISTINCT 'acct' || l_suppkey AS author, CASE WHEN l_linenumber = 1 THEN 'https://x.com/acct' || l_suppkey || '/status/' || (2039917506295648359 + 1000 * l_orderkey) ELSE '' END AS post_url,
    'acct' || l_suppkey || '_' || (2039917506295648359 + 1000 * l_orderkey) || '_1.mp4' AS key
  FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45),
fresh AS (SELECT c.* FROM candidates c WHERE post_url NOT IN (SELECT post_url FROM stored_posts WHERE post_url <> '')
  AND NOT EXISTS (SELECT 1 FROM stored_posts s WHERE s.author = c.account AND lower(s.key) LIKE '%' || lower(c.first_file) || '%'))"""
)


INGESTED = BATCH + CANDIDATES


def _feed(items: DataFrame) -> DataFrame:
    """Sixth items lose their id, seventh ones get a type that is not accepted."""
    return items.withColumns(
        {
            "tweet_id": F.when(F.col("content") != "item 6", F.col("tweet_id")),
            "type": F.when(F.col("content") == "item 7", "text").otherwise(F.col("type")),
        }
    )


def _ingest_state(v: Views) -> ingest.IngestState:
    """Earlier posts: those of large returned items; half of them lost their URL."""
    li = v.table("lineitem").filter("l_linestatus = 'F' and l_quantity > 45")
    author = F.concat(F.lit("acct"), "l_suppkey")
    true_id = F.lit(2039917506295648359) + 1000 * F.col("l_orderkey")
    url = F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), true_id)
    stored = li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("id"),
        author.alias("author"),
        F.when(F.col("l_linenumber") == 1, url).otherwise("").alias("post_url"),
        F.array(F.concat(author, F.lit("_"), true_id, F.lit("_1.mp4"))).alias("media_keys"),
    )
    names = v.table("supplier").select(
        F.concat(F.lit("Acct"), "s_suppkey").alias("username"),
        (F.col("s_suppkey") % 7 != 3).cast("int").alias("enabled"),
        (F.col("s_suppkey") % 3 == 0).cast("int").alias("crawl_all"),
    )
    return ingest.IngestState(stored, v.tags(), _archive(v), _known(v), names)


def _ingest_rules(v: Views) -> list[tagging.Rule]:
    rows = [(n, f"item {n}", None, "word", f"item {n}") for n in range(1, 8)]
    return tagging.load_rules(v.spark.createDataFrame(rows, v.rules().schema))


query(
    "ingest_new_posts",
    INGESTED
    + f"""
SELECT account AS author, '@' || account || ' 推文' AS title, nick AS author_display_name, post_url, description, date AS created_at, media_keys,
  photo_count, video_count, CAST(photo_bytes AS BIGINT) AS photo_bytes, CAST(video_bytes AS BIGINT) AS video_bytes, CAST(1 AS BIGINT) AS published,
  nullif(description, '') AS tag_name FROM fresh""",
)(lambda v: _ingested(v))


def _ingested(v: Views) -> DataFrame:
    items = _feed(v.timeline())
    state = _ingest_state(v)
    new = ingest.ingest_pages(items, state, _fetched(v, items), _ingest_rules(v), NOW)
    names = state.tags.unionByName(new.tags).select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    named = new.post_tags.join(names, "tag_id").select(F.col("post_id").alias("id"), "tag_name")
    return new.posts.join(named, "id", "left").select(
        "author",
        "title",
        "author_display_name",
        "post_url",
        "description",
        "created_at",
        F.array_join("media_keys", ",").alias("media_keys"),
        "photo_count",
        "video_count",
        "photo_bytes",
        "video_bytes",
        "published",
        "tag_name",
    )


query(
    "ingest_marks",
    BATCH
    + """
SELECT account, post_id, date FROM heads WHERE account IN (SELECT account FROM active) AND account NOT IN (SELECT account FROM judged WHERE failed > 0)""",
)(
    lambda v: _marked(_feed(v.timeline()), _ingest_state(v), _fetched(v, v.timeline()))
)
query(
    "crawl_json_records",
    """
SELECT 'acct' || l_suppkey AS account, CAST(2039917506295648359 + 1000 * l_orderkey AS VARCHAR) AS tweet_id, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)(lambda v: _json_records(v))


def _marked(items: DataFrame, state: ingest.IngestState, fetched: DataFrame) -> DataFrame:
    tried = ingest.tried_items(items, state, fetched)
    return ingest.new_marks(items, state, ingest.judged_posts(tried, NOW))


def _json_records(v: Views) -> DataFrame:
    """Timeline rows packed to JSON arrays per shipment day and unpacked again."""
    from pyspark.sql import types as T

    record = F.struct("account", "tweet_id")
    packed = v.timeline().withColumn("day", F.substring("date", 1, 10)).select(
        "day", F.to_json(F.array(record)).alias("payload")
    )
    schema = T.StructType([T.StructField("account", T.StringType()), T.StructField("tweet_id", T.StringType())])
    rows = tables.records(packed, "payload", schema, keep=["day"])
    return rows.groupBy("account", "tweet_id").agg(F.count(F.lit(1)).alias("n"))


# The stream: five batches by year of shipment, each a run of its own, onto stored posts, archive and marks.  Media
# ids of an account come again after 300 items; ids ending in 13 fail as gifs, those ending in 77 are too large as videos.
STREAM_YEARS = ((0, 1993), (1994, 1994), (1995, 1995), (1996, 1996), (1997, 9999))
STREAM_FEED = """
feed AS (
  SELECT account, pos, CASE WHEN line = 6 THEN NULL ELSE tweet_id END AS tweet_id, CASE WHEN line = 7 THEN 'text' ELSE type END AS type, url, date, content, nick, b
  FROM (SELECT 'acct' || l_suppkey AS account, l_linenumber AS line,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS pos,
      CAST(2039917506295648359 + 1000 * l_orderkey AS VARCHAR) AS tweet_id,
      'https://media.example/' || l_suppkey || '/' || (l_suppkey * 1000 + (7 * l_orderkey + l_linenumber) % 300) || CASE l_returnflag WHEN 'A' THEN '?format=png' WHEN 'N' THEN '.mp4?tag=1' ELSE '.gif' END AS url,
      CASE l_returnflag WHEN 'A' THEN 'photo' WHEN 'N' THEN 'Video' ELSE 'animated_gif' END AS type,
      strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date, 'item ' || l_linenumber AS content,
      CASE WHEN l_linestatus = 'O' THEN ' Nick ' || l_suppkey ELSE '' END AS nick,
      CASE WHEN year(l_shipdate) <= 1993 THEN 0 WHEN year(l_shipdate) >= 1997 THEN 4 ELSE year(l_shipdate) - 1993 END AS b
    FROM lineitem)),
active AS (SELECT 'acct' || s_suppkey AS account, s_suppkey % 3 = 0 AS full_history FROM supplier WHERE s_suppkey % 7 <> 3),
marks0 AS (
  SELECT account, arg_min(tweet_id, pos) AS post_id, '' AS date FROM feed
  WHERE b = 0 AND tweet_id IS NOT NULL AND account IN (SELECT 'acct' || s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY account),
archive0 AS (SELECT DISTINCT CAST(s_suppkey * 1000 + 5 AS VARCHAR) AS media_id FROM supplier),
stored0 AS (SELECT DISTINCT 'acct' || l_suppkey AS author, CASE WHEN l_linenumber = 1 THEN 'https://x.com/acct' || l_suppkey || '/status/' || (2039917506295648359 + 1000 * l_orderkey) ELSE '' END AS post_url,
    'acct' || l_suppkey || '_' || (2039917506295648359 + 1000 * l_orderkey) || '_1.mp4' AS key
  FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45)"""
STREAM_STEP = """,
heads{k} AS MATERIALIZED (SELECT account, arg_min(tweet_id, pos) AS post_id, arg_min(date, pos) AS date FROM feed WHERE b = {k} AND tweet_id IS NOT NULL GROUP BY account),
unchanged{k} AS (SELECT h.account FROM heads{k} h JOIN marks{k} m ON m.account = h.account AND m.post_id = h.post_id WHERE m.date = '' OR h.date = '' OR m.date = h.date),
wanted{k} AS MATERIALIZED (
  SELECT f.* EXCLUDE (tweet_id, b), coalesce(f.tweet_id, 'undefined') AS tweet_id, regexp_extract(url, '/([0-9]+)[.?]', 1) AS media_id, CASE WHEN type = 'photo' THEN '.png' ELSE '.mp4' END AS ext
  FROM feed f JOIN active a ON a.account = f.account LEFT JOIN marks{k} m ON m.account = f.account
  WHERE f.b = {k} AND f.account NOT IN (SELECT account FROM unchanged{k}) AND f.type <> 'text'
    AND (a.full_history OR m.post_id IS NULL OR f.tweet_id IS NULL OR CAST(f.tweet_id AS HUGEINT) > CAST(m.post_id AS HUGEINT))),
tried{k} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY account, tweet_id ORDER BY pos) AS nn,
    CASE WHEN media_id IN (SELECT media_id FROM archive{k}) THEN 'skipped' WHEN contains(url, '13.gif') THEN 'failed' ELSE 'downloaded' END AS status,
    CASE WHEN contains(url, '77.mp4') THEN 100000000 ELSE length(url) * 1000 END AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY account, tweet_id, media_id ORDER BY pos) AS seen FROM wanted{k}) WHERE seen = 1),
judged{k} AS MATERIALIZED (
  SELECT account, tweet_id, count(*) FILTER (WHERE status = 'failed') AS failed,
    CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'downloaded') = 0 THEN 'skipped'
      WHEN max(size) FILTER (WHERE status = 'downloaded') > 99614720 THEN 'oversize' ELSE 'ready' END AS outcome
  FROM tried{k} GROUP BY 1, 2),
nicks{k} AS (SELECT account, coalesce(trim(arg_min(nick, pos) FILTER (WHERE trim(nick) <> '')), account) AS nick FROM tried{k} GROUP BY account),
metas{k} AS (
  SELECT account, tweet_id, CASE WHEN tweet_id = 'undefined' THEN '' ELSE arg_min(content, pos) END AS description,
    CASE WHEN tweet_id = 'undefined' THEN '' ELSE trim(arg_min(nick, pos)) END AS nick FROM tried{k} GROUP BY 1, 2),
files{k} AS (
  SELECT t.account, t.tweet_id, list(t.account || '_' || t.tweet_id || '_' || t.nn || t.ext ORDER BY t.nn) AS keys, arg_min(t.tweet_id || '_' || t.nn || t.ext, t.nn) AS first_file,
    count(*) FILTER (WHERE t.ext = '.png') AS photo_count, count(*) FILTER (WHERE t.ext = '.mp4') AS video_count
  FROM tried{k} t JOIN judged{k} j USING (account, tweet_id) WHERE j.outcome = 'ready' AND t.status = 'downloaded' GROUP BY 1, 2),
candidates{k} AS MATERIALIZED (
  SELECT f.*, m.description, coalesce(nullif(m.nick, ''), n.nick) AS nick, CASE WHEN f.tweet_id = 'undefined' THEN '' ELSE 'https://x.com/' || f.account || '/status/' || f.tweet_id END AS post_url
  FROM files{k} f JOIN metas{k} m USING (account, tweet_id) JOIN nicks{k} n USING (account)),
met{k} AS (
  SELECT DISTINCT c.account, c.tweet_id FROM candidates{k} c JOIN stored{k} s ON s.author = c.account WHERE lower(s.key) LIKE '%' || lower(c.first_file) || '%'),
fresh{k} AS MATERIALIZED (
  SELECT c.* FROM candidates{k} c ANTI JOIN met{k} USING (account, tweet_id)
  WHERE c.post_url NOT IN (SELECT post_url FROM stored{k} WHERE post_url <> '')),
news{k} AS (SELECT * FROM heads{k} WHERE account IN (SELECT account FROM active) AND account NOT IN (SELECT account FROM judged{k} WHERE failed > 0)),
marks{n} AS MATERIALIZED (SELECT * FROM news{k} UNION ALL SELECT * FROM marks{k} ANTI JOIN news{k} USING (account)),
archive{n} AS MATERIALIZED (
  SELECT media_id FROM archive{k} UNION
  SELECT t.media_id FROM tried{k} t JOIN judged{k} j USING (account, tweet_id) WHERE t.status = 'downloaded' AND j.outcome IN ('ready', 'oversize')),
stored{n} AS MATERIALIZED (SELECT * FROM stored{k} UNION ALL SELECT account, post_url, unnest(keys) FROM fresh{k})"""
STREAM_STATES = STREAM_FEED + "".join(STREAM_STEP.replace("{k}", str(k)).replace("{n}", str(k + 1)) for k in range(len(STREAM_YEARS)))
STREAM_ROWS = " UNION ALL ".join(
    f"""
SELECT CAST({k} AS BIGINT) AS batch, account AS author, post_url, nick AS author_display_name, array_to_string(keys, ',') AS media_keys, photo_count, video_count,
  nullif(description, '') AS tag_name FROM fresh{k}"""
    for k in range(len(STREAM_YEARS))
)
query("ingest_stream", f", {STREAM_STATES} {STREAM_ROWS}")(lambda v: _streamed_posts(v))
def _stream_rows(li: DataFrame) -> DataFrame:
    """Timeline rows of a batch, with media ids of the stream's own."""
    rows = Views.timeline_rows(li)
    number = F.substring("account", 5, 20).cast("long") * 1000 + (F.col("pos.l_linenumber") - 7 * F.col("pos.o")) % 300
    url = F.regexp_replace("url", F.lit(r"/[0-9]+(?=[.?])"), F.concat(F.lit("/"), number))
    return _feed(rows.withColumn("url", url))


def _stream_fetched(items: DataFrame) -> DataFrame:
    url = F.col("url")
    size = F.when(F.contains(url, F.lit("77.mp4")), 100_000_000).otherwise(F.length("url") * 1000)
    return items.select("url").distinct().select("url", size.cast("long").alias("size"), (~F.contains(url, F.lit("13.gif"))).alias("ok"))


def _stream_seed(v: Views, log: ingest_stream_job.IngestLog) -> None:
    """Earlier posts as in `_ingest_state`; marks of indebted accounts; one archived medium of every account."""
    given = {f.name: F.lit(None) for f in POSTS.fields} | {c: F.lit(0) for c in ("photo_count", "video_count", "media_count_version")}
    posts = _ingest_state(v).posts
    posts = posts.select(*[(F.col(f.name) if f.name in posts.columns else given[f.name]).cast(f.dataType).alias(f.name) for f in POSTS.fields])
    supplier = v.table("supplier")
    names = supplier.filter("s_acctbal < 0").select(F.concat(F.lit("acct"), "s_suppkey").alias("account"))
    first = _stream_rows(v.table("lineitem").filter(F.year("l_shipdate") <= STREAM_YEARS[0][1]))
    marks = timeline.latest_signature(first).join(names, "account", "left_semi").withColumn("date", F.lit(""))
    media = supplier.select((F.col("s_suppkey") * 1000 + 5).cast("string").alias("media_id"))
    links = v.spark.createDataFrame([], "post_id long, tag_id long")
    ingest_stream_job.seed_catalogue(log, Catalogue(posts, v.tags(), links), media, marks)


def _ingest_stream(v: Views, watch=None, replay: bool = True) -> ingest_stream_job.IngestLog:
    """Line items as a stream onto a seeded catalogue: a run for each span of years; the last batch is repeated.

    The repeat is that of a job that died after it stored a batch and before Spark noted that: the batch's
    entry among the checkpoint's commits is taken away, so the next run does it again.
    """
    root = fresh_path(v.spark, "ingest-stream")
    li = v.table("lineitem")
    log = ingest_stream_job.ingest_log(v.spark, f"{root}/log")
    _stream_seed(v, log)
    accounts = _ingest_state(v).accounts

    def run() -> None:
        stream = v.spark.readStream.schema(li.schema).parquet(f"{root}/feed/*")
        ingest_stream_job.start_ingest_stream(
            stream, log, f"{root}/checkpoint", accounts, _stream_fetched, _ingest_rules(v), now=lambda: NOW, to_rows=_stream_rows, watch=watch
        ).awaitTermination()

    for k, (first, last) in enumerate(STREAM_YEARS):
        li.filter(F.year("l_shipdate").between(first, last)).write.parquet(f"{root}/feed/span={k}")
        run()
    if replay:
        drop_path(v.spark, f"{root}/checkpoint/commits/{len(STREAM_YEARS) - 1}")
        run()
    return log


def _streamed_posts(v: Views) -> DataFrame:
    log = _ingest_stream(v)
    tags = log.read("tags").select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    named = log.read("post_tags").select("post_id", "tag_id").join(tags, "tag_id").select(F.col("post_id").alias("id"), "tag_name")
    return log.read("posts").filter("batch >= 0").join(named, "id", "left").select(
        "batch", "author", "post_url", "author_display_name", F.array_join("media_keys", ",").alias("media_keys"), "photo_count", "video_count", "tag_name"
    )


query(
    "known_names",
    CRAWLED
    + CANDIDATES
    + " SELECT c.account, c.tweet_id FROM candidates c WHERE EXISTS (SELECT 1 FROM stored_posts s WHERE s.author = c.account AND lower(s.key) LIKE '%' || lower(c.first_file) || '%')",
)(lambda v: _known_names(v))


def _known_names(v: Views) -> DataFrame:
    items = v.timeline()
    tried = ingest.with_results(
        timeline.with_ordinals(timeline.first_seen(timeline.accepted(items))), _archive(v), _fetched(v, items)
    )
    tried = materialise(tried.select("account", "tweet_id", "nn", "file_name", "status", "size"), "tried")
    ready = timeline.post_outcomes(tried).filter("outcome = 'ready'").select("account", "tweet_id")
    files = tried.filter("status = 'downloaded'").join(ready, ["account", "tweet_id"], "left_semi")
    first = files.groupBy("account", "tweet_id").agg(F.min_by("file_name", "nn").alias("name"))
    new = first.withColumns({"ref": F.struct("account", "tweet_id"), "author": F.col("account")})
    return ingest.names_in_keys(new, _ingest_state(v).posts).select("ref.account", "ref.tweet_id")

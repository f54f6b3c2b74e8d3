"""Composed jobs end to end, and the plans Spark chooses for them."""

from datetime import datetime

import pytest

from shutterlake.operators import filters, similarity
from shutterlake.plans import near_duplicates, overview, pages
from shutterlake.schema import POSTS, TABLES
from shutterlake.sources import tables
from shutterlake.sources.snapshots import Snapshots
from tests.test_catalogue import catalogue, post

NOW = datetime(2024, 2, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_review_of_stored_hashes(spark):
    hashes = {1: "0" * 16, 2: "0" * 15 + "1", 3: "f" * 16, 4: "0" * 16, 5: "bad"}
    assets = [(i, i, f"k{i}.jpg", None, h, 1, None) for i, h in hashes.items()]
    cat = catalogue(spark, [post(i, f"k{i}.jpg", likes=i, published=int(i != 4)) for i in hashes], assets=assets)
    found = near_duplicates.review(cat, 3)
    assert {r.post_id: r.verdict for r in found.verdicts.collect()} == {1: "pending", 2: "keeper", 3: "keeper"}
    assert found.total.first()[0] == 1
    sample = found.samples.first()
    assert (sample.preferred_post, sample.candidate_post, sample.similarity) == (2, 1, "98.4%")
    after = near_duplicates.apply_review(cat, found.verdicts, NOW)
    assert {r.id for r in after.posts.filter("published = 1").collect()} == {2, 3, 5}


def test_hash_backfill_retries_failures(spark):
    cat = catalogue(
        spark,
        [post(1, "a.jpg,v.mp4,b.jpg"), post(2, "c.jpg,d.jpg"), post(3, "e.jpg", published=0)],
        assets=[(1, 1, "a.jpg", None, "0" * 16, 1, None)],
    )
    square = [(i * 7919) % 256 for i in range(1024)]
    pixels = spark.createDataFrame([("b.jpg", square), ("c.jpg", [1, 2, 3])], "key string, pixels array<int>")
    rows = {r.key: r for r in near_duplicates.hash_new_media(cat, pixels).collect()}
    assert set(rows) == {"b.jpg", "c.jpg", "d.jpg"}
    assert rows["b.jpg"].phash is not None and rows["b.jpg"].reason is None
    assert rows["c.jpg"].reason == "unexpected pixel format" and rows["d.jpg"].reason == "image missing or unreadable"
    after = near_duplicates.hash_backfill(cat, pixels, NOW)
    assert after.assets.count() == 2
    assert {r.key for r in similarity.unhashed_media(after.posts, after.assets).collect()} == {"c.jpg", "d.jpg"}
    assert near_duplicates.hash_new_media(cat, pixels, limit=1).count() == 1


def test_tables_and_layout(spark, tmp_path):
    cat = catalogue(spark, [post(i, published=i % 2, created_at=datetime(2024, 1, 1 + i)) for i in range(1, 20)], [(1, "x")], [(1, 1)])
    for name in ("posts", "tags", "post_tags", "assets", "accounts"):
        getattr(cat, name).write.parquet(str(tmp_path / name))
    read = tables.read_catalogue(spark, str(tmp_path))
    assert read.posts.schema.fieldNames() == POSTS.fieldNames() and read.posts.count() == 19
    tables.write_by_state(cat.posts, str(tmp_path / "laid"))
    laid = spark.read.schema(TABLES["posts"]).parquet(str(tmp_path / "laid"))
    rows = pages.feed_rows(laid, cat.post_tags, cat.tags, after=("2024-01-10 00:00:00", 3))
    plan = plan_of(pages.page_ids(rows, pages.time_order("newest"), 5))
    assert "PartitionFilters: [isnotnull(published" in plan and "description" not in plan
    page = pages.feed_page(laid, cat.post_tags, cat.tags, limit=3)
    assert [r.id for r in page.items.collect()] == [19, 17, 15]
    assert "In(id, [" in plan_of(page.items)
    tables.write_rows(pages.cards(page.items), str(tmp_path / "json"))
    assert {r.id for r in spark.read.json(str(tmp_path / "json")).collect()} == {19, 17, 15}


def test_overview_follows_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), {"posts": POSTS})
    store.publish({"posts": spark.createDataFrame([post(1), post(2, published=0)], POSTS)}, 0)
    assert overview.known_total(overview.stored_overview(store), 1) == 1
    store.publish({"posts": spark.createDataFrame([post(1), post(2), post(3)], POSTS)}, 1)
    stored = overview.stored_overview(store)
    assert overview.known_total(stored, 1) == 3
    cat = catalogue(spark, [post(i) for i in range(1, 4)])
    page = pages.admin_page(cat.posts, cat.post_tags, cat.tags, limit=2, known_total=overview.known_total(stored, 1))
    assert (page.total, page.has_more, page.showing_start, page.showing_end) == (3, True, 1, 2)
    names = overview.directory(cat.posts, cat.tags, public=False)
    assert [r.author for r in names.authors.collect()] == ["ann"]


def test_top_per_author_limits_before_the_shuffle(spark):
    posts = catalogue(spark, [post(i, author="ab"[i % 2]) for i in range(1, 30)]).posts
    top = pages.newest_per(posts, "author", 2)
    assert "WindowGroupLimit" in plan_of(top)
    assert sorted(r.id for r in top.collect()) == [26, 27, 28, 29]


def test_keyword_over_tags_is_an_existence_join(spark):
    cat = catalogue(spark, [post(1), post(2)], [(7, "Needle")], [(2, 7)])
    rows = pages.search_rows(cat.posts, cat.post_tags, cat.tags, q="eEdL")
    assert "ExistenceJoin" in plan_of(rows) and [r.id for r in rows.collect()] == [2]


def test_id_filters(spark):
    posts = catalogue(spark, [post(i) for i in range(1, 6)]).posts
    assert posts.filter(filters.id_range(1, 3)).count() == 2
    ids = spark.createDataFrame([(2,), (9,)], "id long")
    assert [r.id for r in filters.with_ids(posts, ids).collect()] == [2]
    assert posts.filter(filters.several_media()).count() == 0


@pytest.mark.parametrize("name", ["feed_newest", "author_overview_rollup", "like_counter_floor"])
def test_registered_queries_match_sql(spark, name):
    import __spark_entry__ as entry
    from workload.check import compare, connect

    sf_dir = "/root/testdata/sf0.001"
    result = compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok") and "TYPES" not in result

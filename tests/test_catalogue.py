"""Pages, duplicates, changes and audits on literal catalogues."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import accounts, audits, changes, counters, dedup, filters, overview, skew, tagging
from shutterlake.plans import maintenance, pages
from shutterlake.schema import ACCOUNTS, ASSETS, POST_TAGS, POSTS, TAGS, Catalogue

NOW = datetime(2024, 2, 1)


def post(id, keys="a.jpg", author="ann", **over):
    keys = [k for k in keys.split(",") if k]
    videos = sum(k.endswith((".mp4", ".mov")) for k in keys)
    row = dict(
        id=id, title=f"@{author} #{id}", media_keys=keys, author=author, author_display_name=None,
        author_url=f"https://x.com/{author}", post_url=f"https://x.com/{author}/status/{id}", description="text",
        likes=0, created_at=datetime(2024, 1, 1, 0, id % 60), updated_at=None, published=1, photo_bytes=0, video_bytes=0,
        photo_count=len(keys) - videos, video_count=videos, media_count_version=1,
    )
    row.update(over)
    return tuple(row[f] for f in POSTS.fieldNames())


def catalogue(spark, posts, tags=(), links=(), assets=(), account_rows=()):
    return Catalogue(
        spark.createDataFrame(posts, POSTS),
        spark.createDataFrame(list(tags), TAGS),
        spark.createDataFrame(list(links), POST_TAGS),
        spark.createDataFrame(list(assets), ASSETS),
        spark.createDataFrame(list(account_rows), ACCOUNTS),
    )


def objects(spark, **etags):
    rows = [(k.replace("__", "."), e, s) for k, (e, s) in etags.items()]
    return spark.createDataFrame(rows, "key string, etag string, size long")


def test_feed_pages_follow_each_other(spark):
    cat = catalogue(spark, [post(i, published=int(i != 3), created_at=datetime(2024, 1, 1, i // 4)) for i in range(1, 31)])
    seen, after = [], None
    while True:
        page = pages.feed_page(cat.posts, cat.post_tags, cat.tags, after=after, limit=7)
        seen += [r.id for r in page.items.collect()]
        if not page.has_more:
            break
        after = page.next_key
    assert seen == [i for i in range(30, 0, -1) if i != 3]
    assert [r.page for r in pages.feed_index(cat.posts, 7).orderBy("page").collect()] == [1, 2, 3, 4, 5]
    plan = pages.page_ids(cat.posts, pages.time_order("newest"), 49)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_limits_and_bad_parameters(spark):
    assert (pages.feed_limit(100), pages.feed_limit(), pages.search_limit(500), pages.admin_limit(0), pages.admin_limit(500)) == (48, 48, 96, 10, 100)
    with pytest.raises(ValueError):
        pages.time_order("random")
    with pytest.raises(ValueError):
        pages.feed_limit(0)


def test_author_tags_are_hidden_and_sorted(spark):
    cat = catalogue(
        spark, [post(1), post(2, author="Bob", published=0)], [(1, "z"), (2, "ANN"), (3, "a,b"), (4, "bob")], [(1, 1), (1, 2), (1, 3), (1, 4)]
    )
    public = pages.feed_page(cat.posts, cat.post_tags, cat.tags).items.first()
    assert public.tags == ["a,b", "bob", "z"]
    admin = pages.admin_page(cat.posts, cat.post_tags, cat.tags)
    assert admin.items.first().tags == ["a,b", "z"] and (admin.total, admin.has_more) == (1, False)


def test_overview_golden(spark):
    rows = [post(i, keys="a.jpg" if i < 4 else "b.mp4", photo_bytes=1500 if i < 4 else 0, video_bytes=0 if i < 4 else 13000) for i in range(1, 5)]
    rows += [post(5, author="bob"), post(6, author="bob", published=0)]
    got = {r.author: r for r in overview.author_overview(spark.createDataFrame(rows, POSTS)).collect()}
    assert (got[None].posts, got[None].published, got[None].pending, got[None].photos, got[None].videos) == (6, 5, 1, 5, 1)
    assert (got["ann"].photo_bytes, got["ann"].video_bytes) == (4500, 13000)
    empty = overview.author_overview(spark.createDataFrame([], POSTS)).collect()
    assert [r.posts for r in empty] in ([], [0])


def test_copies_keep_exact_status_id(spark):
    url = "https://x.com/ann/status/77"
    cat = catalogue(
        spark,
        [post(1, "m1.jpg", post_url=url, likes=9), post(2, "ann_77_1.jpg", post_url=url, published=0), post(3, "other.jpg", post_url=url)],
        [(1, "x"), (2, "y")],
        [(1, 1), (2, 2)],
    )
    store = objects(spark, m1__jpg=("e", 10), ann_77_1__jpg=("e", 11), other__jpg=("f", 12))
    fixes = dedup.post_fixes(cat.posts, store)
    assert [tuple(r) for r in fixes.losers.collect()] == [(url, 2, 1)]
    assert [tuple(r) for r in fixes.keys.collect()] == [(2, "m1.jpg", 10, False)]
    after = maintenance.remove_copies(cat, store)
    kept = {r.id: r for r in after.posts.collect()}
    assert set(kept) == {2, 3} and (kept[2].likes, kept[2].published, kept[2].photo_bytes) == (9, 1, 11)
    assert {(r.post_id, r.tag_id) for r in after.post_tags.collect()} == {(2, 1), (2, 2)}


def test_stale_or_partial_fixes_are_refused(spark):
    url = "https://x.com/ann/status/77"
    posts = [post(i, f"m{i}.jpg", post_url=url) for i in (1, 2, 3)]
    cat = catalogue(spark, posts)
    same = objects(spark, m1__jpg=("e", 1), m2__jpg=("e", 1), m3__jpg=("f", 1))
    approved = spark.createDataFrame([(url, 1, 2), (url, 1, 3)], "post_url string, keep_id long, delete_id long")
    assert dedup.apply_post_fixes(cat, same, approved).posts.count() == 3
    assert dedup.apply_post_fixes(cat, same, approved.filter("delete_id = 2")).posts.count() == 2


def test_equal_media_inside_a_post(spark):
    cat = catalogue(spark, [post(1, "a.jpg,b.mp4,c.jpg,lost.jpg")])
    store = objects(spark, a__jpg=("e", 5), b__mp4=("g", 7), c__jpg=("e", 6))
    found = dedup.duplicate_media(cat.posts, store)
    assert [tuple(r) for r in found.collect()] == [(1, "a.jpg", "c.jpg", 2, 6)]
    row = dedup.apply_media_fixes(cat, store, found).posts.first()
    assert row.media_keys == ["a.jpg", "b.mp4", "lost.jpg"] and (row.photo_bytes, row.video_bytes, row.photo_count) == (5, 7, 2)


def test_size_backfill_is_all_or_nothing(spark):
    posts = spark.createDataFrame([post(1, "a.jpg"), post(2, "b.mp4"), post(3, "")], POSTS)
    rows = changes.size_backfill(posts, objects(spark, a__jpg=("e", 5), b__mp4=("f", 7))).orderBy("id").collect()
    assert [(r.photo_bytes, r.video_bytes) for r in rows] == [(5, 0), (0, 7), (0, 0)]
    with pytest.raises(Exception, match="objects are missing"):
        changes.size_backfill(posts, objects(spark, a__jpg=("e", 5))).collect()


def test_expiry_removes_posts_links_and_orphans(spark):
    old, edge = datetime(2024, 1, 28, 23, 59, 59), datetime(2024, 1, 29)
    cat = catalogue(
        spark,
        [post(1, published=0, created_at=old), post(2, published=0, created_at=edge), post(3, created_at=old)],
        [(1, "only1"), (2, "shared")],
        [(1, 1), (1, 2), (3, 2)],
        [(9, 1, "a.jpg", None, None, 1, None)],
    )
    done = maintenance.cleanup(cat, objects(spark, a__jpg=("e", 5)), NOW)
    assert [r.id for r in done.deleted.collect()] == [1]
    assert {r.id for r in done.catalogue.posts.collect()} == {2, 3}
    assert [r.name for r in done.catalogue.tags.collect()] == ["shared"]
    assert done.catalogue.assets.count() == 0 and tuple(done.freed.first()) == (1, 5)


def test_approve_and_pending_touch_only_matching_rows(spark):
    posts = spark.createDataFrame([post(1), post(2, published=0), post(3)], POSTS)
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in changes.changed_rows(posts, changes.approve(posts, ids), ["published"]).collect()] == [2]
    after = {r.id: r for r in changes.send_to_pending(posts, ids, NOW).collect()}
    assert [after[i].published for i in (1, 2, 3)] == [0, 0, 1]
    assert after[1].updated_at is not None and after[2].updated_at is None


def test_edits_are_checked(spark):
    cat = catalogue(spark, [post(1, "a.jpg,b.jpg"), post(2)], [(1, "x")], [(1, 1)])
    fields = "id long, title string, author string, author_display_name string, author_url string, post_url string, description string, kept_keys array<string>, added_keys array<string>, tag_names array<string>"
    base = ("t", "ann", None, None, None, None)
    edits = spark.createDataFrame(
        [(1, *base, ["b.jpg"], ["c.mp4"], ["y"]), (2, *base, ["nope"], [], []), (7, *base, [], ["x"], [])], fields
    )
    problems = {r.id: r.problem for r in changes.checked_edits(cat.posts, edits).collect()}
    assert problems == {1: None, 2: "key does not belong to the post", 7: "no such post"}
    after = changes.edit_posts(cat, edits, objects(spark, b__jpg=("e", 3)), NOW)
    row = after.posts.filter("id = 1").first()
    assert row.media_keys == ["b.jpg", "c.mp4"] and (row.photo_count, row.video_count, row.photo_bytes) == (1, 1, 3)
    names = after.post_tags.join(after.tags, F.col("tag_id") == F.col("id")).collect()
    assert [(r.post_id, r.name) for r in names] == [(1, "y")]


def test_rename_both_hosts_and_title(spark):
    accs = [(1, "Old", 1, 0, None, None, None, 0, None, None), (2, "taken", 1, 0, None, None, None, 0, None, None)]
    cat = catalogue(
        spark,
        [post(1, author="OLD", post_url="https://twitter.com/old/status/5", title="by @old and @OLD"), post(2, author="older", post_url="https://x.com/old/status/5")],
        account_rows=accs,
    )
    renames = spark.createDataFrame([("@old", "New"), ("old", "TAKEN")], "old_name string, new_name string")
    after = maintenance.rename(cat, renames)
    row = after.posts.filter("id = 1").first()
    assert (row.author, row.post_url, row.title) == ("new", "https://x.com/new/status/5", "by @new and @OLD")
    assert after.posts.filter("id = 2").first().author == "older"
    assert {r.username for r in after.accounts.collect()} == {"new", "taken"}


def test_link_repair_takes_last_equal_double(spark):
    base = 2039917506295648256
    posts = spark.createDataFrame([post(1, post_url=f"https://x.com/ann/status/{base}"), post(2, post_url="https://x.com/ann/status/12")], POSTS)
    items = spark.createDataFrame([("ann", str(base + 3), 1), ("ann", str(base + 5), 2), ("ann", "12", 3)], "account string, tweet_id string, pos long")
    rows = accounts.link_repairs(posts, items).collect()
    assert [(r.id, r.new_url) for r in rows] == [(1, f"https://x.com/ann/status/{base + 5}")]


def test_crawl_results(spark):
    accs = spark.createDataFrame([(1, "Ann", 1, 1, None, None, None, 0, "old", None), (2, "bob", 1, 1, None, None, None, 0, None, None)], ACCOUNTS)
    fields = "username string, run_type string, crawl_mode string, new_images int, error string, finished_at timestamp, seq int"
    results = spark.createDataFrame([(" @ANN", "manual", "all", -5, None, NOW, 1), ("bob", "x", "all", 3, " " + "e" * 2000, NOW, 1)], fields)
    got = {r.id: r for r in accounts.merge_crawl_results(accs, results).collect()}
    assert (got[1].crawl_all, got[1].last_crawl_count, got[1].last_crawl_error, got[1].last_crawl_type) == (0, 0, None, "manual")
    assert (got[2].crawl_all, len(got[2].last_crawl_error), got[2].last_crawl_type) == (1, 1000, "auto")


def test_floored_counter(spark):
    events = spark.createDataFrame([(1, i, d) for i, d in enumerate((1, -1, -1, 1, 1, -1))], "post_id long, seq long, delta long")
    got = counters.running_counter(events, "post_id", ["seq"]).orderBy("seq").collect()
    assert [r.value for r in got] == [1, 0, 0, 1, 2, 1]
    folded = counters.fold_deltas(events, "post_id", ["seq"]).first()
    for start in range(4):
        value = start
        for d in (1, -1, -1, 1, 1, -1):
            value = max(0, value + d)
        assert max(start + folded.delta_sum, folded.delta_floor) == value


def test_numbering_and_salted_join_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"c{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {(r.k, r.v): r.rn for r in skew.number_rows(df, ["v"], keys=["k"]).collect()}
    want, seen = {}, {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[(k, v)] = seen[k]
    assert got == want
    assert [r.rn for r in skew.number_rows(df, ["v"]).orderBy("v").collect()] == list(range(1, 601))
    right = spark.createDataFrame([("hot", "H"), ("c0", "C"), ("none", "N")], "k string, w string")
    hot = skew.hot_keys(df, ["k"], min_rows=100)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        salted = skew.salted_join(df, right, ["k"], hot, ["v"], how).select("k", "v", "w")
        assert sorted(map(str, salted.collect())) == sorted(map(str, df.join(right, "k", how).select("k", "v", "w").collect()))


def test_tag_rules(spark):
    rows = [
        (1, "flat", None, "substring", "ok"), (2, "Work", None, "word", "play"), (3, "Hero", "Work", "word", "kisaki"),
        (4, "Villain", "Work", "regex", "b[ae]d"), (5, "Other", None, "substring", "東"),
    ]
    rules = tagging.load_rules(spark.createDataFrame(rows, tagging.RULES))
    cases = {"": [], None: [], "BOOK": ["flat"], "kisakiちゃん book": ["flat", "Work", "Hero"], "display 東京": ["Other"], "bad play": ["Work", "Villain"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tagging.tag_column("t", rules).alias("tags"))
    assert {r.t: r.tags for r in df.collect()} == cases


def test_tag_backfill_is_idempotent(spark):
    rules = tagging.load_rules(spark.createDataFrame([(1, "new", None, "substring", "ext"), (2, "old", None, "substring", "ext")], tagging.RULES))
    cat = catalogue(spark, [post(1), post(2, description=None)], [(5, "old")], [(1, 5)])
    once, report = changes.tag_backfill(cat, rules)
    assert tuple(report.first()) == (2, 1) and {(r.id, r.name) for r in once.tags.collect()} == {(5, "old"), (6, "new")}
    assert tuple(changes.tag_backfill(once, rules)[1].first()) == (2, 0)


def test_manual_tags(spark):
    df = spark.createDataFrame([(" #a, b　##c,,a ",)], "t string")
    assert df.select(tagging.manual_tags("t")).first()[0] == ["a", "b", "#c"]


@pytest.mark.parametrize(
    ("rows", "recent"),
    [([("schedule", "2024-02-01T00:00:00Z")], True), ([("schedule", "2024-01-31T22:59:59Z")], False), ([("manual", "2024-01-31T23:30:00Z")], False), ([("schedule", "junk")], False), ([], False)],
)
def test_recent_run(spark, rows, recent):
    assert filters.recent_run(spark.createDataFrame(rows, "event string, created_at string"), "schedule", NOW).first().recent is recent


def test_transcode_and_verdicts(spark):
    fields = "key long, is_valid boolean, duration double, codec string, size long"
    originals = spark.createDataFrame([(i, True, 100.0, "hevc", 10_000) for i in range(7)], fields)
    outputs = spark.createDataFrame(
        [(0, True, 100.0, "H264", 8500), (1, False, 100.0, "h264", 5000), (2, True, 100.0, "vp9", 5000), (3, True, 100.0, "h264", 1023), (4, True, 94.9, "h264", 5000), (5, True, 95.0, "h264", 8501)], fields
    )
    got = {r.key: (r.reason, r.saved_bytes) for r in audits.transcode_audit(originals, outputs).collect()}
    assert got == {0: (None, 1500), 1: ("invalid output", 0), 2: ("wrong codec", 0), 3: ("output too small", 0), 4: ("duration differs", 0), 5: ("too little saved", 0), 6: ("no output", 0)}
    media = spark.createDataFrame([(1, "a.jpg"), (1, "b.mp4"), (2, "c.jpg"), (3, "d.mp4")], "post_id long, key string")
    verdicts = spark.createDataFrame([(1, "a.jpg", False), (3, "d.mp4", False)], "post_id long, key string, passes boolean")
    got = {r.post_id: (r.publish, r.reasons) for r in audits.post_verdicts(media, verdicts).collect()}
    assert got == {1: (False, ["a.jpg: non-portrait"]), 2: (True, []), 3: (True, ["video-only post"])}

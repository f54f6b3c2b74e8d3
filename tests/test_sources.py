"""Files, snapshots and streams."""

import json
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions.hashing import phash_from_coefficients, signed
from shutterlake.operators import ingest, tagging
from shutterlake.schema import ACCOUNTS, POSTS
from shutterlake.plans import near_duplicates
from shutterlake.sources import folder_import, images, listing, tables, timeline
from shutterlake.sources.snapshots import BatchLog, Snapshots
from shutterlake.streaming import ingest as ingest_job
from shutterlake.streaming import likes
from tests.test_catalogue import catalogue, post

NOW = datetime(2024, 2, 1)


def bmp(path, grey):
    """Write a 24-bit image from a square of grey values."""
    n = len(grey)
    body = b"".join(bytes(v for g in row for v in (g, g, g)) + b"\0" * (-3 * n % 4) for row in reversed(grey))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
    path.write_bytes(head + struct.pack("<IiiHHIIiiII", 40, n, n, 1, 24, 0, len(body), 0, 0, 0, 0) + body)


def plain_hash(grey):
    """Direct cosine sums, without the separable form."""
    n, out = 32, []
    c = lambda u: 1 / np.sqrt(2) if u == 0 else 1.0
    x = np.arange(n)
    for u in range(8):
        for v in range(8):
            w = np.cos((2 * x[:, None] + 1) * u * np.pi / 64) * np.cos((2 * x[None, :] + 1) * v * np.pi / 64)
            out.append(0.25 * c(u) * c(v) * float((np.array(grey) * w).sum()))
    ordered = sorted(out)
    median = (ordered[31] + ordered[32]) / 2
    return signed(sum(1 << i for i, value in enumerate(out) if value > median))


def test_image_hashes_from_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    want = {}
    for i in range(5):
        grey = rng.integers(0, 256, (32, 32)).tolist()
        bmp(tmp_path / f"{i}.bmp", grey)
        want[f"{i}.bmp"] = plain_hash(grey)
    (tmp_path / "broken.bmp").write_bytes(b"no image")
    pixels = images.read_pixels(spark, str(tmp_path))
    hashed = images.dct_coefficients(pixels).select("key", phash_from_coefficients("coefficients").alias("h"))
    assert {r.key: r.h for r in hashed.collect()} == want


def test_only_listed_images_without_a_hash_are_opened(spark, tmp_path):
    grey = {f"{n}.bmp": np.random.default_rng(k).integers(0, 256, (32, 32)).tolist() for k, n in enumerate(("a[1]", "b {x}*?", "c", "d"))}
    for name, rows in grey.items():
        bmp(tmp_path / name, rows)
    (tmp_path / "bad.bmp").write_bytes(b"no image")
    posts = [post(1, "bad.bmp,a[1].bmp"), post(2, "b {x}*?.bmp,c.bmp,gone.bmp"), post(3, "c.bmp"), post(4, "d.bmp", published=0)]
    cat = catalogue(spark, posts, assets=[(1, 9, "other.bmp", None, "0" * 16, 1, None)])
    run = near_duplicates.hash_listed_media(cat, str(tmp_path), limit=2)
    assert run.opened == 2 and {(r.key, r.phash is None) for r in run.hashed.collect()} == {("a[1].bmp", False), ("bad.bmp", True)}
    cat = near_duplicates.store_hashes(cat, run.hashed, NOW)
    failed = run.hashed.filter("phash is null")
    run = near_duplicates.hash_listed_media(cat, str(tmp_path), skip=failed)
    assert run.opened == 2 and {(r.post_id, r.key) for r in run.hashed.collect()} == {(2, "b {x}*?.bmp"), (2, "c.bmp"), (3, "c.bmp")}
    cat = near_duplicates.store_hashes(cat, run.hashed, NOW)
    stored = {r.key: int(r.phash, 16) for r in cat.assets.collect()}
    for name in ("a[1].bmp", "b {x}*?.bmp", "c.bmp"):
        assert stored[name] == plain_hash(grey[name]) % 2**64
    last = near_duplicates.hash_listed_media(cat, str(tmp_path), skip=failed)
    assert last.opened == 0 and last.hashed.count() == 0
    assert near_duplicates.hash_listed_media(cat, str(tmp_path)).opened == 1  # what failed is tried again
    listed = images.list_images(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString() and listed.count() == 5


def test_runs_over_one_backlog_list_the_folder_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    for k in range(7):
        bmp(tmp_path / f"v{k}.bmp", rng.integers(0, 256, (32, 32)).tolist())
    (tmp_path / "bad.bmp").write_bytes(b"no image")
    posts = [post(1, "bad.bmp,v0.bmp"), post(2, "v1.bmp,v2.bmp,gone.bmp"), post(3, "v2.bmp,v3.bmp"), post(4, "v4.bmp", published=0), post(5, "v5.bmp,v6.bmp")]
    cat = catalogue(spark, posts, assets=[(1, 5, "v6.bmp", None, "0" * 16, 1, None)])
    one = {(r.post_id, r.key, r.phash, r.reason) for r in near_duplicates.hash_listed_media(cat, str(tmp_path)).hashed.collect()}
    listings = []
    monkeypatch.setattr(images, "list_images", lambda *a, real=images.list_images: listings.append(1) or real(*a))
    backlog = near_duplicates.hash_backlog(cat, str(tmp_path))
    runs = []
    while (run := near_duplicates.hash_listed_media(cat, str(tmp_path), limit=2, backlog=backlog)).opened:
        runs.append((run.opened, {(r.post_id, r.key, r.phash, r.reason) for r in run.hashed.collect()}))
    assert len(listings) == 1 and [n for n, _ in runs] == [2, 2, 2]
    assert [{k for _, k, _, _ in rows} for _, rows in runs] == [{"bad.bmp", "v0.bmp"}, {"v1.bmp", "v2.bmp"}, {"v3.bmp", "v5.bmp"}]
    assert set().union(*(rows for _, rows in runs)) == one and len(one) == 7
    assert run.hashed.count() == 0
    assert {(r.post_id, r.key, r.phash, r.reason) for r in backlog.hashed().collect()} == one


def test_larger_images_shrink_by_area(spark, tmp_path):
    small = np.arange(1024).reshape(32, 32) % 251
    bmp(tmp_path / "big.bmp", np.kron(small, np.ones((3, 3), dtype=int)).tolist())
    row = images.read_pixels(spark, str(tmp_path)).first()
    assert row.pixels == small.ravel().tolist()


def test_inventory_and_folder_import(spark, tmp_path):
    for name in ("ann_20260403_040647_2039917506295648359_02.jpg", "ann_20260403_040647_2039917506295648359_01.PNG", "solo.jpg", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = {r.key: r.size for r in tables.list_objects(spark, str(tmp_path), with_etag=False).collect()}
    assert found["solo.jpg"] == 8 and len(found) == 4
    posts = {r.ref: r for r in folder_import.group_files(folder_import.list_photos(spark, str(tmp_path))).collect()}
    post = posts["ann_20260403_040647_2039917506295648359"]
    assert post.post_url == "https://x.com/ann/status/2039917506295648359" and len(post.media_keys) == 2
    assert post.created_at == datetime(2026, 4, 3) and "solo.jpg" in posts


def test_json_records(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ("[]",)], "j string")
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert [r.a for r in tables.records(df, "j", schema).collect()] == [1, 2]


def test_snapshots_move_only_on_change(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), {"t": spark.range(1).schema})
    assert store.version() == -1 and store.read("t").count() == 0
    assert store.publish_if_changed({"t": spark.range(3)}, spark.range(1)) == 0
    assert store.publish_if_changed({"t": spark.range(9)}, spark.range(0)) == 0
    calls = []

    def build():
        calls.append(1)
        return store.read("t").agg(F.count("*").alias("n"))

    assert [store.derived("n", build).first().n for _ in range(2)] == [3, 3] and len(calls) == 1
    (tmp_path / "s" / "v=7" / "t").mkdir(parents=True)
    assert store.version() == 0


def write_pages(path, name, pages):
    (path / name).write_text("\n".join(json.dumps(p) for p in pages))


def item(tweet, url, kind="photo", date="2024-01-02 03:04:05", nick=" Nick "):
    return {"tweet_id": tweet, "url": url, "type": kind, "date": date, "content": " hello ", "user": {"nick": nick}}


@pytest.fixture
def crawl(spark, tmp_path):
    """Run the ingest stream over all files so far; the given media names fail."""
    source = tmp_path / "pages"
    source.mkdir()
    log = ingest_job.ingest_log(spark, str(tmp_path / "log"))
    accounts = spark.createDataFrame(
        [(1, "Ann", 1, 0, None, None, None, 0, None, None), (2, "off", 0, 0, None, None, None, 0, None, None)], ACCOUNTS
    )
    rules = tagging.load_rules(spark.createDataFrame([(1, "greet", None, "substring", "hello")], tagging.RULES))

    def run(failing=()):
        def fetched(items):
            ok = ~F.col("url").rlike("|".join(failing) or "^$")
            return items.select("url").distinct().select("url", F.lit(10).cast("long").alias("size"), ok.alias("ok"))

        stream = timeline.stream_pages(spark, str(source))
        ingest_job.start_ingest_stream(
            stream, log, str(tmp_path / "checkpoint"), accounts, fetched, rules, now=lambda: NOW
        ).awaitTermination()
        return ingest_job.current_catalogue(log)

    return source, log, run


def test_ingest_stream_end_to_end(spark, crawl):
    source, log, run = crawl
    big = "2039917506295648359"
    first = [item(big, "https://h/m/A?format=png"), item(big, "https://h/m/A?format=png"), item(big, "https://h/m/B.mp4", "video"), item("5", "https://h/m/C", "text")]
    write_pages(source, "1.json", [{"account": "Ann", "page": 0, "media": first}, {"account": "off", "page": 0, "media": [item("9", "https://h/m/Z")]}])
    cat = run()
    row = cat.posts.first()
    assert cat.posts.count() == 1
    assert row.media_keys == [f"ann_{big}_1.png", f"ann_{big}_2.mp4"] and row.post_url.endswith(big)
    assert (row.title, row.author_display_name, row.description, row.photo_bytes, row.video_bytes) == ("@ann 推文", "Nick", "hello", 10, 10)
    assert [r.name for r in cat.tags.collect()] == ["greet"] and cat.post_tags.count() == 1
    assert ingest_job.current_marks(log).first().post_id == big
    # The same newest post again: the account is skipped.
    write_pages(source, "2.json", [{"account": "ann", "page": 0, "media": first}])
    assert run().posts.count() == 1
    # A failed item drops its whole post, and the mark stays where it was.
    newer = str(int(big) + 1)
    write_pages(source, "3.json", [{"account": "ann", "page": 0, "media": [item(newer, "https://h/m/D"), item(newer, "https://h/m/E"), *first]}])
    assert run(failing=("/E",)).posts.count() == 1
    assert ingest_job.current_marks(log).first().post_id == big
    # Next time it succeeds.
    write_pages(source, "4.json", [{"account": "ann", "page": 0, "media": [item(newer, "https://h/m/D"), item(newer, "https://h/m/E"), *first]}])
    cat = run()
    assert cat.posts.count() == 2 and cat.posts.select("id").distinct().count() == 2
    assert ingest_job.current_marks(log).first().post_id == newer


def test_replaying_a_batch_adds_nothing(spark):
    rows = [("ann", i, str(100 + i), f"https://h/m/{i}", "photo", "2024-01-01", "hello", "") for i in range(3)]
    items = spark.createDataFrame(rows, "account string, pos long, tweet_id string, url string, type string, date string, content string, nick string")
    accounts = spark.createDataFrame([(1, "ann", 1, 1, None, None, None, 0, None, None)], ACCOUNTS)
    fetched = items.select("url", F.lit(5).cast("long").alias("size"), F.lit(True).alias("ok"))
    none = spark.createDataFrame([], "account string, post_id string, date string")
    empty = ingest.IngestState(
        spark.createDataFrame([], POSTS), spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "media_id string"), none, accounts
    )
    once = ingest.ingest_pages(items, empty, fetched, [], NOW)
    assert once.posts.count() == 3
    # Even without archive and marks, stored posts are recognised by link or by file name.
    for stored in (once.posts, once.posts.withColumn("post_url", F.lit(""))):
        again = ingest.ingest_pages(items, empty._replace(posts=stored), fetched, [], NOW)
        assert again.posts.count() == 0 and again.report.first().uploaded == 0


def test_names_in_keys(spark):
    new = spark.createDataFrame([("1", "a", "b.jpg"), ("2", "a", "long-file-name-01.jpg"), ("3", "b", "b.jpg"), ("4", "a", "zz")], "ref string, author string, name string")
    posts = spark.createDataFrame([("a", ["x_b.jpg.png"]), ("a", ["x_long-file-name-01.jpg", "y"]), ("b", ["c.jpg"])], "author string, media_keys array<string>")
    assert sorted(r.ref for r in ingest.names_in_keys(new, posts).collect()) == ["1", "2"]


def test_names_in_keys_follow_like(spark):
    names = [("1", "a", "123_1.JPG"), ("2", "a", "12_4_1.jpg"), ("3", "b", "123_1.jpg"), ("4", "a", "___"), ("5", "c", "____"), ("6", "a", "4_1.jpg")]
    new = spark.createDataFrame(names, "ref string, author string, name string")
    posts = spark.createDataFrame([("a", ["x_123_1.jpg"]), ("b", ["x_1234.jpg"]), ("c", ["abc"])], "author string, media_keys array<string>")
    found = ingest.names_in_keys(new, posts)
    # An underscore is any character, letters of ASCII are equal in either case.
    assert sorted(r.ref for r in found.collect()) == ["1", "4"]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_items_without_id_are_one_post_and_do_not_block(spark):
    rows = [("ann", 0, "100", "https://h/m/0", "photo", "2024-01-01", "hello", "N"), ("ann", 1, None, "https://h/m/1", "photo", "no date", "text", "M"), ("ann", 2, "x7", "https://h/m/2", "photo", "no date", "t", "M")]
    items = spark.createDataFrame(rows, "account string, pos long, tweet_id string, url string, type string, date string, content string, nick string")
    accounts = spark.createDataFrame([(1, "ann", 1, 1, None, None, None, 0, None, None)], ACCOUNTS)
    fetched = items.select("url", F.lit(5).cast("long").alias("size"), F.lit(True).alias("ok"))
    none = spark.createDataFrame([], "account string, post_id string, date string")
    empty = ingest.IngestState(
        spark.createDataFrame([], POSTS), spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "media_id string"), none, accounts
    )
    new = ingest.ingest_pages(items, empty, fetched, [], NOW)
    report = new.report.first()
    assert (report.uploaded, report.failed, report.advance) == (3, 0, True)
    posts = {r.media_keys[0]: r for r in new.posts.collect()}
    assert set(posts) == {"ann_100_1.jpg", "ann_undefined_1.jpg", "ann_x7_1.jpg"}
    plain = posts["ann_undefined_1.jpg"]
    assert (plain.post_url, plain.description, plain.created_at, plain.author_display_name) == ("", "", NOW.replace(tzinfo=None), "N")


def test_marks_compare_ids_of_any_length(spark):
    from shutterlake.operators.timeline import newer_than_known

    big = "9" * 45
    items = spark.createDataFrame([("a", big, ""), ("a", "1" + "0" * 45, ""), ("a", "0009", ""), ("b", "7", "")], "account string, tweet_id string, date string")
    marks = spark.createDataFrame([("a", big, "")], "account string, post_id string, date string")
    assert sorted(r.tweet_id for r in newer_than_known(items, marks).collect()) == ["1" + "0" * 45, "7"]


def test_marks_join_without_sorting_the_items(spark):
    from shutterlake.operators.timeline import newer_than_known

    items = spark.range(1000).selectExpr("concat('a', id % 7) AS account", "cast(id AS string) AS tweet_id", "'' AS date")
    marks = spark.createDataFrame([("a1", "500", ""), ("a2", None, "")], "account string, post_id string, date string")
    newer = newer_than_known(items, marks)
    assert newer.count() == sum(i % 7 != 1 or i > 500 for i in range(1000))
    plan = newer._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("ShuffledHashJoin", "")


def test_session_bounds_what_a_task_reads(spark):
    from shutterlake.session import tune

    session = spark.newSession()
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.openCostInBytes")
    for name, value in zip(names, ("128MB", "1m", "4194304b"), strict=True):
        session.conf.set(name, value)
    tune(session)
    assert [session.conf.get(n) for n in names] == [str(8 << 20), "1m", str(64 << 10)]  # smaller values stay


def test_small_objects_share_tasks(spark, tmp_path):
    for k in range(1200):
        (tmp_path / f"f{k % 40}").mkdir(exist_ok=True)
        (tmp_path / f"f{k % 40}" / f"d{k}.txt").write_bytes(b"x" * (1 + k % 9))
    found = tables.list_objects(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= max(12, 2 * spark.sparkContext.defaultParallelism)
    assert {(r.key, r.size) for r in found.collect()} == {(f"d{k}.txt", 1 + k % 9) for k in range(1200)}


def test_the_driver_holds_no_listing(spark, tmp_path):
    for name in ("a/b c/1.txt", "a/2%20.txt", "3é.txt", "a/_skip/4.txt", ".5.txt", "_6.txt", "_k=1/7.txt", "8+.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "none").mkdir()
    found = tables.list_objects(spark, str(tmp_path))
    old = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    rows = {(r.path, r.key, r.etag, r.size) for r in old.select("path", F.regexp_extract("path", r"([^/]+)\z", 1).alias("key"), F.md5("content").alias("etag"), F.col("length").alias("size")).collect()}
    assert {r.key for r in found.collect()} == {"1.txt", "2%20.txt", "3é.txt", "7.txt", "8+.txt"}
    assert {tuple(r) for r in found.collect()} == {r[1:] for r in rows}
    assert {(r.path, r.size) for r in listing.list_files(spark, f"file://{tmp_path}").collect()} == {(r[0], r[3]) for r in rows}


def test_items_worth_fetching_are_shuffled_once(spark):
    rows = [(f"a{k % 5}", k, str(100 + k // 3) if k % 11 else None, f"http://x/{k % 7}.jpg", "photo", "2024-01-01 00:00:00", "t", "n") for k in range(200)]
    items = spark.createDataFrame(rows, "account string, pos long, tweet_id string, url string, type string, date string, content string, nick string")
    names = spark.createDataFrame([("A0", 1, 0), ("a1", 1, 1), ("a2", 0, 0), ("a3", 1, 0), ("a4", 1, 1), ("gone", 1, 0)], "username string, enabled int, crawl_all int")
    marks = spark.createDataFrame([("a0", "140", ""), ("a1", "140", "x"), ("a3", "101", ""), ("a4", "100", "")], "account string, post_id string, date string")
    state = ingest.IngestState(None, None, None, marks, names)
    found = ingest.fetch_list(items, state)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The items and the accounts asked for; no further shuffle by post or account.
    assert plan.count("Exchange hashpartitioning(account") == 2
    heads = {a: min((p, t) for x, p, t, *_ in rows if x == a and t)[1] for a in ("a0", "a1", "a3", "a4")}
    mark = {"a0": "140", "a1": "140", "a3": "101", "a4": "100"}
    same = {a for a in heads if heads[a] == mark[a]}
    full = {"a1", "a4"}
    wanted = {}
    for a, p, t, url, *_ in rows:
        if a in heads and a not in same and (a in full or t is None or int(t) > int(mark[a])):
            wanted.setdefault((a, t or "undefined"), {}).setdefault(url, p)
    want = {(a, t, p, n) for (a, t), urls in wanted.items() for n, p in enumerate(sorted(urls.values()), 1)}
    assert same and {(r.account, r.tweet_id, r.pos, r.nn) for r in found.collect()} == want


def test_like_log_survives_replay(spark, tmp_path):
    posts = spark.createDataFrame([(1, 0), (2, 5)], "id long, likes long")
    log = likes.like_log(spark, str(tmp_path / "log"))
    source = tmp_path / "events"
    source.mkdir()

    def run(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("post_id", "action", "seq"), r))) for r in rows))
        stream = spark.readStream.schema("post_id long, action string, seq long").json(str(source))
        likes.start_like_stream(stream, log, str(tmp_path / "cp"), ["seq"]).awaitTermination()
        return {r.id: r.likes for r in likes.current_likes(posts, log).collect()}

    assert run("a.json", [(1, "unlike", 1), (1, "like", 2), (2, "unlike", 3)]) == {1: 1, 2: 4}
    assert run("b.json", [(1, "unlike", 4), (1, "unlike", 5), (1, "like", 6), (3, "like", 7)]) == {1: 1, 2: 4}
    folds = log.read("folds").filter("batch = 1").drop("batch").toPandas()
    log.append(1, {"folds": spark.createDataFrame(folds)})
    assert {r.id: r.likes for r in likes.current_likes(posts, log).collect()} == {1: 1, 2: 4}


def test_batch_log_reads_only_earlier_batches(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "l"), {"t": spark.range(1).schema})
    for n in range(3):
        log.append(n, {"t": spark.range(n, n + 1)})
    assert sorted(r.id for r in log.read("t", before=2).collect()) == [0, 1]

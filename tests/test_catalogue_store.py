"""Changes that write only the buckets they touch."""

import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import changes
from shutterlake.schema import POST_TAGS, POSTS, TAGS
from shutterlake.sources.catalogue_store import CatalogueStore
from tests.test_catalogue import catalogue, post


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def sized(spark, rows):
    return spark.createDataFrame(
        [post(i, likes=likes, published=published, photo_bytes=size) for i, (likes, published, size) in rows.items()], POSTS
    )


def put(new):
    """Insert or replace whole posts."""
    return lambda cat: cat._replace(posts=cat.posts.join(new.select("id"), "id", "left_anti").select(*cat.posts.columns).unionByName(new))


def seen(store, version=None):
    rows = store.read("posts", version).collect()
    return {r.id: (r.likes, r.published, r.photo_bytes) for r in rows}


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_changes_like_those_of_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=8)
    assert store.version() == -1 and store.total_bytes() == 0 and store.read("posts").count() == 0 and store.history().count() == 0
    have = {i: (i, i % 2, 10 * i) for i in range(1, 30)}
    links = {(i, t) for i in have for t in range(1, i % 3 + 1)}
    base = catalogue(spark, [post(1)], [(t, f"t{t}") for t in range(1, 4)])
    cat = base._replace(posts=sized(spark, have), post_tags=spark.createDataFrame(sorted(links), POST_TAGS))
    assert store.load(cat) == (0, False, sum(r[2] for r in have.values()))
    states, total = {0: dict(have)}, store.total_bytes()
    for version in range(1, 6):
        kind = version % 3
        if kind == 0:
            gone = rng.sample(sorted(have), 3)
            frame = ids(spark, *gone, 999)
            delta = -sum(have[i][2] for i in gone)
            written = store.rewrite(frame, lambda c, f=frame: changes.delete_posts(c, f))
            have = {i: r for i, r in have.items() if i not in gone}
            links = {p for p in links if p[0] not in gone}
        elif kind == 1:
            new = {rng.choice([*have, 100 + version, 200 + version]): (version, 1, rng.randrange(90)) for _ in range(3)}
            frame = sized(spark, new)
            delta = sum(r[2] for r in new.values()) - sum(have[i][2] for i in new if i in have)
            written = store.rewrite(frame.select("id"), put(frame))
            have = have | new
        else:
            shown = [i for i, r in have.items() if not r[1]][:2]
            frame, delta = ids(spark, *shown), 0
            written = store.rewrite(frame, lambda c, f=frame: c._replace(posts=changes.approve(c.posts, f)))
            have = have | {i: (have[i][0], 1, have[i][2]) for i in shown}
        total = max(0, total + delta)
        states[version] = dict(have)
        assert written == (version, False, total)
        assert {(r.post_id, r.tag_id) for r in store.read("post_tags").collect()} == links
    assert {v: seen(store, v) for v in states} == states
    assert [(r.version, r.total_bytes) for r in store.history().orderBy("version").collect()][-1] == (5, total)
    assert {r.name for r in store.read("tags").collect()} == {"t1", "t2", "t3"}


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=16)
    store.load(catalogue(spark, [post(i) for i in range(64)], [(1, "t")], [(i, 1) for i in range(64)]))
    before = files_of(tmp_path / "c")
    store.rewrite(ids(spark, 3, 19, 5), lambda cat: cat._replace(posts=changes.approve(cat.posts.withColumn("published", F.lit(0)), ids(spark, 3))))
    after = files_of(tmp_path / "c")
    assert {f: t for f, t in after.items() if f in before} == before  # earlier folders stay as they were
    new = {f.split("/v=1/")[1].rsplit("/", 1)[0] for f in after if f not in before}
    assert new == {f"{t}/bucket={b}" for t in ("posts", "post_tags") for b in (3, 5)} | {"ledger", "files"}
    read = store.read("posts", buckets=[5]).select("_metadata.file_path").distinct().collect()
    assert read and all("/v=1/posts/bucket=5/" in r[0] for r in read)
    old = store.read("posts", version=0, buckets=[5])
    assert old.filter("published = 0").count() == 0 and old.count() == 4
    assert seen(store)[3][1] == 1 and seen(store)[5][1] == 0 and seen(store)[4][1] == 1


def test_growth_beyond_the_limit_is_refused_and_leaves_no_trace(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=4, limit_bytes=1000)
    store.load(catalogue(spark, [post(1)])._replace(posts=sized(spark, {1: (0, 1, 900)})))
    grown = sized(spark, {2: (0, 1, 50)})
    assert store.rewrite(grown.select("id"), put(grown)) == (0, True, 900)  # 950 is the limit's share already
    assert not (tmp_path / "c" / "v=1").exists() and store.version() == 0 and set(seen(store)) == {1}
    fits = sized(spark, {2: (0, 1, 49)})
    assert store.rewrite(fits.select("id"), put(fits)) == (1, False, 949)
    same = ids(spark, 1)
    assert store.rewrite(same, lambda cat: cat._replace(posts=changes.approve(cat.posts, same))).refused is False  # no growth, no test
    assert store.rewrite(ids(spark, 1), lambda cat: changes.delete_posts(cat, ids(spark, 1))) == (3, False, 49)


def test_what_is_refused_is_not_written_first(spark, tmp_path, monkeypatch):
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=4, limit_bytes=1000)
    store.load(catalogue(spark, [post(1)])._replace(posts=sized(spark, {1: (0, 1, 900)})))
    dealt, deal = [], store._deal
    monkeypatch.setattr(store, "_deal", lambda rows, name, folder: (dealt.append(name), deal(rows, name, folder)))
    grown = sized(spark, {2: (0, 1, 50)})
    assert store.rewrite(grown.select("id"), put(grown)) == (0, True, 900) and dealt == []
    with pytest.raises(ValueError, match="not to touch"):  # before as after, a fault goes first
        store.rewrite(ids(spark, 1), put(grown))
    fits = sized(spark, {2: (0, 1, 49)})
    assert store.rewrite(fits.select("id"), put(fits)) == (1, False, 949) and sorted(dealt) == ["assets", "post_tags", "posts"]


def test_growth_is_admitted_again_as_written(spark, tmp_path, monkeypatch):
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=4, limit_bytes=1000)
    store.load(catalogue(spark, [post(1)])._replace(posts=sized(spark, {1: (0, 1, 900)})))
    deal = store._deal

    def more(rows, name, folder):  # a change that gives more when it runs again
        deal(rows.withColumn("photo_bytes", F.col("photo_bytes") + 60) if name == "posts" else rows, name, folder)

    monkeypatch.setattr(store, "_deal", more)
    fits = sized(spark, {2: (0, 1, 9)})
    assert store.rewrite(fits.select("id"), put(fits)) == (0, True, 900)
    assert not (tmp_path / "c" / "v=1").exists() and store.total_bytes() == 900


def test_faults(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), buckets=4)
    store.load(catalogue(spark, [post(1), post(2)], [(1, "t")], [(1, 1)]))
    assert store.rewrite(ids(spark).limit(0), lambda cat: 1 / 0).version == 0  # nothing to do
    stray = sized(spark, {6: (0, 1, 1)})
    with pytest.raises(ValueError, match="not to touch"):
        store.rewrite(ids(spark, 1), put(stray))
    assert store.version() == 0 and not (tmp_path / "c" / "v=1").exists()
    (tmp_path / "c" / "v=1" / "posts" / "bucket=3").mkdir(parents=True)  # a job that died
    renamed = lambda cat: cat._replace(tags=spark.createDataFrame([(1, "u")], TAGS))
    assert store.rewrite(ids(spark, 1), renamed).version == 1
    assert store.files(1)["posts"] == {1: 1, 2: 0} and [r.name for r in store.read("tags").collect()] == ["u"]
    assert store.rewrite(ids(spark, 1, 2), lambda cat: changes.delete_posts(cat, ids(spark, 1, 2))).version == 2
    assert store.read("posts").count() == 0 and store.read("post_tags").count() == 0 and len(seen(store, 1)) == 2
    with pytest.raises(ValueError, match="4 buckets"):
        CatalogueStore(spark, str(tmp_path / "c"), buckets=8).read("posts")

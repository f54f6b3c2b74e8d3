"""Indexed streams, stored pages and tagging in one pass against plain re-implementations."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import ingest, tagging
from shutterlake.plans import pages, stored_pages
from shutterlake.schema import ACCOUNTS, POSTS, Catalogue
from shutterlake.sources import key_index
from shutterlake.sources.key_index import KEYS, KeyIndex
from shutterlake.sources.page_store import PageStore
from shutterlake.sources.tiers import Tiers
from shutterlake.streaming import ingest as ingest_job
from shutterlake.streaming import likes
from tests.test_catalogue import catalogue, post

NOW = datetime(2024, 2, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- runs and keys


def test_tiers_hold_each_batch_once():
    done, dropped = set(), set()
    tiers = Tiers(lambda a, b: f"{a}-{b}", lambda a, b: (a, b) in done)
    done.add((-1, -1))
    for batch in range(70):
        done.add((batch, batch))
        tiers.compact(batch, lambda parts, target: done.add(target), lambda r: (done.discard(r), dropped.add(r)))
        for before in (batch, batch + 1):  # the batch tried again, and the next one
            runs = tiers.runs(before)
            assert [n for a, b in runs for n in range(a, b + 1)] == list(range(-1, before))
        assert len(tiers.runs(batch + 1)) <= 1 + 3 * 4
    assert (0, 0) in dropped and (0, 63) in done


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(key_index, "BUCKET_KEYS", 50)


def files_exist(path):
    import os

    return os.path.exists(path)


def test_keys_are_found_like_by_a_dictionary(spark, tmp_path, small_buckets):
    rng = random.Random(4)
    index = KeyIndex(spark, str(tmp_path / "index"), files_exist, latest=("mark",))
    stored: dict[tuple, list] = {}
    opened = []
    for batch in range(5):
        rows = [("media", f"m{rng.randrange(3000)}", None) for _ in range(200)]
        rows += [("name", f"n{rng.randrange(40)}", f"p{rng.randrange(9)}") for _ in range(60)]
        rows += [("mark", f"a{i}", f"{batch}") for i in range(batch, 12)] + [("mark", "a'é", None)] * 3
        if batch == 2:  # an empty batch
            rows = []
        table = spark.createDataFrame(rows, "kind string, key string, payload string")
        for _ in range(2 if batch == 3 else 1):  # tried again, after its runs were merged
            index.write(batch, table)
            index.compact(batch)
        for kind, key, payload in rows:
            if kind == "mark":
                stored[kind, key] = [payload]
            elif payload not in stored.setdefault((kind, key), []):
                stored[kind, key].append(payload)
        wanted = [("media", f"m{i}") for i in range(0, 3000, 7)] + [("name", f"n{i}") for i in range(50)] + [("mark", "a3"), ("mark", "a'é"), ("mark", "none")]
        index.rows_read = 0
        found = index.find(spark.createDataFrame(wanted, "kind string, key string"), batch + 1)
        got = sorted(((r.kind, r.key, r.payload) for r in found.collect()), key=repr)
        assert got == sorted(((*k, p) for k in set(wanted) for p in stored.get(k, [])), key=repr)
        # Keys that are nowhere open next to nothing.
        index.rows_read = 0
        assert index.find(spark.createDataFrame([("media", f"x{i}") for i in range(5)], "kind string, key string"), batch + 1).count() == 0
        opened.append(index.rows_read)
    assert max(opened) <= 150 and sum(opened) < 400
    assert index.find(spark.createDataFrame([("media", "m1")], "kind string, key string"), 0).schema == KEYS
    assert index.scan("name", 5).select("key", "payload").distinct().count() == sum(len(v) for (k, _), v in stored.items() if k == "name")


# ---- streams


ITEMS = "account string, pos long, tweet_id string, url string, type string, date string, content string, nick string"


def feed_batch(rng, batch):
    rows = []
    for pos in range(30):
        account = f"acc{rng.randrange(3)}"
        tweet = rng.choice([None, str(rng.randrange(100, 140)), f"10000000000{rng.randrange(30)}"])
        url = f"https://h/m/k{rng.randrange(60)}" + rng.choice([".mp4", "?format=png", "xx.gif"])
        rows.append((account, pos, tweet, url, rng.choice(["photo", "video", "text"]), f"2024-01-{1 + batch:02d} 00:00:{pos:02d}", f" hello {pos % 3} ", rng.choice(["", " N "])))
    return rows


def test_stream_with_an_index_equals_whole_state(spark, tmp_path, small_buckets):
    """Batches through the index and, beside it, through tables that hold everything; one batch is repeated."""
    rng = random.Random(11)
    log = ingest_job.ingest_log(spark, str(tmp_path / "log"))
    accounts = spark.createDataFrame([(i, f"Acc{i}", 1, int(i == 1), None, None, None, 0, None, None) for i in range(3)], ACCOUNTS)
    rules = tagging.load_rules(spark.createDataFrame([(n, f"greet {n}", None, "substring", f"hello {n}") for n in range(2)], tagging.RULES))
    old = [post(1, "acc0_105_1.jpg", author="acc0", post_url=""), post(2, "acc1_x.png", author="acc1", post_url="https://x.com/acc1/status/110"), post(9, "acc2_undefined_1.mp4", author="acc2", post_url="")]
    seed = catalogue(spark, old, [(7, "greet 1")], [(1, 7)])
    media = spark.createDataFrame([("k5",), ("k5",), ("k9",)], "media_id string")
    marks = spark.createDataFrame([("acc2", "120", "")], "account string, post_id string, date string")
    ingest_job.seed_catalogue(log, seed, media, marks)
    posts, tags, known, stored_marks = seed.posts, seed.tags, media, marks
    for batch in range(3):
        items = spark.createDataFrame(feed_batch(rng, batch), ITEMS)
        ok = ~F.col("url").contains("k1x")
        fetched = items.select("url").distinct().select("url", F.when(F.col("url").contains("k33"), 100_000_000).otherwise(10).cast("long").alias("size"), ok.alias("ok"))
        whole = ingest.ingest_pages(items, ingest.IngestState(posts, tags, known, stored_marks, accounts), fetched, rules, NOW)
        for _ in range(2 if batch == 1 else 1):
            state = ingest_job.StoredState(log, batch, items, accounts)
            log.store(batch, ingest.ingest_pages(items, state, fetched, rules, NOW)._asdict())
        for name in ("posts", "post_tags", "known_media", "report"):
            want = getattr(whole, name)
            have = log.read(name).filter(F.col("batch") == batch).select(*want.columns)
            assert sorted(map(repr, have.collect())) == sorted(map(repr, want.select(*have.columns).collect())), (batch, name)
        keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
        posts, tags, known = keep(posts.unionByName(whole.posts)), keep(tags.unionByName(whole.tags)), keep(known.unionByName(whole.known_media))
        stored_marks = keep(whole.marks.unionByName(stored_marks.join(whole.marks, "account", "left_anti")))
    assert posts.count() > len(old) + 3
    assert sorted(map(repr, ingest_job.current_marks(log).collect())) == sorted(map(repr, stored_marks.collect()))


def test_rows_read_stay_flat_while_the_state_grows(spark, tmp_path, small_buckets):
    index = KeyIndex(spark, str(tmp_path / "index"), files_exist)
    opened = []
    for batch in range(5):
        rows = [("media", f"b{batch}k{i}", None) for i in range(400)]
        index.write(batch, spark.createDataFrame(rows, "kind string, key string, payload string"))
        index.compact(batch)
        asked = [("media", f"new{batch}k{i}") for i in range(40)] + [("media", f"b0k{i}") for i in range(3)]
        index.rows_read = 0
        assert index.find(spark.createDataFrame(asked, "kind string, key string"), batch + 1).count() == 3
        opened.append(index.rows_read)
    assert sum(sum(index.shape(r).rows.values()) for r in index.runs(5)) == 2000
    assert max(opened) <= 400  # three buckets with a hit, and a few that only may have one


def test_likes_over_many_batches(spark, tmp_path):
    rng = random.Random(5)
    log = likes.like_log(spark, str(tmp_path / "log"))
    posts = spark.createDataFrame([(i, rng.randrange(4)) for i in range(6)], "id long, likes long")
    value = {r.id: r.likes for r in posts.collect()}
    seq = 0
    for batch in range(9):
        rows = []
        for _ in range(rng.randrange(30)):
            seq += 1
            i, step = rng.randrange(6), rng.choice([1, -1, -1])
            value[i] = max(0, value[i] + step)
            rows.append((i, "like" if step > 0 else "unlike", seq))
        folds = likes.fold_deltas(likes.like_deltas(spark.createDataFrame(rows, "post_id long, action string, seq long")), "post_id", ["seq"])
        for _ in range(2 if batch in (3, 7) else 1):
            log.store(batch, folds)
        if batch in (2, 3, 8):
            assert {r.id: r.likes for r in likes.current_likes(posts, log).collect()} == value
    assert log.runs() == [(0, 3), (4, 7), (8, 8)]


# ---- pages


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1, 400):
        at = None if i % 97 == 0 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 40) // 5 * 5)
        keys = rng.choice(["a.jpg", "b.mp4", "a.jpg,b.mp4", ""])
        rows.append(post(i, keys, author=rng.choice(["ann", "Bob", "cy"]), published=int(rng.random() < 0.8), created_at=at, photo_bytes=rng.choice([None, 5, 5, rng.randrange(50)]), description=rng.choice(["red fox", "blue hen", "RED hen"])))
    tags = [(1, "fox"), (2, "ANN"), (3, " cy "), (4, "rare"), (5, "gone")]
    links = [(i, t) for i in range(1, 400) for t in (1, 2, 3) if (i * t) % 5 == 0] + [(77, 4), (300, 4)]
    return catalogue(spark, rows, tags, links)


@pytest.fixture(scope="module")
def store(spark, many, tmp_path_factory):
    out = PageStore(spark, str(tmp_path_factory.mktemp("pages")))
    out.publish_catalogue(many, 0)
    return out


def shown(page):
    items = [(r.id, r.tags_list, r.title, r.likes, r.created_at) for r in page.items.collect()]
    return items, page.has_more, page.next_key, page.total, page.showing_start, page.showing_end


FEEDS = [
    {},
    {"offset": 30, "limit": 7},
    {"offset": 10_000},
    {"media": "video", "sort": "oldest", "offset": 5},
    {"tag": "rare"},
    {"author": "Bob", "offset": 3},
    {"after": ("2024-01-20 10:00:00", 200)},
    {"after": ("2024-01-20 10:00:00", 200), "sort": "oldest", "media": "photo"},
    {"after": ("2030-01-01 00:00:00", 5), "limit": 400},
]


@pytest.mark.parametrize("criteria", FEEDS, ids=str)
def test_stored_feed_equals_plain_one(many, store, criteria):
    assert shown(stored_pages.feed_page(store, **criteria)) == shown(pages.feed_page(many.posts, many.post_tags, many.tags, **criteria))


SEARCHES = [{"q": "ReD"}, {"q": "fo_", "sort": "oldest"}, {"tag": "FOX", "author": "@bob"}, {"work": "rare", "offset": 1}]


@pytest.mark.parametrize("criteria", SEARCHES, ids=str)
def test_stored_search_equals_plain_one(many, store, criteria):
    assert shown(stored_pages.search_page(store, **criteria)) == shown(pages.search_page(many.posts, many.post_tags, many.tags, **criteria))


ADMINS = [
    {},
    {"published": 0, "sort": "oldest", "limit": 30},
    {"media": "photo"},
    {"media": "video", "counts_ready": False, "offset": 4},
    {"sort": "size_desc", "limit": 25, "offset": 10},
    {"sort": "size_asc", "limit": 25},
    {"search": "hen", "author": "ANN", "sort": "size_desc"},
]


@pytest.mark.parametrize("criteria", ADMINS, ids=str)
def test_stored_admin_page_equals_plain_one(many, store, criteria):
    assert shown(stored_pages.admin_page(store, **criteria)) == shown(pages.admin_page(many.posts, many.post_tags, many.tags, **criteria))


def test_walking_the_stored_feed_by_keys(many, store):
    ids, after = [], None
    while True:
        page = stored_pages.feed_page(store, after=after, limit=40)
        ids += [r.id for r in page.items.collect()]
        after = page.next_key
        if not page.has_more or after is None:
            break
    order = many.posts.filter("published = 1").orderBy(F.desc("created_at"), F.desc("id")).select("id", "created_at").collect()
    timed = [r.id for r in order if r.created_at is not None]
    assert ids[: len(timed)] == timed or ids == timed[: len(ids)]
    assert len(ids) >= len(timed)


def test_pages_read_their_spans_only(store):
    page = stored_pages.feed_page(store, after=("2024-01-20 10:00:00", 200), limit=5)
    plan = plan_of(page.items)
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    wide = [s for s in scans if "description" in s]
    assert len(wide) == 1 and re.search(r"PartitionFilters: \[[^\]]*published[^\]]*span", wide[0])
    # No other scan reads posts, and the authors come from their own table.
    assert not any("media_keys" in s for s in scans if s is not wide[0])
    assert any("authors" in s for s in scans)
    spans = {r["span"] for r in store.read("zones").filter("published = 1").collect()}
    found, read = stored_pages._find(
        lambda names: store.read("posts").filter((F.col("published") == 1) & F.col("span").isin(names)),
        stored_pages._spans(store, 1, False, None), pages.time_order("newest"), 10, "rows",
    )
    assert len(found) == 10 and len(read) <= 3 < len(spans)


def test_an_empty_store_has_empty_pages(spark, tmp_path):
    empty = PageStore(spark, str(tmp_path / "s"))
    empty.publish_catalogue(catalogue(spark, []), 0)
    assert shown(stored_pages.feed_page(empty)) == ([], False, None, None, None, 0)
    assert shown(stored_pages.admin_page(empty))[3:] == (0, 0, 0)


def test_a_version_without_marker_is_not_read(spark, tmp_path):
    out = PageStore(spark, str(tmp_path / "s"))
    out.publish_catalogue(catalogue(spark, [post(1)]), 0)
    out.publish_catalogue(catalogue(spark, [post(1), post(2)]), 1)
    (tmp_path / "s" / "v=1" / "_COMMITTED").unlink()
    assert [r.id for r in stored_pages.feed_page(out).items.collect()] == [1]


# ---- tagging


def plain_tags(text, rules):
    """Every keyword by itself; a work before its characters."""
    text = (text or "").lower()

    def match(mode, word):
        if mode == "substring":
            return word.lower() in text
        if mode == "word":
            return re.search(rf"(^|[^a-z0-9_]){re.escape(word.lower())}([^a-z0-9_]|\Z)", text) is not None
        return re.search(word, text) is not None

    hits = [any(match(*w) for w in rule.words) for rule in rules]
    out = []
    for i, rule in enumerate(rules):
        work = rule.parent or rule.tag
        group = [k for k, r in enumerate(rules) if (r.parent or r.tag) == work]
        if hits[i] and work not in out:
            out.append(work)
        if hits[i] and rule.tag not in out:
            out.append(rule.tag)
        assert group == list(range(group[0], group[-1] + 1))
    return out


def test_tags_in_one_pass_equal_every_keyword_by_itself(spark, monkeypatch):
    monkeypatch.setattr(tagging, "AUTOMATON_CHARS", 40)  # several automata
    rng = random.Random(3)
    letters = "ab_ é-"
    rows = []
    for o in range(60):
        work = o // 4
        tag, parent = (f"w{work}", None) if o % 4 == 0 else (f"c{o}", f"w{work}")
        for _ in range(rng.randrange(1, 4)):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))).strip() or "a"
            mode = rng.choice(["substring", "word", "word"]) if re.fullmatch(r"[a-z0-9\s-]+", word) else "substring"
            rows.append((o, tag, parent, mode, word.upper() if rng.random() < 0.2 else word))
    rows += [(100, "digits", None, "regex", "[0-9]{3}"), (101, "same", None, "word", "ab"), (102, "same2", None, "substring", "ab"), (103, "all", None, "substring", "")]
    rules = tagging.load_rules(spark.createDataFrame(rows, tagging.RULES))
    texts = [None, "", "ab", "AB 123", "x_ab", "é ab-é", "ab" * 5000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, description string").repartition(3)
    got = {r.id: r.tags for r in table.select("id", tagging.tag_column("description", rules).alias("tags")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_tags(text, rules), text
    links = tagging.assign_tags(table, rules)
    plan = plan_of(links)
    assert plan.count("ArrowEvalPython") == 1 and "contains(" not in plan.lower()
    assert sorted((r.post_id, r.name) for r in links.collect()) == sorted((i, n) for i, names in got.items() for n in names)


def test_the_cost_of_tags_does_not_follow_the_number_of_keywords():
    """Steps of an automaton are those of the text: hits are found in one walk."""
    text = "lorem ipsum dolor " * 200
    few, lots = (tagging.Literals([(f"key{i}", False, i) for i in range(n)] + [("dolor", True, n)]) for n in (17, 1200))
    assert len(few.automata) == len(lots.automata) == 1
    assert few.rules(text) == {17} and lots.rules(text) == {1200}

"""What grows with the input: shuffles, candidates, index rows, batches of texts."""

from __future__ import annotations

import random
from itertools import combinations
from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from shutterlake.functions.hashing import signed
from shutterlake.operators import blocks, ingest, tagging, timeline
from shutterlake.operators import similarity as sim
from shutterlake.operators.components import connected_components
from workload import store_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _items(spark):
    # (account, place, post, url)
    rows = [("a", 1, "7", "u/1.png"), ("a", 2, "7", "u/1.png"), ("a", 3, "7", "u/2.png"), ("b", 1, "7", "u/1.png"), ("a", None, "8", "u/3.png"), ("a", 9, "8", "u/3.png")]
    return spark.createDataFrame(rows, "account string, pos int, tweet_id string, media_id string").withColumns(
        {"url": F.col("media_id"), "ext": F.lit(".png"), "content": F.lit("long text")}
    )


def test_items_of_a_post_are_shuffled_once(spark):
    numbered = timeline.with_ordinals(timeline.first_seen(_items(spark)))
    counted = numbered.groupBy("account", "tweet_id").agg(F.max("nn").alias("n"))
    plan = _plan(counted)
    assert plan.count("Exchange") == 1, plan
    assert "content" not in plan.split("Exchange")[0], plan
    assert sorted(map(tuple, counted.collect())) == [("a", "7", 2), ("a", "8", 1), ("b", "7", 1)]


def test_first_item_with_a_place_wins(spark):
    got = timeline.first_seen(_items(spark)).select("account", "tweet_id", "media_id", "pos").collect()
    assert sorted(map(tuple, got)) == [("a", "7", "u/1.png", 1), ("a", "7", "u/2.png", 3), ("a", "8", "u/3.png", 9), ("b", "7", "u/1.png", 1)]


def _hashes(n: int) -> list[int]:
    rng = random.Random(n)
    near = [rng.getrandbits(64) for _ in range(n // 2)]
    return sorted({signed(h) for h in near} | {signed(h ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for h in near})


def _near(hashes: list[int], threshold: int) -> list[tuple[int, int, int]]:
    bits = [(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a, b in combinations(hashes, 2)]
    return sorted(p for p in bits if p[2] <= threshold)


def test_blocks_find_each_pair_once(spark):
    hashes = _hashes(120)
    groups = spark.createDataFrame([(h, i, None if i % 3 else i) for i, h in enumerate(hashes)], "hash long, n long, low long")
    place = {h: i for i, h in enumerate(hashes)}
    for block in (20, 1000):
        got = sorted(map(tuple, blocks.near_pairs(groups, 24, len(hashes), block).collect()))
        assert [g[:3] for g in got] == _near(hashes, 24)
        assert all(g[3:5] == (place[g[0]], place[g[1]]) and g[5] == (None if g[3] % 3 else g[3]) for g in got)


def test_wide_thresholds_are_compared_in_blocks_and_narrow_ones_joined(spark):
    groups = spark.createDataFrame([(h,) for h in _hashes(60)], "hash long")
    assert "MapInArrow" in _plan(sim.similar_hashes(groups, 20))
    assert sim._cheapest_words(3, 1_000_000)[1] < 1_000_000 / 2 * sim.BLOCK_COST
    joined = sim.similar_hashes(groups, 20, words=4, carry=()).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, sim.similar_hashes(groups, 20).collect()))


def test_a_task_joins_its_links_first(spark):
    rows = [(i, i + 1) for i in range(50)] + [(i, j) for i in range(100, 120) for j in range(100, 120)] + [(None, 3)]
    links = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    stars = blocks.forest(links, ("a", "b"))
    assert sorted(map(tuple, stars.collect())) == [(0, i) for i in range(1, 51)] + [(100, i) for i in range(101, 120)]
    assert {r.component for r in connected_components(stars, "a", "b").collect()} == {0, 100}


def test_pair_total_of_posts_with_many_hashes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(6), f"k{i}", h) for i, h in enumerate(_hashes(80)) for _ in range(1 + i % 3)]
    want = sum(1 for a, b in combinations(rows, 2) if a[0] != b[0] and ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count() <= 26)
    images = spark.createDataFrame(rows, "post_id long, key string, hash long")
    pairs = sim.similar_hashes(sim.hash_groups(images), 26, carry=["n"])
    for most in (3, 200):
        monkeypatch.setattr(sim, "PAIRED_HASHES", most)
        assert sim.pair_total(images, pairs, 26).first()[0] == want
    assert sim.pair_total(images, pairs.select("hash_a", "hash_b", "distance")).first()[0] == want


def test_keys_are_indexed_by_grams_that_names_can_have(spark):
    posts = spark.createDataFrame([("a", ["a_2039917506295648359_1.MP4", "x_y.png", None]), ("b", ["aaaaaaaaaa"])], "author string, media_keys array<string>")
    got = ingest.key_grams(posts, 8).groupBy("key").agg(F.sort_array(F.collect_list("gram")).alias("g")).collect()
    grams = {r.key: r.g for r in got}
    number = "2039917506295648359"
    assert grams["a_2039917506295648359_1.mp4"] == sorted(number[i : i + 8] for i in range(12))
    assert grams["x_y.png"] == [""] and grams["aaaaaaaaaa"] == ["aaaaaaaa"]


def test_names_are_found_by_grams_of_their_pieces(spark):
    names = ["2039917506295648359_1.mp4", "9175062956483_9", "y.png", "_", "nothing_here.png", "36"]
    new = spark.createDataFrame([(n, "a", n) for n in names], "ref string, author string, name string")
    posts = spark.createDataFrame([("a", ["a_2039917506295648359_1.MP4", "x_y.png"])], "author string, media_keys array<string>")
    assert sorted(r.ref for r in ingest.names_in_keys(new, posts).collect()) == sorted(["2039917506295648359_1.mp4", "9175062956483_9", "y.png", "_"])


def test_texts_are_tagged_from_arrow_buffers(spark):
    posts = spark.createDataFrame([(1, "Stone by the sea"), (2, None), (3, ""), (4, "stones 42"), (5, "cut STONE 7")], "id long, description string")
    rules = [tagging.Rule("Stone", (("word", "stone"),), "Rare"), tagging.Rule("number", (("regex", "[0-9]+"),))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        tagged = posts.coalesce(1).select("id", tagging.tag_column("description", rules).alias("t"))
        assert {r.id: r.t for r in tagged.collect()} == {1: ["Rare", "Stone"], 2: [], 3: [], 4: ["number"], 5: ["Rare", "Stone", "number"]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert f'"evalType":{PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}' in tagged._jdf.queryExecution().analyzed().toJSON().replace(" ", "")


def test_timeline_pages_are_written_compressed(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "pages")
    monkeypatch.setattr(store_queries, "fresh_path", lambda *_: path)
    rows = [("acct1", i, f"{i}", f"https://media.example/1/{i}.gif", "photo", "2024-01-01 00:00:00", "item", "nick") for i in range(90)]
    items = spark.createDataFrame(rows, "account string, pos int, tweet_id string, url string, type string, date string, content string, nick string")
    read = store_queries._timeline_pages(SimpleNamespace(spark=spark, timeline=lambda: items)).collect()
    assert sorted((r.page, r.place, r.tweet_id) for r in read) == [(i // 40, i % 40, str(i)) for i in range(90)]
    assert [*tmp_path.glob("pages/*.json.gz")] and not [*tmp_path.glob("pages/*.json")]

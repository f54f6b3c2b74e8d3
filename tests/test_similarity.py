"""Hash joins, clusters and samples against brute force."""

import random
from itertools import combinations

import pytest

from shutterlake.functions.hashing import signed
from shutterlake.operators import similarity as sim
from shutterlake.operators.components import connected_components


def distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def sample_images(seed, n=60):
    """Images around a few centres; posts hold several, hashes repeat."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(n):
        h = rng.choice(centres)
        for bit in rng.sample(range(64), rng.choice((0, 0, 1, 3, 6, 12))):
            h ^= 1 << bit
        post = rng.randrange(1, 25)
        rows.append((post, f"k{i:03d}", signed(h), post * 7 % 5, f"t{post}"))
    return sorted(rows)


def brute(rows, threshold):
    pairs = [
        (a, b) for a, b in combinations(rows, 2) if a[0] != b[0] and distance(a[2], b[2]) <= threshold
    ]
    parent = {r[1]: r[1] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a[1])] = root(b[1])
    groups = {}
    for r in rows:
        groups.setdefault(root(r[1]), {})[r[0]] = r[3]
    lost, seen = set(), set()
    for posts in groups.values():
        ranked = sorted(posts, key=lambda p: (-posts[p], p))
        seen.update(ranked)
        lost.update(ranked[1:])
    samples = [
        ((b, a) if b[3] > a[3] or (b[3] == a[3] and b[0] < a[0]) else (a, b), distance(a[2], b[2])) for a, b in pairs[:100]
    ]
    return len(pairs), {p: "pending" if p in lost else "keeper" for p in seen}, samples


def frame(spark, rows):
    return spark.createDataFrame(rows, "post_id long, key string, hash long, likes long, title string")


@pytest.mark.parametrize("threshold", [0, 3, 10, 20])
def test_clusters_match_brute_force(spark, threshold):
    rows = sample_images(threshold + 1)
    total, verdicts, samples = brute(rows, threshold)
    images = frame(spark, rows)
    pairs = sim.similar_hashes(sim.hash_groups(images), threshold)
    assert sim.pair_total(images, pairs).first()[0] == total
    got = {r.post_id: r.verdict for r in sim.verdicts(sim.cluster_posts(images, threshold)).collect()}
    assert got == verdicts
    drawn = sim.sample_pairs(images, pairs).collect()
    want = sorted((p[0], c[0], d) for (p, c), d in samples)
    assert sorted((r.preferred_post, r.candidate_post, r.distance) for r in drawn) == want


@pytest.mark.parametrize(("threshold", "words", "crowded"), [(5, 3, 2), (10, 4, 3), (14, 5, 2)])
def test_crowded_buckets_stay_exact(spark, threshold, words, crowded):
    rng = random.Random(words)
    hashes = {rng.getrandbits(30) << 34 for _ in range(80)}
    for h in list(hashes)[:40]:
        for bit in rng.sample(range(64), rng.randrange(1, 12)):
            h ^= 1 << bit
        hashes.add(h)
    hashes = sorted(signed(h) for h in hashes)
    want = sorted((a, b) for a, b in combinations(hashes, 2) if distance(a, b) <= threshold)
    groups = spark.createDataFrame([(h,) for h in hashes], "hash long")
    got = sim.similar_hashes(groups, threshold, words, crowded).collect()
    assert sorted((r.hash_a, r.hash_b) for r in got) == want


def test_golden_clusters(spark):
    def verdicts(rows, t):
        images = frame(spark, [(p, k, signed(int(h, 16)), likes, "") for p, k, h, likes in rows])
        return {r.post_id: r.verdict for r in sim.verdicts(sim.cluster_posts(images, t)).collect()}

    a, b, c = "0" * 16, "0" * 14 + "ff", "0" * 12 + "ffff"
    assert verdicts([(1, "a", a, 5), (2, "b", b, 12), (3, "c", c, 2)], 10) == {1: "pending", 2: "keeper", 3: "pending"}
    far = "f" * 16
    rows = [(1, "a1", a, 10), (2, "b1", a, 5), (2, "b2", far, 5), (3, "c1", far, 1)]
    assert verdicts(rows, 5) == {1: "keeper", 2: "pending", 3: "pending"}


def test_many_equal_hashes_are_counted_not_listed(spark):
    images = frame(spark, [(i, f"k{i:02d}", 7, 0, "") for i in range(1, 16)])
    pairs = sim.similar_hashes(sim.hash_groups(images), 10)
    assert pairs.count() == 0
    assert sim.pair_total(images, pairs).first()[0] == 105
    assert sim.sample_pairs(images, pairs).count() == 100


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(159, 300), (300, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in [*range(100, 160), 300, 301]} == {100}


def test_invalid_threshold(spark):
    with pytest.raises(ValueError):
        sim.similar_hashes(spark.createDataFrame([(1,)], "hash long"), 64)


def test_pair_join_has_no_product(spark):
    images = frame(spark, sample_images(3))
    plan = sim.similar_hashes(sim.hash_groups(images), 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

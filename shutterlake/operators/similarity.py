"""Near-duplicate images by perceptual hash [J7, J8, J10, X3-X6, A14, W4, W10].

All heavy work runs on *distinct hashes*.  A hash that many posts share is one row
with counts, so copies never multiply into pairs: totals are computed from counts,
and linking hashes links exactly the same posts as linking images would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.functions.hashing import (
    HASH_BITS,
    hamming,
    hash_from_hex,
    signed,
    similarity_pct,
    similarity_text,
)
from shutterlake.functions.media import is_video
from shutterlake.operators.blocks import forest, near_pairs
from shutterlake.operators.components import connected_components
from shutterlake.operators.skew import heaviest, hot_keys, salted_join
from shutterlake.session import materialise

DEFAULT_THRESHOLD = 10
# Hashes of a post that are paired off among themselves.
PAIRED_HASHES = 200
SAMPLE_PAIRS = 100
# Columns of `hash_groups` that tell whether two hashes are of one post only.
POSTS_OF_HASH = ("low_post", "high_post")
# Flips tried per hash and bit mask tables stay this small.
MAX_PROBES = 5_000
# Cost of sending one probe through a shuffle, in comparisons of two hashes.
PROBE_COST = 100
# Cost of comparing two hashes of two blocks, in comparisons after a shuffle.
BLOCK_COST = 0.02
# Hashes sharing a word from which a second word is used.
CROWDED_ROWS = 20_000
# At most so many buckets are split this way: about a megabyte to broadcast.
CROWDED_BUCKETS = 65_536


def hashed_assets(assets: DataFrame, posts: DataFrame) -> DataFrame:
    """[J7, F19] Hashes of published posts: (post_id, key, hash, likes, title)."""
    valid = assets.withColumn("hash", hash_from_hex("phash")).filter("hash is not null")
    published = posts.filter("published = 1").select(
        F.col("id").alias("post_id"), F.coalesce("likes", F.lit(0)).alias("likes"), "title"
    )
    return valid.select("post_id", "key", "hash").join(published, "post_id")


def unhashed_media(posts: DataFrame, assets: DataFrame) -> DataFrame:
    """[J8] Photo keys of published posts that have no stored hash."""
    photos = F.filter("media_keys", lambda k: ~is_video(k))
    keys = posts.filter("published = 1").select(
        F.col("id").alias("post_id"), F.explode(photos).alias("key"), "title", F.coalesce("likes", F.lit(0)).alias("likes")
    )
    return keys.join(assets.filter("phash is not null").select("key"), "key", "left_anti")


def hash_groups(images: DataFrame) -> DataFrame:
    """One row per distinct hash: images, and least and greatest post."""
    return images.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("post_id").alias("low_post"), F.max("post_id").alias("high_post")
    )


# --- pairs of hashes within a distance --------------------------------------------


def word_plan(threshold: int, words: int, bits: int = HASH_BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per word, for multi-index hashing (Norouzi et al., 2012).

    If two hashes differ in at most `threshold` bits, some word differs in at most
    its radius, because the radii plus one add up to `threshold + 1`.  A radius of
    -1 means the word is not needed.
    """
    widths = [bits // words + (1 if i < bits % words else 0) for i in range(words)]
    radii = [(threshold + 1) // words - 1 + (1 if i < (threshold + 1) % words else 0) for i in range(words)]
    shifts = [sum(widths[:i]) for i in range(words)]
    return list(zip(shifts, widths, radii))


def probe_count(plan: list[tuple[int, int, int]]) -> int:
    return sum(comb(width, r) for _, width, radius in plan for r in range(radius + 1))


def choose_words(threshold: int, n_hashes: float, bits: int = HASH_BITS) -> int:
    """Number of words that costs least for `n_hashes` hashes.

    Fewer, longer words mean more probes per hash but fewer false candidates.
    """
    return _cheapest_words(threshold, n_hashes, bits)[0]


def _cheapest_words(threshold: int, n_hashes: float, bits: int = HASH_BITS) -> tuple[int, float]:
    """Number of words, and its cost for one hash."""
    best, best_cost = min(16, threshold + 1), float("inf")
    for words in range(1, min(16, threshold + 1) + 1):
        plan = word_plan(threshold, words, bits)
        probes = probe_count(plan)
        candidates = sum(
            comb(width, r) * n_hashes / 2.0**width for _, width, radius in plan for r in range(radius + 1)
        )
        cost = PROBE_COST * probes + candidates
        if probes <= MAX_PROBES and cost < best_cost:
            best, best_cost = words, cost
    return best, best_cost


def _cut(h: Column, shift: Column, ones: Column) -> Column:
    """Bits of `h` from `shift` on, as many as `ones` has."""
    return F.call_function("shiftrightunsigned", h, shift).bitwiseAND(ones)


def _rotated(h: Column, turn: Column) -> Column:
    """`h` rotated right by `turn` bits."""
    low = F.call_function("shiftrightunsigned", h, turn)
    high = F.call_function("shiftleft", h, F.lit(HASH_BITS) - turn)
    return F.when(turn == 0, h).otherwise(low.bitwiseOR(high))


def _first_word(flips: Column, plan: Column) -> Column:
    """Number of the first word within its radius, from an array of (shift, ones, radius)."""
    near = F.transform(plan, lambda w: F.bit_count(_cut(flips, w["shift"], w["ones"])) <= w["radius"])
    return F.array_position(near, True) - 1


def _masks(width: int, radius: int) -> list[tuple[int, int]]:
    """(mask, bits set) for all masks with at most `radius` bits set."""
    return [
        (signed(reduce(or_, (1 << b for b in flipped), 0)), r)
        for r in range(radius + 1)
        for flipped in combinations(range(width), r)
    ]


def similar_hashes(
    groups: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    words: int | None = None,
    crowded_rows: int = CROWDED_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """[J10] (hash_a, hash_b, distance) for all distinct hashes within `threshold`, once each.

    Columns of `groups` named by `carry` come along as `<name>_a` and `<name>_b`.  Where the threshold is so wide
    that words leave too many candidates, all hashes are compared block by block (`operators.blocks`), unless
    `words` is given.  Else an equi-join of words: one side as stored, the other with every flip up to the
    word's radius.  Where very many hashes share a word, that bucket is not paired
    off; its hashes are joined on a second word as well, cut from their other bits
    by the same rule with the flips left over.  Exact for every threshold.
    """
    if not 0 <= threshold < HASH_BITS:
        raise ValueError("threshold must lie between 0 and 63")
    described = materialise(groups.select("hash", *carry), "hashes")
    n_hashes = max(described.count(), 2)
    if words is None and n_hashes / 2 * BLOCK_COST < _cheapest_words(threshold, n_hashes)[1]:
        return near_pairs(described, threshold, n_hashes)
    hashes = described.select("hash")
    plan = word_plan(threshold, words or choose_words(threshold, n_hashes))
    inner_words = [
        choose_words(threshold, n_hashes / 3, HASH_BITS - width) if width < HASH_BITS else 1 for _, width, _ in plan
    ]

    stored = _word_rows(hashes, plan)
    masks, submasks, subwords, checks = _plan_tables(groups, plan, inner_words, threshold)
    flipped = stored.join(masks, "word").withColumn("value", F.col("value").bitwiseXOR(F.col("mask")))
    keys = ["word", "value", "sub", "subvalue"]
    if n_hashes < crowded_rows:
        # No bucket can be crowded, so first words are enough.
        met = flipped.select("word", "value", "flips", F.lit(-1).alias("sub"), F.col("hash").alias("hash_a")).join(
            stored.select("word", "value", F.col("hash").alias("hash_b")), ["word", "value"]
        )
    else:
        counts = stored.groupBy("word", "value").agg(F.count(F.lit(1)).alias("_rows"))
        crowded = heaviest(counts, ["word", "value"], "_rows", crowded_rows, CROWDED_BUCKETS)
        probes = _second_word(flipped, crowded, submasks, ["word", "flips"])
        tried = F.col("subvalue").bitwiseXOR(F.coalesce("submask", F.lit(0))).alias("subvalue")
        probes = probes.select("word", "value", "sub", tried, "flips", F.col("hash").alias("hash_a"))
        targets = _second_word(stored, crowded, subwords, ["word"]).select(*keys, F.col("hash").alias("hash_b"))
        met = salted_join(targets, probes, keys, hot_keys(targets, keys, crowded_rows), spread=["hash_b"])

    a, b = F.col("hash_a"), F.col("hash_b")
    close = met.filter((a < b) & (hamming(a, b) <= threshold)).join(checks, ["word", "flips"])
    # Report a pair only at the first word that finds it: unique without a distinct.
    flips = a.bitwiseXOR(b)
    outer_first = _first_word(flips, F.col("outer_plan")) == F.col("word")
    inner_first = _first_word(_rotated(flips, F.col("turn")), F.col("inner_plan")) == F.col("sub")
    once = outer_first & ((F.col("sub") == -1) | inner_first)
    pairs = close.filter(once).select("hash_a", "hash_b", hamming(a, b).alias("distance"))
    for x in "ab" if carry else "":
        side = described.select(F.col("hash").alias(f"hash_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in carry])
        pairs = pairs.join(side, f"hash_{x}")
    return pairs


def _literal_table(spark: SparkSession, rows: list[tuple], fields: list[tuple]) -> DataFrame:
    """Rows known beforehand as a local relation: planned with its size, read by no job."""
    names = [name for name, _ in fields]
    columns = list(zip(*rows)) if rows else [()] * len(fields)

    def value(cell):
        if isinstance(cell, list):
            return [dict(zip(("shift", "ones", "radius"), item)) for item in cell]
        return cell

    arrays = [pa.array([value(c) for c in column], kind) for column, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=names))


def _second_word(rows: DataFrame, crowded: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Add a second word to rows of crowded buckets, and a constant to the others."""
    marks = F.broadcast(crowded.withColumn("_crowded", F.lit(True)))
    marked = rows.join(marks, ["word", "value"], "left").alias("r")
    match = F.col("_crowded")
    for name in on:
        match = match & (F.col(f"r.{name}") == F.col(f"s.{name}"))
    added = [c for c in second.columns if c not in on]
    joined = marked.join(second.alias("s"), match, "left").select("r.*", *[f"s.{c}" for c in added])
    cut = _cut(_rotated(F.col("hash"), F.col("turn")), F.col("shift"), F.col("ones"))
    return joined.withColumns({"sub": F.coalesce("sub", F.lit(-1)), "subvalue": F.coalesce(cut, F.lit(0))})


def _word_rows(hashes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(hash, word, value) for each word of each hash."""
    parts = [
        F.struct(F.lit(i).alias("word"), _cut(F.col("hash"), F.lit(shift), F.lit(_ones(width))).alias("value"))
        for i, (shift, width, _) in enumerate(plan)
    ]
    return hashes.select("hash", F.inline(F.array(*parts)))


def _ones(width: int) -> int:
    return signed((1 << width) - 1)


def _plan_tables(
    like: DataFrame, plan: list[tuple[int, int, int]], inner_words: list[int], threshold: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bit masks and word cuts as small tables, a few thousand rows per word at most.

    - masks (word, mask, flips): every flip of a first word;
    - submasks (word, flips, sub, ...): every flip of a second word, given the flips left;
    - subwords (word, sub, ...): where the second words lie;
    - checks (word, flips, ...): both plans, to find the first word of a pair.
    """
    spark = like.sparkSession
    masks, submasks, subwords, checks = [], [], [], []
    outer_plan = [(shift, _ones(width), radius) for shift, width, radius in plan]
    for i, (shift, width, radius) in enumerate(plan):
        masks += [(i, mask, flips) for mask, flips in _masks(width, radius)]
        turn, bits = (shift + width) % HASH_BITS, HASH_BITS - width
        for flips in range(radius + 1):
            inner = word_plan(threshold - flips, inner_words[i], bits) if bits else []
            inner_plan = [(s, _ones(w), r) for s, w, r in inner]
            checks.append((i, flips, turn, outer_plan, inner_plan))
            for j, (s, w, r) in enumerate(inner):
                submasks += [(i, flips, j, turn, s, _ones(w), mask) for mask, _ in _masks(w, r)]
                if flips == 0:
                    subwords.append((i, j, turn, s, _ones(w)))
    where = [("sub", pa.int32()), ("turn", pa.int32()), ("shift", pa.int32()), ("ones", pa.int64())]
    cuts = pa.list_(pa.struct([("shift", pa.int32()), ("ones", pa.int64()), ("radius", pa.int32())]))
    word, flips = ("word", pa.int32()), ("flips", pa.int32())
    tables = (
        _literal_table(spark, masks, [word, ("mask", pa.int64()), flips]),
        _literal_table(spark, submasks, [word, flips, *where, ("submask", pa.int64())]),
        _literal_table(spark, subwords, [word, *where]),
        _literal_table(spark, checks, [word, flips, ("turn", pa.int32()), ("outer_plan", cuts), ("inner_plan", cuts)]),
    )
    return tuple(F.broadcast(t) for t in tables)


def linked_hashes(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """[X4] Pairs of hashes that link at least two different posts; `pairs` may carry `POSTS_OF_HASH`."""
    if all(f"{c}_{x}" in pairs.columns for c in POSTS_OF_HASH for x in "ab"):
        posts = [F.col(f"{c}_{x}") for x in "ab" for c in POSTS_OF_HASH]
        single = (posts[0] == posts[1]) & (posts[2] == posts[3]) & (posts[0] == posts[2])
        return pairs.filter(~single).select("hash_a", "hash_b", "distance")
    side = groups.select("hash", "low_post", "high_post")
    a = side.select(F.col("hash").alias("hash_a"), F.col("low_post").alias("la"), F.col("high_post").alias("ha"))
    b = side.select(F.col("hash").alias("hash_b"), F.col("low_post").alias("lb"), F.col("high_post").alias("hb"))
    same_single_post = (F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")) & (F.col("la") == F.col("lb"))
    return pairs.join(a, "hash_a").join(b, "hash_b").filter(~same_single_post).select(*pairs.columns)


def describe_pairs(pairs: DataFrame) -> DataFrame:
    """[X4] Distance with the similarity in percent, as number and as text."""
    d = F.col("distance")
    return pairs.withColumns({"similarity_pct": similarity_pct(d), "similarity": similarity_text(d)})


# --- totals -----------------------------------------------------------------------


def pair_total(images: DataFrame, pairs: DataFrame, threshold: int | None = None) -> DataFrame:
    """[A14] Exact number of similar pairs of images in different posts, without the pairs.

    Inside a hash: n(n-1)/2 minus the pairs within one post.  Between two hashes: the
    product of their sizes minus, over posts in both, the product of the post's
    images.  If `pairs` carries the sizes (`n`), it is not shuffled for them.  With the pairs' `threshold`, shared posts of
    at most `PAIRED_HASHES` hashes are found from the posts; others are looked up from the hash with fewer posts.
    """
    per_post = materialise(images.groupBy("hash", "post_id").agg(F.count(F.lit(1)).alias("c")), "per-post")
    c, n = F.col("c").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    sizes = per_post.groupBy("hash").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("posts"), F.sum(c * (c - 1)).alias("twice_inside")
    )
    within = sizes.select(((n * (n - 1) - F.col("twice_inside")) / 2).alias("amount"))

    def side(x: str) -> DataFrame:
        return sizes.select(F.col("hash").alias(f"hash_{x}"), F.col("n").alias(f"n_{x}"), F.col("posts").alias(f"p_{x}"))

    sized = pairs
    if "n_a" not in pairs.columns:
        sized = pairs.select("hash_a", "hash_b").join(side("a").drop("p_a"), "hash_a").join(side("b").drop("p_b"), "hash_b")
    n_a, n_b = F.col("n_a").cast("decimal(38,0)"), F.col("n_b").cast("decimal(38,0)")
    between = sized.select((n_a * n_b).alias("amount"))
    hashes_of = per_post.groupBy("post_id").agg(F.count(F.lit(1)).alias("_hashes"))
    paired = PAIRED_HASHES if threshold is not None else 1
    light = per_post.join(hashes_of.filter(F.col("_hashes").between(2, paired)).select("post_id"), "post_id")
    a = light.select("post_id", F.col("hash").alias("hash_a"), F.col("c").alias("c_a"))
    b = light.select("post_id", F.col("hash").alias("hash_b"), F.col("c").alias("c_b"))
    own = a.join(b, "post_id").filter((F.col("hash_a") < F.col("hash_b")) & (hamming(F.col("hash_a"), F.col("hash_b")) <= (threshold or 0)))
    overlap = own.select((-F.col("c_a").cast("decimal(38,0)") * F.col("c_b")).alias("amount"))
    # Posts of very many hashes are not paired off: their hashes are looked up from the pairs.
    heavy = materialise(hashes_of.filter(F.col("_hashes") > paired).select("post_id"), "heavy-posts")
    if not heavy.isEmpty():
        crowded = per_post.join(heavy, "post_id", "left_semi")
        known = crowded.select("hash").distinct()
        met = pairs.select("hash_a", "hash_b").join(known.withColumnRenamed("hash", "hash_a"), "hash_a", "left_semi").join(known.withColumnRenamed("hash", "hash_b"), "hash_b", "left_semi")
        met = met.join(side("a").drop("n_a"), "hash_a").join(side("b").drop("n_b"), "hash_b")
        a_smaller = F.col("p_a") <= F.col("p_b")
        ends = met.select(
            F.when(a_smaller, F.col("hash_a")).otherwise(F.col("hash_b")).alias("hash"),
            F.when(a_smaller, F.col("hash_b")).otherwise(F.col("hash_a")).alias("other"),
        )
        other = crowded.select(F.col("hash").alias("other"), "post_id", F.col("c").alias("c_other"))
        shared = ends.join(crowded, "hash").join(other, ["other", "post_id"])
        overlap = overlap.unionByName(shared.select((-c * F.col("c_other")).alias("amount")))
    amounts = [x.select(F.col("amount").cast("decimal(38,0)")) for x in (within, between, overlap)]
    every = amounts[0].unionByName(amounts[1]).unionByName(amounts[2])
    return every.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("total_pairs"))


# --- clusters ---------------------------------------------------------------------


def cluster_posts(
    images: DataFrame, threshold: int = DEFAULT_THRESHOLD, words: int | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """[X5] (component, post_id, likes): the posts of every cluster of similar images."""
    images = materialise(images.select("hash", "post_id", "likes"), "images")
    groups = hash_groups(images)
    links = linked_hashes(groups, similar_hashes(groups, threshold, words, carry=POSTS_OF_HASH) if pairs is None else pairs)
    parts = connected_components(forest(links, ("hash_a", "hash_b")), "hash_a", "hash_b")
    # A hash shared by many posts has one row on the small side of this join.
    counts = groups.select("hash", "n")
    hot = heaviest(counts, ["hash"], "n")
    labels = groups.select("hash").join(parts.withColumnRenamed("node", "hash"), "hash", "left")
    labels = labels.select("hash", F.coalesce("component", "hash").alias("component"))
    named = salted_join(images, labels, ["hash"], hot, spread=["post_id"])
    return named.groupBy("component", "post_id").agg(F.max("likes").alias("likes"))


def verdicts(clusters: DataFrame) -> DataFrame:
    """[X6, W4, U5] (post_id, verdict): keep the post with most likes, then the oldest.

    Losing in any cluster makes a post pending.
    """
    best = clusters.groupBy("component").agg(
        F.min(F.struct((-F.col("likes")).alias("rank"), "post_id")).alias("best"), F.count(F.lit(1)).alias("_rows")
    )
    hot = heaviest(best, ["component"], "_rows")
    winners = best.select("component", F.col("best.post_id").alias("winner"))
    judged = salted_join(clusters, winners, ["component"], hot, spread=["post_id"])
    lost = F.bool_or(F.col("post_id") != F.col("winner"))
    return judged.groupBy("post_id").agg(F.when(lost, "pending").otherwise("keeper").alias("verdict"))


# --- sample pairs -----------------------------------------------------------------


def sample_pairs(images: DataFrame, pairs: DataFrame, limit: int = SAMPLE_PAIRS) -> DataFrame:
    """[W10] The first `limit` similar pairs of images, in (first, second) image order.

    Images are ordered by (post_id, key).  A pair of hashes can only contribute if
    its own first pair is among the `limit` least first pairs, and an image only if
    at most 2*limit images of its hash (counting at most `limit` per post) stand
    before it.  So at most `limit` hash pairs are expanded, each from short lists.
    """
    pos = F.struct("post_id", "key")
    ranked = images.withColumn("pos", pos)
    same = images.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b")).distinct()
    edges = pairs.select("hash_a", "hash_b").unionByName(same)
    # First image of a hash, and first image of it in any other post.
    heads = ranked.groupBy("hash", "post_id").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy("hash").orderBy("pos"))
    leading = heads.withColumn("_rank", rank).filter(F.col("_rank") <= 2)
    lead = leading.groupBy("hash").agg(
        F.min("pos").alias("one"), F.max(F.when(F.col("_rank") == 2, F.col("pos"))).alias("two")
    )
    a = lead.select(F.col("hash").alias("hash_a"), F.col("one").alias("a1"), F.col("two").alias("a2"))
    b = lead.select(F.col("hash").alias("hash_b"), F.col("one").alias("b1"), F.col("two").alias("b2"))
    options = [
        F.when(
            F.col(x)["post_id"] != F.col(y)["post_id"],
            F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")),
        )
        for x in ("a1", "a2")
        for y in ("b1", "b2")
    ]
    first = edges.join(a, "hash_a").join(b, "hash_b").withColumn("first", F.least(*options))
    chosen = first.filter("first is not null").orderBy("first").limit(limit).select("hash_a", "hash_b")
    chosen = materialise(chosen, "edges")
    wanted = chosen.select(F.col("hash_a").alias("hash")).unionByName(chosen.select(F.col("hash_b").alias("hash")))
    short = ranked.join(F.broadcast(wanted.distinct()), "hash", "left_semi")
    for keys, most in ((["hash", "post_id"], limit), (["hash"], 2 * limit)):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("pos"))
        short = short.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    left = short.select(F.col("hash").alias("hash_a"), F.struct("pos", "hash", "likes", "title").alias("x"))
    right = short.select(F.col("hash").alias("hash_b"), F.struct("pos", "hash", "likes", "title").alias("y"))
    met = F.broadcast(chosen).join(left, "hash_a").join(right, "hash_b")
    once = (F.col("hash_a") != F.col("hash_b")) | (F.col("x.pos") < F.col("y.pos"))
    met = met.filter((F.col("x.pos.post_id") != F.col("y.pos.post_id")) & once)
    ordered = met.select(
        F.when(F.col("x.pos") < F.col("y.pos"), F.col("x")).otherwise(F.col("y")).alias("i"),
        F.when(F.col("x.pos") < F.col("y.pos"), F.col("y")).otherwise(F.col("x")).alias("j"),
    )
    top = ordered.orderBy("i.pos", "j.pos").limit(limit)
    i_post, j_post = F.col("i.pos.post_id"), F.col("j.pos.post_id")
    j_wins = (F.col("j.likes") > F.col("i.likes")) | ((F.col("j.likes") == F.col("i.likes")) & (j_post < i_post))
    return describe_pairs(
        top.select(
            F.col("i.pos.key").alias("first_key"),
            F.col("j.pos.key").alias("second_key"),
            F.when(j_wins, j_post).otherwise(i_post).alias("preferred_post"),
            F.when(j_wins, F.col("j.title")).otherwise(F.col("i.title")).alias("preferred_title"),
            F.when(j_wins, i_post).otherwise(j_post).alias("candidate_post"),
            F.when(j_wins, F.col("i.title")).otherwise(F.col("j.title")).alias("candidate_title"),
            hamming(F.col("i.hash"), F.col("j.hash")).alias("distance"),
        )
    )

"""Exact Jaccard similarity join of documents' word n-gram sets, as a metric-space join.

Jaccard distance is a metric, so a set x within eps of y obeys |d(x, p) - d(y, p)| <= eps for every pivot p.

1. Documents with equal sets form one class; its least doc_id stands for it.
2. A set can only have a partner if all but (1 - threshold) of its shingles occur elsewhere.  That is
   tested on a quarter of the shingles first, chosen by hash: a set that misses more of them than it may
   miss of all of them is out.  Of the sets that are left, all shingles are tested, again and again while the
   sets that go leave others alone.  No set with a partner is lost.
3. Items are ordered by how many sets have them.  Two similar sets share one of their first items, as many as a set may
   miss and one more, so sets that share none, directly or by others, are never similar: they fall into *bundles* (as in
   the prefix filter of Bayardo et al., 2007).  Nearly all bundles are a cluster of near copies; they are dealt to regions
   of one task's size, all at once.  Only bundles too heavy for one task go on to the pivots.
4. Pivots split those into Voronoi regions.  A set lives in the region of its nearest pivot and is
   copied to every region whose pivot is at most 2 eps farther; then each pair meets where one of the two
   lives.  Any function that changes by at most d(x, y) may stand for a pivot's distance: the constant
   RADIUS stands for one more, the outer region of sets that no pivot is near to.  It is split again by
   new pivots taken from it, until it fits one task.
5. Inside a region all sets within eps of the pivot are linked through it.  The others are compared with
   every set of the region.  A region too heavy for one task is cut into blocks, and pairs of blocks meet.

The links' connected components are computed by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import LOWER, Rolling, documents, materialise, mix, pack, repeated_keys, shingles, text_chunks, unpack, words
from shutterlake.operators.blocks import stars
from shutterlake.operators.components import connected_components

SAMPLED = np.uint64(1 << 62)  # shingle hashes below this are the tested quarter
RADIUS = 0.5
SLACK = 1e-9
SET = "doc_id long, n long, items binary"


@dataclass(frozen=True)
class Join:
    """`percent`: least similarity; `k`: words in a shingle.

    `pivots` and `pivot_items` bound the pivots of a round and their shingles (8 bytes each), and so what is
    broadcast; `region_weight` bounds a task's sets, each weighing its shingles and DOC_WEIGHT more.  All
    three change the split, never the result.
    """

    percent: int = 85
    k: int = 4
    pivots: int = 8192
    pivot_items: int = 1_500_000
    region_weight: int = 4_000_000

    def __post_init__(self):
        # Sets that share nothing with a pivot are never compared with it, so no region may reach as far as them.
        if RADIUS + 2 * self.eps + SLACK >= 1:
            raise ValueError(f"regions of radius {RADIUS} are too wide for a similarity of {self.percent}%")

    @property
    def eps(self) -> float:
        return 1 - self.percent / 100

    @property
    def least(self) -> int:
        """Smallest set that can be similar to another one without being equal."""
        return next(n for n in range(1, 102) if 100 * n >= self.percent * (n + 1))


DOC_WEIGHT = 500


def text_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes text by text in rising order, where each text's start)."""
    for lo, hi, data, at in text_chunks(batch):
        data = LOWER[data]
        starts, ends, first = words(data, at)
        grams, start = shingles(Rolling(data).spans(starts, ends), first, k)
        doc = np.repeat(np.arange(hi - lo), np.diff(start))
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
        yield lo, hi, grams, np.searchsorted(doc, np.arange(hi - lo + 1))


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sampled, print): set size, how many shingles are in the tested quarter, 128-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sampled, prints = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.uint64)
            for lo, hi, grams, at in text_sets(batch, k):
                n[lo:hi] = np.diff(at)
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(grams < SAMPLED)])
                sampled[lo:hi] = total[at[1:]] - total[at[:-1]]
                for c, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    turned = grams * np.uint64(salt)
                    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turned ^ (turned >> np.uint64(29)))])
                    prints[lo:hi, c] = summed[at[1:]] - summed[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(sampled), pa.array([row.tobytes() for row in prints], pa.binary())],
                ["doc_id", "n", "sampled", "print"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n long, sampled long, print binary")


def sampled_keys(k: int):
    def emit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids = batch.column("doc_id").to_numpy()
        for lo, hi, grams, at in text_sets(batch, k):
            chosen = grams < SAMPLED
            doc = np.repeat(ids[lo:hi], np.diff(at))[chosen]
            yield doc, np.zeros(len(doc), np.uint32), grams[chosen]

    return emit


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [b""] * batch.num_rows
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi, grams, at in text_sets(batch, k):
                n[lo:hi] = np.diff(at)
                items[lo:hi] = [grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(items, pa.binary())], ["doc_id", "n", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, SET)


def all_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, items in zip(batch.column("doc_id").to_pylist(), batch.column("items"), strict=True):
        keys = np.frombuffer(items.as_py(), np.uint64)
        yield np.full(len(keys), i), np.zeros(len(keys), np.uint32), keys


def with_shared_items(sets: DataFrame, p: Join) -> DataFrame:
    """The sets of which enough items occur in other sets of the result; rounds end when few sets go."""
    before = sets.count()
    while before:
        shared = repeated_keys(sets.select("doc_id", "items"), all_keys, counts=True).select(F.col("doc_id").alias("_id"), F.col("n").alias("_shared"))
        enough = 100 * (F.col("n") - F.col("_shared")) <= (100 - p.percent) * F.col("n")
        sets = materialise(sets.join(shared.hint("merge"), F.col("doc_id") == F.col("_id")).filter(enough).select("doc_id", "n", "items"), "sets")
        after = sets.count()
        if after > 0.9 * before:
            break
        before = after
    return sets


class Postings:
    """Overlaps of any set with each of a list of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(items, kind="stable")
        self.keys, self.first = np.unique(items[order], return_index=True)
        self.first = np.append(self.first, len(items))
        self.owner = owner[order]

    def pairs(self, items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, set, overlap) for all overlaps of the owners' items with the sets, in order; owners count from 0."""
        if not len(self.keys) or not len(items):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
        hit = self.keys[at] == items
        at, owner = at[hit], owner[hit]
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grid = np.bincount(np.repeat(owner, n) * len(self.size) + self.owner[where])
        pair = np.flatnonzero(grid)
        return pair // len(self.size), pair % len(self.size), grid[pair]

    def overlaps(self, items: np.ndarray) -> np.ndarray:
        _, other, overlap = self.pairs(items, np.zeros(len(items), np.int64))
        out = np.zeros(len(self.size), np.int64)
        out[other] = overlap
        return out


def distances(overlap: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 1.0 - overlap / np.maximum(n + sizes - overlap, 1)


def spread_pivots(sets: DataFrame, p: Join) -> list[tuple[int, np.ndarray]]:
    """Some sets of the table, by hash of doc_id, of which no two are within RADIUS.

    Later rounds take them from sets that live in the outer region, so each round empties it further.
    """
    sizes = sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.pivots).select("doc_id", "n").collect()
    total, chosen = 0, []
    for row in sizes:
        total += row["n"]
        if total > p.pivot_items and chosen:
            break
        chosen.append(row["doc_id"])
    ids = sets.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = sets.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "items").collect()
    found = sorted((r["doc_id"], np.frombuffer(bytes(r["items"]), np.uint64)) for r in rows)
    postings = Postings([s for _, s in found])
    taken = np.zeros(len(found), bool)
    for i, (_, s) in enumerate(found):
        near = distances(postings.overlaps(s), len(s), postings.size) <= RADIUS
        taken[i] = not (near & taken).any()
    return [x for x, t in zip(found, taken, strict=True) if t]


ROWS = 256  # sets compared with the pivots at a time


def regions(sets: DataFrame, pivots: list[tuple[int, np.ndarray]], p: Join) -> DataFrame:
    """Each set once for every region it belongs to: `cell` (-1: outer), `home`, `ball` (linked with the pivot)."""
    sent = sets.sparkSession.sparkContext.broadcast(pivots)
    eps, percent = p.eps, p.percent

    def place(n: np.ndarray, items: list[np.ndarray], names: np.ndarray, postings: Postings) -> tuple:
        rows = np.arange(len(n))
        row, pivot, overlap = postings.pairs(np.concatenate(items), np.repeat(rows, n))
        union = n[row] + postings.size[pivot] - overlap
        d = 1.0 - overlap / union
        best = np.ones(len(n))
        np.minimum.at(best, row, d)
        limit = np.minimum(best, RADIUS) + 2 * eps + SLACK
        inside = d <= limit[row]
        first = np.full(len(n), -1, np.int64)  # the nearest pivot, of equals the first
        nearest = np.flatnonzero((d == best[row]) & (d <= RADIUS))[::-1]
        first[row[nearest]] = pivot[nearest]
        outer = rows[limit >= RADIUS]
        return (
            np.concatenate([row[inside], outer]),
            np.concatenate([names[pivot[inside]], np.full(len(outer), -1, np.int64)]),
            np.concatenate([pivot[inside] == first[row[inside]], first[outer] == -1]),
            np.concatenate([(100 * overlap >= percent * union)[inside], np.zeros(len(outer), bool)]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([i for i, _ in sent.value], np.int64)
        postings = Postings([s for _, s in sent.value])
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                items = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("items")]
                row, cell, home, ball = place(part.column("n").to_numpy(), items, names, postings)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(home), pa.array(ball)], ["doc_id", "n", "items", "cell", "home", "ball"])

    placed = materialise(sets.select("doc_id", "n", "items").mapInArrow(run, SET + ", cell long, home boolean, ball boolean"), "regions")
    sent.destroy()
    return placed


def join_block(percent: int):
    """Links inside one block: the sets outside the pivot's ball against all sets; (src, dst) rows, each set at most once per root."""

    def run(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].to_numpy()
        ball = group["ball"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["items"]]
        postings = Postings(sets)
        label = np.arange(len(ids))
        if ball.any():
            label[ball] = np.flatnonzero(ball)[0]
        for i in np.flatnonzero(~ball):
            overlap = postings.overlaps(sets[i])
            linked = np.flatnonzero(100 * overlap >= percent * (len(sets[i]) + postings.size - overlap))
            merged = np.unique(label[linked])
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]
        root = ids[label]
        out = ids != root
        return pa.table([pa.array(ids[out]), pa.array(root[out])], ["src", "dst"])

    return run


def region_links(placed: DataFrame, p: Join) -> DataFrame:
    """Links found in all regions of `placed`, heavy ones cut into pairs of blocks.

    Sets of the ball need no comparison with each other: the pivot links them.  So blocks of the others
    meet all blocks, and blocks of the ball meet only those.
    """
    weight = F.sum(F.col("n") + DOC_WEIGHT)
    loads = placed.groupBy("cell").agg(weight.alias("all"), F.coalesce(F.sum(F.when(~F.col("ball"), F.col("n") + DOC_WEIGHT)), F.lit(0)).alias("open"))
    half = p.region_weight / 2
    cuts = loads.filter("open > 0").select(
        "cell",
        F.when(F.col("all") <= p.region_weight, F.lit(0)).otherwise(F.ceil(F.col("open") / half)).cast("int").alias("_open"),
        F.ceil((F.col("all") - F.col("open")) / half).cast("int").alias("_ball"),
    )
    at = placed.join(cuts, "cell")
    own = F.when(F.col("ball"), F.col("_open") + F.pmod(F.xxhash64("doc_id"), F.greatest("_ball", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest("_open", F.lit(1)))).cast("int")
    at = at.withColumn("_own", own)
    others = F.when(F.col("ball"), F.sequence(F.lit(0), F.col("_open") - 1)).otherwise(F.sequence(F.lit(0), F.col("_open") + F.col("_ball") - 1))
    pairs = F.when(F.col("_open") == 0, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(F.col("_own"), o).alias("a"), F.greatest(F.col("_own"), o).alias("b")))
    )
    at = at.withColumn("_pair", F.explode(pairs))
    found = at.select("cell", F.col("_pair.a").alias("a"), F.col("_pair.b").alias("b"), "doc_id", "items", "ball").groupBy("cell", "a", "b")
    through = placed.filter("ball").select(F.col("doc_id").alias("src"), F.col("cell").alias("dst"))
    return found.applyInArrow(join_block(p.percent), "src long, dst long").unionByName(through).filter("src <> dst").distinct()


FLUSH = 1 << 21  # items that are dealt to buckets at a time


def dealt(target: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed arrays) for each bucket among `target`."""
    order = np.argsort(target, kind="stable")
    edge = np.flatnonzero(np.diff(target[order], prepend=-1, append=-1))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        at = order[lo:hi]
        yield int(target[at[0]]), pack(*(a[at] for a in arrays))


def blocks(rows: Iterator[tuple[int, bytes]]) -> pa.Table:
    found = list(rows)
    return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "blob"])


def unpacked(group: pa.Table, *kinds: type) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(b.as_py(), *kinds) for b in group["blob"]), strict=True)]


def bundle_links(sets: DataFrame, p: Join) -> DataFrame:
    """(src, dst): links between sets that share one of their rarest items, one link for each set and bucket at most.

    Sets that no chain of these links connects are not similar.  Buckets are dealt as in `repeated_keys`, by item, by
    set, and by item again; the second time only the first items of a set are sent.
    """
    buckets, percent = np.uint64(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), p.percent

    def of(x: np.ndarray) -> np.ndarray:
        return (x % buckets).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for i, n, items in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["items"], strict=True):
                keys = np.frombuffer(items.as_py(), np.uint64)
                parts.append((keys, np.full(len(keys), i), np.full(len(keys), n)))
                held += len(keys)
                if held >= FLUSH:
                    yield from send(parts)
                    parts, held = [], 0
        if parts:
            yield from send(parts)

    def send(parts: list) -> Iterator[pa.RecordBatch]:
        keys, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield from blocks(dealt(of(keys), keys, ids, n)).to_batches()

    def count(group: pa.Table) -> pa.Table:
        """The items that several sets have, with how many have them, dealt by set."""
        keys, ids, n = unpacked(group, np.uint64, np.int64, np.int64)
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        several = times[at] > 1
        keys, ids, n, times = keys[several], ids[several], n[several], times[at][several]
        return blocks(dealt(of(mix(ids.view(np.uint64))), keys, ids, n, times))

    def choose(group: pa.Table) -> pa.Table:
        """The first items of each set, and which of them it may share first with a set that is not smaller.

        Items that no other set has come before all others and link with none.
        """
        keys, ids, n, times = unpacked(group, np.uint64, np.int64, np.int64, np.int64)
        order = np.lexsort((keys, times, ids))
        keys, ids, n = keys[order], ids[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        size = np.diff(np.append(start, len(ids)))
        rank = np.arange(len(ids)) - np.repeat(start - (n[start] - size), size)
        first = rank <= n - -(-percent * n // 100)
        least = rank <= n - -(-2 * percent * n // (100 + percent))
        keys, ids, n, least = keys[first], ids[first], n[first], least[first]
        return blocks(dealt(of(keys), keys, ids, n, least))

    def link(group: pa.Table) -> pa.Table:
        """A set with an item is linked with the next smaller one that may share it first, if their sizes allow that.

        Between two similar sets all such sets have sizes between theirs, so a chain of links joins them.
        """
        keys, ids, n, least = unpacked(group, np.uint64, np.int64, np.int64, np.bool_)
        order = np.lexsort((n, keys))
        keys, ids, n, least = keys[order], ids[order], n[order], least[order]
        at = np.arange(len(keys))
        before = np.maximum.accumulate(np.where(least, at, -1))[:-1]
        a, b = before[before >= 0], at[1:][before >= 0]
        near = (keys[a] == keys[b]) & (100 * n[a] >= percent * n[b])
        found = stars(np.stack([ids[a[near]], ids[b[near]]]))
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["src", "dst"])

    kind = "bucket int, blob binary"
    counted = sets.select("doc_id", "n", "items").mapInArrow(deal, kind).groupBy("bucket").applyInArrow(count, kind)
    return counted.groupBy("bucket").applyInArrow(choose, kind).groupBy("bucket").applyInArrow(link, "src long, dst long")


def links(sets: DataFrame, p: Join = Join()) -> DataFrame:
    """(src, dst): links that connect exactly the sets that links of the full join connect.

    `sets`: doc_id, n, items (distinct uint64 hashes), doc_id unique.  Every row (src, dst) is a chain of
    links of the join, mostly one.  A set that shares no rare item with another has no link.
    """
    weight = F.sum(F.col("n") + DOC_WEIGHT)
    bundle = connected_components(bundle_links(sets, p)).select(F.col("node").alias("doc_id"), F.col("component").alias("bundle"))
    bundled = materialise(sets.select("doc_id", "n", "items").join(bundle.hint("merge"), "doc_id"), "bundles")
    loads = materialise(bundled.groupBy("bundle").agg(weight.alias("load")), "loads")
    heavy = loads.filter(F.col("load") > p.region_weight).select("bundle")
    light = loads.filter(F.col("load") <= p.region_weight).agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    cells = max(1, -(-8 * light // p.region_weight))
    # At most one heavy bundle for `region_weight` of all sets' weight.
    placed = bundled.join(F.broadcast(heavy), "bundle", "left_anti").select(
        "doc_id", "n", "items", F.pmod(F.xxhash64("bundle"), F.lit(cells)).alias("cell"), F.lit(False).alias("ball")
    )
    inner = materialise(region_links(placed, p), "links")
    rest = bundled.join(F.broadcast(heavy), "bundle", "left_semi")
    return inner if heavy.isEmpty() else inner.unionByName(pivot_links(rest, p))


def pivot_links(sets: DataFrame, p: Join) -> DataFrame:
    """`links` by pivots, round by round."""
    found, remaining = None, sets.withColumn("home", F.lit(True))
    while True:
        load = remaining.agg(F.coalesce(F.sum(F.col("n") + DOC_WEIGHT), F.lit(0))).first()[0]
        if load <= p.region_weight:
            placed = remaining.select("doc_id", "n", "items", F.lit(-1).cast("long").alias("cell"), F.lit(False).alias("ball"))
            last = region_links(placed, p)
            return found.unionByName(last) if found is not None else last
        placed = regions(remaining, spread_pivots(remaining.filter("home"), p), p)
        inner = materialise(region_links(placed.filter("cell >= 0"), p), "links")
        found = inner if found is None else found.unionByName(inner)
        outer = placed.filter("cell = -1")
        if outer.filter("home").limit(1).count() == 0:
            return found
        remaining = outer.select("doc_id", "n", "items", "home")


def near_duplicates(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """One row per input row: `doc_id`, `n_shingles`, `component_id` (least doc_id reachable by links).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing: their
    component is their own doc_id.  A row without doc_id takes no part: its component is null.  Repeated
    rows of a doc_id are one document, and give one result row each.  An empty table gives no rows.
    """
    whole = documents(docs)
    seen = materialise(summaries(whole, p.k), "summaries")
    named = seen.filter("doc_id is not null and n > 0")
    classes = materialise(named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sampled").alias("sampled")), "classes")
    shared = repeated_keys(whole.filter("doc_id is not null"), sampled_keys(p.k), counts=True)
    able = (
        classes.filter(F.col("n") >= p.least)
        .join(shared.withColumnRenamed("n", "_shared"), F.col("rep") == F.col("doc_id"), "left")
        .filter((100 * (F.col("sampled") - F.coalesce("_shared", F.lit(0)))) <= (100 - p.percent) * F.col("n"))
        .select("rep")
    )
    kept = whole.join(able.hint("merge"), F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id"])
    sets = with_shared_items(materialise(full_sets(kept, p.k), "sets"), p)
    edges = materialise(links(sets, p), "links")
    member = connected_components(edges).withColumnRenamed("node", "rep")
    roots = classes.join(member, "rep", "left").select("print", F.coalesce("component", "rep").alias("_root"))
    return seen.join(roots.hint("merge"), "print", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_root"))).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """The documents without those that are not the least of their component; rows without doc_id stay."""
    gone = near_duplicates(docs, p).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
fours AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p AS item
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, item FROM fours WHERE item IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 3),
sets AS MATERIALIZED (SELECT d.doc_id, count(g.item) AS n FROM documents d LEFT JOIN grams g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS n FROM grams a JOIN grams b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT i, j FROM shared s JOIN sets x ON x.doc_id = i JOIN sets y ON y.doc_id = j WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
both_ways AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.j FROM reached r JOIN both_ways b ON b.i = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

"""Counters that never fall below zero [W8, M4, M15].

Applying deltas d1..dn in order, with the value floored at zero after each, maps a
start value x to `max(x + sum, floor)`, where `floor` is the sum minus the least
prefix sum.  These (sum, floor) pairs combine associatively, so a long history is
cut into chunks that are folded on their own and then merged in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.operators.skew import ordered_chunks
from shutterlake.session import materialise


def _prefix_sums(chunks: DataFrame, key: str, order: Sequence[str], delta: str) -> DataFrame:
    """Sum and least prefix sum inside each (chunk, key), at every event."""
    w = W.partitionBy("_chunk", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = chunks.withColumn("_sum", F.sum(delta).over(w))
    return summed.withColumn("_low", F.min("_sum").over(w))


def _chunk_summary(summed: DataFrame, key: str, delta: str) -> DataFrame:
    return summed.groupBy("_chunk", key).agg(F.sum(delta).alias("_total"), F.min("_sum").alias("_least"))


def _chunk_starts(summary: DataFrame, key: str) -> DataFrame:
    """Sum and least prefix sum of everything before each chunk of a key."""
    before = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = summary.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    starts = starts.withColumn("_global_least", F.col("_offset") + F.col("_least"))
    return starts.withColumn("_least_before", F.min("_global_least").over(before))


def fold_deltas(events: DataFrame, key: str, order: Sequence[str], delta: str = "delta") -> DataFrame:
    """(key, delta_sum, delta_floor): the effect of all events of a key."""
    cut = ordered_chunks(events, [F.col(key), *[F.col(c) for c in order]])
    summary = _chunk_summary(_prefix_sums(cut, key, order, delta), key, delta)
    return _merge(summary, key)


def _merge(summary: DataFrame, key: str) -> DataFrame:
    merged = _chunk_starts(summary, key).groupBy(key)
    return merged.agg(
        F.sum("_total").cast("long").alias("delta_sum"), F.min("_global_least").cast("long").alias("_least")
    ).select(key, "delta_sum", (F.col("delta_sum") - F.col("_least")).alias("delta_floor"))


def merge_folds(folds: DataFrame, key: str, order: str) -> DataFrame:
    """Fold of folds: effects stored per batch, combined in batch order."""
    summary = folds.select(
        F.col(order).alias("_chunk"),
        key,
        F.col("delta_sum").alias("_total"),
        (F.col("delta_sum") - F.col("delta_floor")).alias("_least"),
    )
    return _merge(summary, key)


def apply_fold(start: Column, delta_sum: Column, delta_floor: Column) -> Column:
    """Counter after the folded events."""
    return F.greatest(F.coalesce(start, F.lit(0)) + delta_sum, delta_floor)


def running_counter(
    events: DataFrame, key: str, order: Sequence[str], delta: str = "delta", name: str = "value"
) -> DataFrame:
    """Counter value after every event, starting at zero."""
    cut = ordered_chunks(events, [F.col(key), *[F.col(c) for c in order]])
    chunks = materialise(cut, "counter")
    summed = _prefix_sums(chunks, key, order, delta)
    starts = _chunk_starts(_chunk_summary(summed, key, delta), key)
    # Only the first key of a chunk has a history in earlier chunks: one row per chunk.
    starts = starts.filter("_least_before is not null").select("_chunk", key, "_offset", "_least_before")
    sums = F.coalesce("_offset", F.lit(0)) + F.col("_sum")
    low = F.least(F.col("_least_before"), F.coalesce("_offset", F.lit(0)) + F.col("_low"), F.lit(0))
    joined = summed.join(F.broadcast(starts), ["_chunk", key], "left")
    return joined.withColumn(name, (sums - low).cast("long")).drop(
        "_chunk", "_sum", "_low", "_offset", "_least_before"
    )


def like_deltas(events: DataFrame, like: str = "like", unlike: str = "unlike") -> DataFrame:
    """[M4] +1 and -1 per action; other actions are dropped."""
    delta = F.when(F.col("action") == like, 1).when(F.col("action") == unlike, -1).cast("long")
    return events.withColumn("delta", delta).filter("delta is not null")


def apply_likes(posts: DataFrame, events: DataFrame, order: Sequence[str]) -> DataFrame:
    """[M4] Posts after a batch of like and unlike events (post_id, action, order...)."""
    return set_likes(posts, fold_deltas(like_deltas(events), "post_id", order))


def set_likes(posts: DataFrame, folded: DataFrame) -> DataFrame:
    """[M4] Posts after folded like events (post_id, delta_sum, delta_floor)."""
    joined = posts.join(folded.withColumnRenamed("post_id", "id"), "id", "left")
    likes = F.when(F.col("delta_sum").isNull(), F.col("likes")).otherwise(
        apply_fold(F.col("likes"), F.col("delta_sum"), F.col("delta_floor"))
    )
    return joined.withColumn("likes", likes).drop("delta_sum", "delta_floor")

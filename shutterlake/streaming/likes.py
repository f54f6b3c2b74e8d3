"""Live like counters [Q3].

A batch is folded to one (sum, floor) pair per post and stored under its batch
number.  Pairs of batches in a row are folded again, in tiers (`sources.tiers`).  The counters are the stored
pairs applied in batch order, so a batch costs what it brings, reading them costs a logarithm of the number
of batches for each post, a hot post is folded in parallel, and a repeated batch replaces itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shutterlake.operators.counters import fold_deltas, like_deltas, merge_folds, set_likes
from shutterlake.session import drop_path
from shutterlake.sources.snapshots import MARKER, BatchLog
from shutterlake.sources.tiers import Run, Tiers

FOLDS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("delta_sum", T.LongType()),
        T.StructField("delta_floor", T.LongType()),
    ]
)


class LikeLog(BatchLog):
    """Folds per batch, and folds of folds."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, {"folds": FOLDS})
        self.tiers = Tiers(self._run, lambda a, b: self._exists(f"{self._folder(a)}/{MARKER}" if a == b else f"{self._run(a, b)}/_SUCCESS"))

    def _run(self, first: int, last: int) -> str:
        return f"{self._folder(first)}/folds" if first == last else f"{self.root}/runs/run={first}_{last}"

    def _rows(self, runs: list[Run]) -> DataFrame:
        parts = [self.spark.read.schema(FOLDS).parquet(self._run(*r)).withColumn("batch", F.lit(r[0]).cast("long")) for r in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty("folds").withColumn("batch", F.lit(0).cast("long"))

    def store(self, batch: int, folds: DataFrame) -> None:
        """A batch's folds, then the runs that end with it.  Batches stay; merged runs that a larger one holds go."""
        self.append(batch, {"folds": folds})

        def merge(parts: list[Run], target: Run) -> None:
            merge_folds(self._rows(parts), "post_id", "batch").write.mode("overwrite").parquet(self._run(*target))

        self.tiers.compact(batch, merge, lambda r: None if r[0] == r[1] else drop_path(self.spark, self._run(*r)))

    def runs(self) -> list[Run]:
        return self.tiers.runs(max(self.batches(), default=-1) + 1)

    def folds(self) -> DataFrame:
        """(post_id, delta_sum, delta_floor) of each run, with its first `batch`."""
        return self._rows(self.runs())


def like_log(spark: SparkSession, root: str) -> LikeLog:
    return LikeLog(spark, root)


def start_like_stream(events: DataFrame, log: LikeLog, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Fold a stream of (post_id, action, order...) into the log."""

    def store(batch: DataFrame, number: int) -> None:
        log.store(number, fold_deltas(like_deltas(batch), "post_id", order))

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_likes(posts: DataFrame, log: LikeLog) -> DataFrame:
    """Posts with the likes after every stored batch."""
    return set_likes(posts, merge_folds(log.folds(), "post_id", "batch"))

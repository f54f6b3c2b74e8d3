"""Near-duplicate review from stored hashes, and hashing of new media [X6, X12, A14, W10]."""

from __future__ import annotations

from datetime import datetime
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.hashing import hash_to_hex, phash_from_coefficients
from shutterlake.operators import changes, similarity
from shutterlake.operators.skew import number_rows
from shutterlake.schema import Catalogue
from shutterlake.session import fresh_path, materialise
from shutterlake.sources import images
from shutterlake.sources.images import dct_coefficients

# Files one run opens at most.
RUN_FILES = 10_000


class Review(NamedTuple):
    """What a reviewer sees, and what can be applied."""

    verdicts: DataFrame  # post_id, verdict
    samples: DataFrame  # first similar pairs of images
    total: DataFrame  # total_pairs


def review(cat: Catalogue, threshold: int = similarity.DEFAULT_THRESHOLD) -> Review:
    """Cluster the hashed images of published posts; hashes are paired once for all parts."""
    hashed = materialise(similarity.hashed_assets(cat.assets, cat.posts), "hashed")
    groups = similarity.hash_groups(hashed)
    pairs = materialise(similarity.similar_hashes(groups, threshold, carry=(*similarity.POSTS_OF_HASH, "n")), "pairs")
    clusters = similarity.cluster_posts(hashed, threshold, pairs=pairs)
    return Review(
        similarity.verdicts(clusters), similarity.sample_pairs(hashed, pairs), similarity.pair_total(hashed, pairs, threshold)
    )


def apply_review(cat: Catalogue, verdicts: DataFrame, now: datetime) -> Catalogue:
    """[M6] Move the losers that are still published to pending."""
    losers = verdicts.filter("verdict = 'pending'").select(F.col("post_id").alias("id"))
    return cat._replace(posts=changes.send_to_pending(cat.posts, losers, now))


def hash_new_media(cat: Catalogue, pixels: DataFrame, limit: int | None = None) -> DataFrame:
    """[X12, J8, X1, X2] (post_id, key, phash, reason) for media without a hash.

    `pixels` is (key, pixels).  What cannot be hashed keeps a NULL hash and a reason,
    and is tried again by the next run.  `limit` bounds one run.
    """
    todo = similarity.unhashed_media(cat.posts, cat.assets).select("post_id", "key")
    if limit is not None:
        todo = todo.orderBy("post_id", "key").limit(limit)
    return _hashes(todo, pixels)


FILE_HASHES = "key string, _found boolean, phash string, reason string"
MISSING = "image missing or unreadable"


def _hashes(todo: DataFrame, pixels: DataFrame) -> DataFrame:
    joined = todo.join(pixels, "key", "left")
    return _file_hashes(joined).select("post_id", "key", "phash", "reason")


def _file_hashes(pixels: DataFrame) -> DataFrame:
    """`phash`, `reason` and `_found` in place of `pixels`."""
    hashed = dct_coefficients(pixels.withColumn("_found", F.col("pixels").isNotNull()))
    reason = F.when(~F.col("_found"), MISSING).when(F.col("coefficients").isNull(), "unexpected pixel format")
    phash = hash_to_hex(phash_from_coefficients("coefficients"))
    return hashed.withColumns({"phash": phash, "reason": reason}).drop("coefficients")


def hash_backfill(cat: Catalogue, pixels: DataFrame, now: datetime, limit: int | None = None) -> Catalogue:
    """[X12, M9] Catalogue with the new hashes stored."""
    return store_hashes(cat, hash_new_media(cat, pixels, limit), now)


class Run(NamedTuple):
    """One run of a backfill: the rows of `hash_new_media` for the files it opened, and how many these were."""

    hashed: DataFrame
    opened: int


class Backlog:
    """What a folder has to hash: listed and put in order once, and handed out run by run.

    `todo`: (post_id, key, place), where `place` counts the keys from 1, in order of their first post and name.  Paths pass
    through the driver, a partition at a time; what was handed out is not handed out again, hashed or not.
    """

    def __init__(self, todo: DataFrame, files: DataFrame):
        first = todo.groupBy("key").agg(F.min("post_id").alias("first"))
        placed = materialise(number_rows(first.join(files, "key"), ["first", "key"], name="place").select("place", "key", "path"), "backlog")
        self.todo = materialise(todo.join(placed.select("key", "place"), "key").repartitionByRange("place").sortWithinPartitions("place"), "todo")
        self._paths = (r["path"] for r in placed.select("place", "path").orderBy("place").toLocalIterator())
        self.at = 0
        self.runs: list[str] = []

    def take(self, n: int) -> tuple[list[str], DataFrame]:
        """Paths of the next files, `n` at most, and the rows of `todo` with their keys."""
        paths = list(islice(self._paths, n))
        low, self.at = self.at, self.at + len(paths)
        return paths, self.todo.filter((F.col("place") > low) & (F.col("place") <= self.at)).drop("place")

    def keep(self, hashes: DataFrame) -> DataFrame:
        """Write the hashes of a run's files."""
        self.runs.append(fresh_path(hashes.sparkSession, "file-hashes"))
        hashes.write.parquet(self.runs[-1])
        return hashes.sparkSession.read.schema(FILE_HASHES).parquet(self.runs[-1])

    def hashed(self) -> DataFrame:
        """The rows of all runs' `hashed`, joined at once."""
        spark = self.todo.sparkSession
        files = spark.read.schema(FILE_HASHES).parquet(*self.runs) if self.runs else spark.createDataFrame([], FILE_HASHES)
        return _run_rows(self.todo.filter(F.col("place") <= self.at), files)


def hash_backlog(cat: Catalogue, folder: str, skip: DataFrame | None = None) -> Backlog:
    """[X12, S5] Media without a stored hash that the folder has, for many runs of `hash_listed_media` in a row."""
    todo = similarity.unhashed_media(cat.posts, cat.assets).select("post_id", "key")
    if skip is not None:
        todo = todo.join(skip.select("key").distinct(), "key", "left_anti")
    # A key of several posts or folders is one file: the first path by name.
    files = images.list_images(cat.posts.sparkSession, folder).groupBy("key").agg(F.min("path").alias("path"))
    return Backlog(todo, files)


def hash_listed_media(cat: Catalogue, folder: str, limit: int = RUN_FILES, skip: DataFrame | None = None, backlog: Backlog | None = None) -> Run:
    """[X12, S5] Hash media without a stored hash from the files of a folder, opening no other file.

    The folder is listed, not read; listed keys without a hash, in order of post and key, are opened until `limit`
    files are reached: that many paths go through the driver.  `skip` (`key`) leaves out what failed before, so that
    unreadable files do not fill every run.  A run that finds nothing to do opens none.

    Runs in a row share a `backlog` (`hash_backlog`): each goes on where the one before ended, without listing the folder
    or asking for stored hashes again, so the hashes of all (`backlog.hashed()`) may be stored at once behind the last.
    """
    backlog = backlog or hash_backlog(cat, folder, skip)
    paths, todo = backlog.take(limit)
    if not paths:
        return Run(cat.posts.sparkSession.createDataFrame([], "post_id long, key string, phash string, reason string"), 0)
    # A row for each file of the run.
    hashes = F.broadcast(backlog.keep(_file_hashes(images.read_listed(cat.posts.sparkSession, paths))))
    return Run(_run_rows(todo, hashes), len(paths))


def _run_rows(todo: DataFrame, hashes: DataFrame) -> DataFrame:
    reason = F.when(F.col("_found"), F.col("reason")).otherwise(MISSING).alias("reason")
    return todo.join(hashes, "key", "left").select("post_id", "key", "phash", reason)


def store_hashes(cat: Catalogue, hashed: DataFrame, now: datetime) -> Catalogue:
    """[M9] Catalogue with the hashes of a run stored."""
    new = hashed.filter("phash is not null").withColumn("seq", F.lit(0))
    return cat._replace(assets=changes.upsert_hashes(cat.assets, new, now))

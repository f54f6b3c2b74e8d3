"""A catalogue whose changes write only what they touch [S8, M2-M6, M15, C13].

`posts`, `post_tags` and `assets` lie in buckets by the post's id, the same number of them, so a post, its links and
its assets are always in buckets of one number.  A version writes the buckets that a change touches and, last, the
list of the folders that make it up (`files`), its row of the storage counter (`ledger`), and the marker.  Untouched
buckets stay in the folders of earlier versions, which remain readable.

A change is any function from catalogue to catalogue that decides from the rows of a post alone (`delete_posts`,
`approve`, `send_to_pending`, an insert with given ids, ...).  It sees the touched buckets only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.capacity import LIMIT_BYTES, over_limit
from shutterlake.schema import ASSETS, POST_TAGS, POSTS, TAGS, Catalogue
from shutterlake.session import drop_path
from shutterlake.sources.snapshots import Snapshots

BUCKETS = 256
KEYS = {"posts": "id", "post_tags": "post_id", "assets": "post_id"}
FILES = T.StructType(
    [T.StructField("table", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("buckets", T.IntegerType()), T.StructField("version", T.LongType())]
)
LEDGER = T.StructType([T.StructField("delta_bytes", T.LongType()), T.StructField("total_bytes", T.LongType())])


class Written(NamedTuple):
    """The version current after a change, whether the change was refused for lack of space, and the counter."""

    version: int
    refused: bool
    total_bytes: int


class CatalogueStore(Snapshots):
    """Versions of a catalogue in `buckets` buckets, a number that stays fixed; growth beyond the limit is refused."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, limit_bytes: int = LIMIT_BYTES):
        super().__init__(spark, root, {"posts": POSTS, "post_tags": POST_TAGS, "assets": ASSETS, "tags": TAGS, "ledger": LEDGER, "files": FILES})
        self.buckets, self.limit_bytes = buckets, limit_bytes

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(self.buckets)).cast("int")

    def files(self, version: int) -> dict[str, dict[int, int]]:
        """For every table its buckets with rows, and the version whose folder holds each: `buckets` entries at most."""
        out: dict[str, dict[int, int]] = {name: {} for name in (*KEYS, "tags")}
        if version < 0:
            return out
        for row in super().read("files", version).collect():
            if row["buckets"] != self.buckets:
                raise ValueError(f"the store has {row['buckets']} buckets, not {self.buckets}")
            out[row["table"]][row["bucket"]] = row["version"]
        return out

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of a version; with `buckets`, the rows of these alone, and no file of others is opened."""
        version = self.version() if version is None else version
        if version < 0:
            return self._empty(table)
        if table in ("ledger", "files"):
            return super().read(table, version)
        wanted = None if buckets is None or table == "tags" else set(buckets)
        paths = [f"{self._folder(v)}/{table}/bucket={b}" for b, v in sorted(self.files(version)[table].items()) if wanted is None or b in wanted]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths) if paths else self._empty(table)

    def catalogue(self, version: int | None = None, buckets: Iterable[int] | None = None) -> Catalogue:
        version = self.version() if version is None else version
        return Catalogue(**{name: self.read(name, version, buckets) for name in ("posts", "tags", "post_tags", "assets")})

    def total_bytes(self) -> int:
        """[M15] The storage counter of the newest version."""
        row = self.read("ledger").first()
        return row["total_bytes"] if row else 0

    def history(self) -> DataFrame:
        """[M15] `version`, `delta_bytes`, `total_bytes`: one row per version."""
        numbers = self._complete()
        if not numbers:
            return self._empty("ledger").withColumn("version", F.lit(0).cast("long"))
        rows = self.spark.read.schema(LEDGER).parquet(*[f"{self._folder(n)}/ledger" for n in numbers])
        return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/ledger/", 1).cast("long").alias("version"), *LEDGER.names)

    def load(self, cat: Catalogue) -> Written:
        """A whole catalogue as the next version.  It is there already, so nothing is refused."""
        return self._commit(cat, None, self._empty("posts"), True, False)

    def rewrite(self, ids: DataFrame, change: Callable[[Catalogue], Catalogue]) -> Written:
        """[S8] Apply a change to the buckets of the posts `ids` (`id`; of old and new posts) as the next version.

        No ids, no version.  Rows that the change puts outside these buckets are an error.  [C13, M15] Where posts
        grow in bytes, the sum is admitted before anything is written, and once more as written; what is refused leaves no trace.
        """
        current = self.version()
        touched = {r[0] for r in ids.filter("id is not null").select(self.bucket("id")).distinct().collect()}
        if not touched:
            return Written(current, False, self.total_bytes())
        old = self.catalogue(current, touched)
        new = change(old)
        return self._commit(new, touched, old.posts, new.tags is not old.tags, True)

    def _commit(self, new: Catalogue, touched: set[int] | None, before: DataFrame, tags: bool, admit: bool) -> Written:
        current, spent = self.version(), self.total_bytes()
        number = current + 1
        folder = self._folder(number)
        self._unmark(number)
        drop_path(self.spark, folder)  # of a job that died
        assets = self._empty("assets") if new.assets is None else new.assets
        held = _bytes(before) if admit else 0
        # Only the columns of sizes are computed here; no text is shuffled or written for a change that has no room.
        if admit and new.posts is not before and self._refused(spent, _bytes(new.posts) - held):
            dealt = (("posts", new.posts), ("post_tags", new.post_tags), ("assets", assets))
            _no_stray(set().union(*[self._buckets_of(rows, name) for name, rows in dealt]) - touched)
            return Written(current, True, spent)
        with ThreadPoolExecutor(4) as pool:
            jobs = [pool.submit(self._deal, rows, name, folder) for name, rows in (("posts", new.posts), ("post_tags", new.post_tags), ("assets", assets))]
            if tags:
                columns = [F.col(f.name).cast(f.dataType) for f in TAGS.fields]
                jobs.append(pool.submit(lambda: new.tags.select(*columns).write.parquet(f"{folder}/tags/bucket=0")))
            for job in jobs:
                job.result()
        written = {name: self._buckets_in(f"{folder}/{name}") for name in (*KEYS, "tags")}
        stray = set().union(*[written[name] for name in KEYS]) - (touched if touched is not None else set(range(self.buckets)))
        if stray:
            drop_path(self.spark, folder)
            _no_stray(stray)
        now = [f"{folder}/posts/bucket={b}" for b in sorted(written["posts"])]
        after = self.spark.read.schema(POSTS).parquet(*now) if now else self._empty("posts")
        delta = _bytes(after) - held
        # A change that is not the same when it runs again may have written more than was admitted.
        if admit and self._refused(spent, delta):
            drop_path(self.spark, folder)
            return Written(current, True, spent)
        # A load replaces all, so its counter starts anew; else the counter is floored at zero.
        total = delta if touched is None else max(0, spent + delta)
        files = []
        for name, old in self.files(current).items():
            gone = touched if name != "tags" else written["tags"]
            kept = {} if touched is None else {b: v for b, v in old.items() if b not in gone}
            files += [(name, b, self.buckets, v) for b, v in (kept | dict.fromkeys(written[name], number)).items()]
        self._write(
            number,
            {"ledger": self.spark.createDataFrame([(delta, total)], LEDGER), "files": self.spark.createDataFrame(files, FILES).coalesce(1)},
            partial=True,
        )
        return Written(number, False, total)

    def _refused(self, spent: int, delta: int) -> bool:
        if delta <= 0:
            return False
        return self.spark.range(1).select(over_limit(F.lit(spent), F.lit(delta), self.limit_bytes)).first()[0]

    def _deal(self, rows: DataFrame, name: str, folder: str) -> None:
        """Write rows by bucket.  Ranges of (bucket, post) spread a large bucket over several tasks."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields]
        dealt = rows.select(*columns, self.bucket(KEYS[name]).alias("bucket"))
        ordered = dealt.repartitionByRange("bucket", KEYS[name]).sortWithinPartitions("bucket", KEYS[name])
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")

    def _buckets_of(self, rows: DataFrame, name: str) -> set[int]:
        return {r[0] for r in rows.select(self.bucket(F.col(KEYS[name]).cast("long"))).distinct().collect()}

    def _buckets_in(self, path: str) -> set[int]:
        fs, hadoop_path = self._fs(path)
        if not fs.exists(hadoop_path):
            return set()
        names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
        return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}


def _no_stray(buckets: set[int]) -> None:
    if buckets:
        raise ValueError(f"the change wrote posts of buckets it was not to touch: {sorted(buckets, key=str)[:5]}")


def _bytes(posts: DataFrame) -> int:
    size = F.coalesce("photo_bytes", F.lit(0)) + F.coalesce("video_bytes", F.lit(0))
    return posts.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]

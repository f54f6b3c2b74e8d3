"""Exact duplicate removal with a persistent digest index.

The index is a table with one row per distinct text: its SHA-256, the document that stays, the batch it
came with.  It is bucketed and sorted by digest, so a new batch meets it in a sort-merge anti-join that
reads the index in place, and only the batch's distinct digests are shuffled.  Texts that the index lacks
are appended.  Only DataFrame functions are used.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import documents, free_name, materialise
from shutterlake.session import fresh_path


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null reads as empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(folded.cast("binary"), 256))


class DigestIndex:
    """A digest index in the shared folder, registered as table `name`.

    `buckets` should give buckets of some hundred MB; the default is `spark.sql.shuffle.partitions`.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, keyed: DataFrame, batch: int) -> DataFrame:
        """Append the texts of a batch (`doc_id`, `digest`) that the index lacks; the batch's new index rows.

        Within a batch the largest doc_id of equal texts stays; a text that the index has keeps its row.
        """
        groups = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        known = self.rows().select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.rows().filter(F.col("batch") == batch)

    def compact(self, name: str, path: str) -> DigestIndex:
        """The same index as one sorted file per bucket."""
        whole = DigestIndex(self.spark, name, path, self.buckets)
        self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)
        self.spark.catalog.refreshTable(name)
        return whole


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index under a fresh name in the shared folder."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", fresh_path(spark, "digests"))


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id` and `digest` of every row, written once: the texts are read a single time."""
    return materialise(documents(docs).select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Documents enter the index in two batches, larger ids first, so that of equal texts the largest doc_id
    stays although the index never changes a row.  Null texts count as empty.  Repeated rows are counted
    in `group_size` and share their row's fate.  A row without doc_id is counted; a group in which no row
    has one has no `keep_id` and keeps nothing.  An empty table gives no rows.  Rows and per-text results
    meet in a join whose row side adaptive execution splits where one text owns many rows.
    """
    spark = docs.sparkSession
    index = index or new_index(spark)
    keyed = digests(docs)
    low, high = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    newer = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    for batch, part in enumerate((keyed.filter(newer), keyed.filter(~newer))):
        index.admit(part, batch)
    sizes = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialise(sizes.join(index.rows().select("digest", "keep_id").hint("merge"), "digest"), "groups")
    return keyed.join(groups.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows without doc_id stay only if no other row has their text.

    Of repeated rows of one doc_id and text, one stays.
    """
    rows, keep, digest = (free_name(docs, c) for c in ("_rows", "_keep", "_digest"))
    judged = materialise(exact_duplicates(docs).select("doc_id", "kept", "text_sha256", "keep_id"), "exact")
    kept = judged.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows))
    kept = kept.select(F.col("doc_id").alias(keep), rows)
    nameless = judged.filter("keep_id is null").select(F.col("text_sha256").alias(digest)).distinct()
    marked = docs.join(kept, docs["doc_id"].cast("long") == kept[keep])
    once, more = marked.filter(F.col(rows) == 1), marked.filter(F.col(rows) > 1).dropDuplicates([keep])
    without = docs.filter("doc_id is null")
    lone = without.join(nameless, F.lower(F.hex(text_digest(without["text"]))) == nameless[digest])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns)).unionByName(lone.dropDuplicates([digest]).select(*docs.columns))


OP9_SQL = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY 1)
SELECT k.doc_id, g.keep_id, g.group_size, k.doc_id = g.keep_id AS kept, k.text_sha256
FROM keyed k JOIN groups g USING (text_sha256)
"""

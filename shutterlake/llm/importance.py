"""Resampling towards a target distribution by importance weights over hashed n-grams.

A table of 256 bytes lower-cases A-Z and turns every separator of a UTF-8 text into a space; `bytes.split` then yields the
words.  The crc32 of a word is the seed of the crc32 of the next one with a space before it, so an n-gram's value comes from
that of its first n-1 words.  Counters of hash buckets are summed, per task and then by Spark, over the corpus and over the
target texts; the logarithm of a bucket's smoothed ratio is its gain (Xie et al., 2023).  A document's weight is the sum of its
features' gains, and Gumbel noise from a hash of its id makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import documents, materialise
from shutterlake.operators.skew import number_rows


@dataclass(frozen=True)
class Resampling:
    """`n`: longest n-gram.  `percent` of the documents of at least `min_words` words are drawn."""

    n: int = 1
    buckets: int = 10_000
    scale: int = 1_000
    percent: int = 10
    min_words: int = 20
    seed: str = "2024"


# Digits, a-z (from A-Z, too) and the bytes of other characters; everything else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashes(text: bytes, n: int) -> tuple[list[int], int]:
    """crc32 of all runs of 1 to `n` words (joined by a space), and the number of words."""
    words = text.translate(FOLD).split()
    level = [zlib.crc32(w) for w in words]
    out = list(level) if n > 1 else level
    spaced = [b" " + w for w in words] if n > 1 else []
    for k in range(1, n):
        level = [zlib.crc32(w, seed) for w, seed in zip(spaced[k:], level[: len(words) - k], strict=True)]
        out += level
    return out, len(words)


def bucket_counts(texts: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """`bucket`, `n`: how many features of all texts are in it (buckets without any are left out)."""
    n, buckets = p.n, p.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update([h % buckets for h in hashes(text.as_py() or b"", n)[0]])
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> np.ndarray:
    """Whole-number gain of every bucket; at most `p.buckets` counts of each side reach the driver."""
    s, t = np.zeros(p.buckets, np.int64), np.zeros(p.buckets, np.int64)
    for counts, rows in ((s, source), (t, target)):
        for r in bucket_counts(rows, p).collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + p.buckets), float(t.sum() + p.buckets)
    ratio = ((t + 1).astype(float) * all_s) / ((s + 1).astype(float) * all_t)
    return np.array([math.floor(p.scale * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, p: Resampling = Resampling()) -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight` of every row; null and empty texts have no features and weight 0."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    n, buckets = p.n, np.uint32(p.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found, n_words = hashes(text.as_py() or b"", n)
                index = np.array(found, np.uint32) % buckets
                rows.append((n_words, len(found), int(sent.value[index].sum())))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    texts = documents(docs).withColumn("text", F.col("text").cast("binary"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, p: Resampling = Resampling()) -> Column:
    """Whole-number Gumbel noise from a hash of the id; null for null."""
    place = F.sha2(F.concat(F.lit(f"{p.seed}:"), doc_id.cast("string")).cast("binary"), 256)
    u = (F.conv(F.substring(place, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(float(-p.scale)) * F.log(-F.log(u)))


def resampled(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """One row per input row: `doc_id`, `n_features`, `weight`, `score`, `rank`, `n_words`.

    `rank` is 1, 2, ... for the rows drawn, by score and then doc_id, else null.  A row without doc_id has no
    score, is not drawn and not counted among those to draw from; its text counts as part of the corpus.
    A doc_id that occurs again is drawn per row.  Null and empty texts have weight 0; texts of any length are read
    whole, and count by their features.  Without target texts all gains are those of an empty target.  An empty table gives no rows.
    """
    scored = weights(docs, gains(docs, target, p), p).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), p)).cast("long"))
    rows = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= p.min_words)
    draw = rows.filter(able).count() * p.percent // 100
    ranked = number_rows(rows.filter(able), [F.desc("score"), F.col("doc_id"), F.col("_row")], name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    other = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(other).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """The rows of `docs` that are drawn, all columns; of a doc_id that occurs again, all rows once one is drawn."""
    ids = resampled(docs, target, p).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_drawn"], "left_semi")


def _op12_sql(p: Resampling = Resampling()) -> str:
    """The contract for unigrams as plain SQL; crc32 from its table of 256 values, which follows from its polynomial."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    found = f"regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH RECURSIVE bits AS (
  SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents),
goal AS MATERIALIZED (SELECT {found} AS w FROM benchmark),
places AS MATERIALIZED (SELECT r, unnest(w) AS word FROM words),
goal_places AS MATERIALIZED (SELECT unnest(w) AS word FROM goal),
distinct_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM places UNION SELECT word FROM goal_places)),
byte_lists AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM distinct_words),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda a, b: xor(a // 256, t[1 + (xor(a % 256, b))])), 4294967295::BIGINT) % {p.buckets} AS bucket
  FROM byte_lists, crc),
s AS (SELECT bucket, count(*) AS s FROM places JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal_places JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM places)::DOUBLE AS all_s, (SELECT count(*) FROM goal_places)::DOUBLE AS all_t),
gain AS MATERIALIZED (
  SELECT bucket, floor({p.scale} * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + {p.buckets})) / ((s + 1)::DOUBLE * (all_t + {p.buckets}))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, sum(g)::BIGINT AS weight FROM places JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w)::BIGINT AS n_words,
    (coalesce(weight, 0) + floor(-{p.scale} * ln(-ln((('0x' || substr(sha256('{p.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN sums USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= {p.min_words} AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {p.percent} * n // 100 THEN rank END AS rank, n_words
FROM scored LEFT JOIN ranked USING (r)"""


OP12_SQL = _op12_sql()

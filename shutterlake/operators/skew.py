"""Joins and ordered scans that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.session import materialise

# Rows one task handles easily; only heavier keys are worth splitting.
HOT_ROWS = 200_000
# At most this many keys are split.  Any further key owns less than 1/HOT_KEYS of
# the rows, which is no more than an ordinary partition.
HOT_KEYS = 1024
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `min_rows` rows: a table of at most `HOT_KEYS` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return heaviest(counts, keys, "_rows", min_rows)


def heaviest(
    counts: DataFrame, keys: Sequence[str], rows: str, min_rows: int = HOT_ROWS, limit: int = HOT_KEYS
) -> DataFrame:
    """`hot_keys` where the rows per key have been counted before; at most `limit` rows."""
    return counts.filter(F.col(rows) >= min_rows).orderBy(F.col(rows).desc(), *keys).limit(limit).select(*keys)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join in which the rows of hot keys of `big` are spread over `salts` tasks.

    `spread` names the columns of `big` that tell rows of one key apart.  Rows of
    `small` with a hot key are repeated once per salt.  `hot` is broadcast; it has
    at most `HOT_KEYS` rows by construction.  The result is the plain join.
    """
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    bucket = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = big.join(marks, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot"), bucket).otherwise(F.lit(0))
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = small.join(marks, list(keys), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def ordered_chunks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add `_chunk`: ranges of the global order, each about one partition of rows.

    Chunk numbers follow the order.  Ranges are cut by sampling, so a heavy key
    is spread over many chunks.
    """
    return df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id())


def number_rows(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "rn"
) -> DataFrame:
    """`row_number() over (partition by keys order by order)` without one task per key.

    Rows are numbered inside each chunk of the global order; a small table of rows
    per (key, chunk) gives the start of each chunk.  With no keys that table has
    one row per chunk; with keys it is scanned per key, at most one row per chunk.
    The order must be total, else ties are broken at will.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by_key = [F.col(k) for k in keys]
    # Chunk numbers depend on the physical plan, so fix them before using them twice.
    chunks = materialise(ordered_chunks(df, [*by_key, *order]), "chunks")
    local = W.partitionBy("_chunk", *keys).orderBy(*order)
    starts = (
        chunks.groupBy("_chunk", *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    # Only keys cut by a chunk border start above zero: at most one per chunk.
    shifts = starts.filter("_before > 0").select("_chunk", *keys, "_before")
    return (
        chunks.withColumn(name, F.row_number().over(local).cast("long"))
        .join(F.broadcast(shifts), ["_chunk", *keys], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_before", "_chunk")
    )

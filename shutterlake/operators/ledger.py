"""Storage counter kept from a ledger of size changes [M15]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.counters import apply_fold, fold_deltas
from shutterlake.operators.overview import storage_total


def counter_after(start: Column, ledger: DataFrame, order: list[str]) -> DataFrame:
    """[M15, W8] One row: the counter after all ledger rows (`bytes`), floored at zero each time."""
    folded = fold_deltas(ledger.withColumn("_all", F.lit(1)), "_all", order, delta="bytes")
    return folded.select(apply_fold(start, F.col("delta_sum"), F.col("delta_floor")).alias("total_bytes"))


def reconcile(objects: DataFrame) -> DataFrame:
    """[M15, A11] The counter set anew from the object inventory."""
    return storage_total(objects)

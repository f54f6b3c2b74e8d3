"""Storage accounting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capacity in decimal bytes, and the share that stops new uploads.
LIMIT_BYTES = 10_000_000_000
REJECT_SHARE = 0.95
_UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(c: Column | str) -> Column:
    """[C11] Decimal units, at most two decimals, no trailing zeros."""
    size = (F.col(c) if isinstance(c, str) else c).cast("double")

    def label(power: int) -> Column:
        number = F.format_string("%.2f", size / F.lit(1000.0**power))
        return F.concat(F.regexp_replace(number, r"\.?0+\z", ""), F.lit(f" {_UNITS[power]}"))

    text = label(0)
    for power in range(1, len(_UNITS)):
        text = F.when(size >= 1000.0**power, label(power)).otherwise(text)
    return F.when(size == 0, F.lit("0 B")).otherwise(text)


def usage_columns(total: Column | str, limit_bytes: int = LIMIT_BYTES) -> dict[str, Column]:
    """[C12] Used, limit, remaining (never negative) and percent (at most 100)."""
    total = F.coalesce(total, F.lit(0)).cast("long")
    percent = F.least(F.lit(100.0), total / F.lit(float(limit_bytes)) * 100)
    return {
        "total_bytes": total,
        "limit_bytes": F.lit(limit_bytes).cast("long"),
        "remaining_bytes": F.greatest(F.lit(0).cast("long"), F.lit(limit_bytes) - total).cast("long"),
        "percent": F.floor(percent * 10 + 0.5) / F.lit(10.0),
    }


def over_limit(total: Column, incoming: Column, limit_bytes: int = LIMIT_BYTES) -> Column:
    """[C13] True when the upload must be refused."""
    return total + incoming >= F.lit(REJECT_SHARE * limit_bytes)

"""Timestamps.  `now` is always an argument, so that every job can be replayed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PENDING_DAYS = 3
TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def moment(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def canonical_timestamp(c: Column | str) -> Column:
    """[C5] Any parsable text; the epoch for the rest."""
    return F.coalesce(F.try_to_timestamp(c), F.lit("1970-01-01 00:00:00").cast("timestamp"))


def upload_timestamp(c: Column | str, now: datetime | Column) -> Column:
    """[C5] A missing value means now; an unparsable one is NULL and must be rejected."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text == "", moment(now)).otherwise(F.try_to_timestamp(text))


def timestamp_text(c: Column | str) -> Column:
    return F.date_format(c, TEXT_FORMAT)


def hours_left(created_at: Column | str, now: datetime | Column) -> Column:
    """[C10] Whole hours, rounded up, until a pending post expires."""
    expires = F.unix_micros(F.col(created_at) if isinstance(created_at, str) else created_at) + F.lit(
        PENDING_DAYS * 86_400_000_000
    )
    return F.ceil((expires - F.unix_micros(moment(now))) / F.lit(3_600_000_000)).cast("long")


def expiry_critical(created_at: Column | str, now: datetime | Column) -> Column:
    """[C10] Less than a day left, or overdue."""
    return hours_left(created_at, now) < 24


def expired(created_at: Column | str, now: datetime | Column) -> Column:
    """Strictly older than the retention of pending posts."""
    created = F.col(created_at) if isinstance(created_at, str) else created_at
    return created < moment(now) - F.expr(f"INTERVAL {PENDING_DAYS} DAYS")


def display_date(updated_at: Column | str, created_at: Column | str) -> Column:
    """[C15] Last edit, else creation."""
    return F.date_format(F.coalesce(updated_at, created_at), "yyyy/MM/dd")

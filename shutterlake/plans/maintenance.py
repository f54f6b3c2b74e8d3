"""Scheduled upkeep: expiry, duplicate removal, renames, as one change each [M10, M13, X10]."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame

from shutterlake.operators import accounts, changes, dedup
from shutterlake.schema import Catalogue
from shutterlake.session import materialise


class Cleanup(NamedTuple):
    catalogue: Catalogue
    deleted: DataFrame  # id
    freed: DataFrame  # keys, freed_bytes


def cleanup(cat: Catalogue, objects: DataFrame, now: datetime, limit: int | None = None) -> Cleanup:
    """[M10, A12] Expire pending posts and unused tags, and report the bytes freed."""
    after, gone = changes.expire_pending(cat, now, limit)
    return Cleanup(after, gone, changes.freed_bytes(cat.posts, gone, objects))


def remove_copies(cat: Catalogue, objects: DataFrame) -> Catalogue:
    """[X7, X10] Find and merge all copies of posts."""
    found = materialise(dedup.duplicate_posts(cat.posts, objects), "found")
    return dedup.apply_post_fixes(cat, objects, found)


def rename(cat: Catalogue, renames: DataFrame) -> Catalogue:
    """[M13] Rename accounts and their posts together."""
    valid = accounts.valid_renames(cat.accounts, renames)
    return cat._replace(
        accounts=accounts.rename_accounts(cat.accounts, valid), posts=accounts.rename_posts(cat.posts, valid)
    )

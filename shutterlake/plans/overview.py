"""Statistics kept per snapshot version [M16, A4, A19]."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from shutterlake.operators import overview
from shutterlake.operators.tags import tag_table
from shutterlake.sources.snapshots import Snapshots


class Directory(NamedTuple):
    """[A19] Authors and tags, each by name."""

    authors: DataFrame
    tags: DataFrame


def stored_overview(store: Snapshots) -> DataFrame:
    """[M16] The author overview of the newest version, computed once per version."""
    return store.derived("overview", lambda: overview.author_overview(store.read("posts")))


def known_total(stored: DataFrame, published: int) -> int:
    """[A1, A4] Posts in one state, from the overview's total row."""
    column = "published" if published == 1 else "pending"
    row = stored.filter("is_total = 1").select(column).first()
    return int(row[0]) if row else 0


def directory(posts: DataFrame, tags: DataFrame, public: bool = True) -> Directory:
    """[A19]"""
    authors = overview.published_authors(posts) if public else overview.all_authors(posts)
    return Directory(authors.orderBy("author"), tag_table(tags))

"""Joins of many rows per key with one row per key, safe where one key owns most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortloom.session import materialise


def stored_join(facts: DataFrame, per_key: DataFrame, key: str = "person_id", how: str = "inner") -> DataFrame:
    """Join facts to a table with at most one row per key, which is stored first.

    Spark splits a skewed partition only where both sides of a join come straight from a
    shuffle. A side that was just aggregated by the same key does not; stored, it does, so
    adaptive execution splits a hot key by its measured size, whatever that is, and repeats
    only that key's row. how: inner, left, left_semi or left_anti."""
    return facts.join(materialise(per_key, "per_key"), key, how)

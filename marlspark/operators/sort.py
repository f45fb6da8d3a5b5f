"""ORDER BY and LIMIT."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.analyzer import Resolved


def ordered(frame: DataFrame, keys: list[tuple[Resolved, bool]]) -> DataFrame:
    return frame.orderBy(*(c.ref().desc() if down else c.ref().asc() for c, down in keys)) if keys else frame


def limited(frame: DataFrame, limit: int) -> DataFrame:
    """A limit of 0 or less is none."""
    return frame.limit(limit) if limit > 0 else frame

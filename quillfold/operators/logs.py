"""Log history: ring, replay, filters and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring(log: DataFrame, capacity: int = 5000, key: str = "id") -> DataFrame:
    """The latest rows. A top-k by id: each task keeps at most `capacity` rows."""
    return log.orderBy(F.desc(key)).limit(capacity)


def history_after(log: DataFrame, after: int, key: str = "id") -> DataFrame:
    return log.where(F.col(key) > after)


def visible(level: Column, levels: Sequence[str], needle: str, *parts: Column) -> Column:
    """Level chosen and the text, in any case, found in the joined parts."""
    return level.isin(*levels) & F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle.lower()))


def as_json(*columns: str | Column) -> Column:
    """One JSON object in the given order; nulls are left out."""
    return F.to_json(F.struct(*columns))

"""Colour profiles: arrays that embed equal profiles share one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedup


def fingerprint(content: Column, components: Column) -> Column:
    """Digest of a profile's bytes and the low byte of its number of components."""
    low = F.unhex(F.lpad(F.hex(F.pmod(F.coalesce(components, F.lit(0)).cast("long"), F.lit(256))), 2, "0"))
    return F.sha2(F.concat(content, low), 256)


def merged(profiles: DataFrame, scope: str = "path") -> DataFrame:
    """scope, array_idx, stream_id, canonical, size for every array of profiles(scope, array_idx, stream_id, components,
    content) that moves to another stream: the first, in order, that holds the same. A scope of one array has none."""
    keyed = profiles.select(scope, "array_idx", "stream_id", fingerprint(F.col("content"), F.col("components")).alias("fp"), F.octet_length("content").cast("long").alias("size"), F.struct("array_idx", "stream_id").alias("at"))
    found = dedup.canonical(keyed, "fp", "at", [scope])
    return found.where(F.col("canonical.stream_id") != F.col("stream_id")).select(scope, "array_idx", "stream_id", F.col("canonical.stream_id").alias("canonical"), "size")


def saved(moves: DataFrame, scope: str = "path") -> DataFrame:
    """scope, profiles_merged, bytes_saved of merged(): each profile that nothing uses any more counts once."""
    return moves.select(scope, "stream_id", "size").distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("profiles_merged"), F.sum("size").alias("bytes_saved"))

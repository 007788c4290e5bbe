"""Content dedup: equal fingerprints within a scope share one canonical member, and references move to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_fingerprint(w: Column, h: Column, bits: Column, space: Column, filters: Column, content: Column, mask: Column | None = None) -> Column:
    """Digest of the shape header, the encoded bytes and, where there is one, the soft mask after a 1 byte; null content has none."""
    head = F.encode(F.concat(F.lit("w="), w.cast("string"), F.lit(";h="), h.cast("string"), F.lit(";bpc="), bits.cast("string"), F.lit(";cs="), F.coalesce(space, F.lit("")), F.lit(";f="), F.coalesce(filters, F.lit(""))), "UTF-8")
    body = F.concat(head, content)
    if mask is not None:
        body = F.when(mask.isNull(), body).otherwise(F.concat(body, F.unhex(F.lit("01")), mask))
    return F.sha2(body, 256)


def canonical(df: DataFrame, fingerprint: str, order: str, scope: Sequence[str] = (), name: str = "canonical") -> DataFrame:
    """df with the first member (by order) of each row's fingerprint class; rows without a fingerprint are their own.

    A class is summed up by a partial aggregate before the join, so a frequent one costs a row a task.
    """
    keys = [*scope, fingerprint]
    first = df.where(F.col(fingerprint).isNotNull()).groupBy(*keys).agg(F.min(order).alias(name))
    return df.join(first, keys, "left").withColumn(name, F.coalesce(name, order))


def repoint(refs: DataFrame, members: DataFrame, key: str, name: str = "canonical") -> DataFrame:
    """References with their target replaced by the target's canonical member."""
    return refs.join(members.select(key, name), key)

"""Structural similarity of arrays, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The constants that keep the quotient finite, for values up to 255.
C1, C2 = 6.5025, 58.5225


def blocks(df: DataFrame, key: str, a: str, b: str, size: int) -> DataFrame:
    """key, likeness: the mean over blocks of `size` places of the similarity of two arrays, with sample moments. Places that
    one array lacks are left out, as are blocks of a single place; a key without blocks has none."""
    pairs = df.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("pos", "p")).select(key, F.floor(F.col("pos") / size).alias("block"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    m = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(key, "block").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"))
    s = (2 * F.col("mx") * F.col("my") + C1) * (2 * F.col("c") + C2) / ((F.col("mx") ** 2 + F.col("my") ** 2 + C1) * (F.col("vx") + F.col("vy") + C2))
    return m.groupBy(key).agg(F.avg(s).alias("likeness"))

"""Reachability over object graphs, with cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: everything that roots(node) reach over edges(src, dst), roots included, however far.

    A breadth-first frontier: each round joins only the nodes found in the round before and drops those already seen,
    so cycles end, and rounds go on until one finds nothing. Each is written to the shared folder, so a lost executor costs
    no earlier round. Null nodes are passed over.
    """
    spark = edges.sparkSession
    folder, token = shared_folder(spark), uuid.uuid4().hex

    def keep(df: DataFrame, k: int) -> DataFrame:
        path = f"{folder}/reach-{token}/round-{k}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    frontier = keep(roots.where("node IS NOT NULL").select("node").distinct(), 0)
    links, found, k = edges.where("dst IS NOT NULL").select("src", "dst"), 1, 0
    while found:
        k += 1
        seen = spark.read.schema(frontier.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/reach-{token}")
        step = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(seen, "node", "left_anti"), k)
        found = frontier.limit(1).count()
    return spark.read.schema(frontier.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/reach-{token}")

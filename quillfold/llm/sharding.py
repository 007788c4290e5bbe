"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt by a hash into logical partitions. How many rows each partition sends to each shard is one row of a random
matrix with fixed margins (multivariate hypergeometric). A partition permutes its rows, sends them, and they are permuted
again where they arrive: a row's place in the order of arrival at its shard goes through a keyed bijection of the shard's
slots, and each block of slots is sorted.

The matrix is never built: a partition draws its own row by going down a binary tree over the partitions, where each
node splits the remaining capacities between its halves with a generator seeded by the node. All tasks that pass a node
draw the same split, so rows of the matrix agree without talking, and a lost task redraws the same row. What went left of
a partition's path is the number of rows that arrive before its own. A path needs the row counts of the left halves
along it only; they are summed and joined as tables, so nothing is gathered on the driver but the totals.

Nulls are values like any other, null text counts 16 bytes and CRC 0, an empty table gives no rows. Wholly equal rows are
interchangeable; all others have keys of their own, whatever order they arrive in. The number of partitions follows rows
and bytes, so very long texts make smaller partitions. Columns are handed on as one struct, so their names don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

ROWS_PER_PARTITION = 4096
BYTES_PER_PARTITION = 8 << 20
ROWS_PER_BLOCK = 16384


def capacities(rows: int, shards: int) -> np.ndarray:
    """Sizes of the shards, which differ by one at most."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def matrix_row(p: int, lefts: list[int], sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row p of the random matrix with column sums `sizes`, and the sums of the rows before it. lefts: the rows of the left
    half at each node on the way from the root to p."""
    left, before = sizes.astype(np.int64), np.zeros(len(sizes), np.int64)
    for depth, rows in enumerate(lefts):
        node = p >> (len(lefts) - depth)
        draw = np.random.default_rng([seed, depth, node]).multivariate_hypergeometric(left, rows, method="marginals")
        if p >> (len(lefts) - depth - 1) & 1:
            before, left = before + draw, left - draw
        else:
            left = draw
    return left, before


def bijection(at: np.ndarray, size: int, seed: int, shard: int, rounds: int = 6) -> np.ndarray:
    """Distinct places below `size` for distinct places below `size`: a balanced Feistel network over the next even
    number of bits, walked until the result is inside."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, shard, size]).integers(1, 2**63, rounds, dtype=np.uint64) | np.uint64(1)
    out, walking = at.astype(np.uint64), np.arange(len(at))
    while len(walking):
        x = out[walking]
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * k
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[walking] = (a << np.uint64(half)) | b
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def paths(counts: DataFrame, levels: int) -> DataFrame:
    """part, lefts from the stored counts(part, k): for each partition the rows of the left half at each node above it."""
    whole = F.lit(levels)
    above = counts.select("part", "k", F.explode(F.sequence(F.lit(0), whole)).alias("d"))
    sums = above.groupBy("d", F.expr(f"shiftright(part, {levels} - d)").alias("node")).agg(F.sum("k").alias("k"))
    need = counts.select("part", F.explode(F.sequence(F.lit(0), whole)).alias("d")).where(F.col("d") < whole)
    need = need.select("part", (F.col("d") + 1).alias("d"), (2 * F.expr(f"shiftright(part, {levels} - d)")).alias("node"))
    met = need.join(sums, ["d", "node"], "left").select("part", F.struct("d", F.coalesce("k", F.lit(0).cast("long")).alias("k")).alias("x"))
    return met.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["k"]).alias("lefts"))


def shard(docs: DataFrame, shards: int, payload: str, seed: int = 1, rows_per_partition: int = ROWS_PER_PARTITION, bytes_per_partition: int = BYTES_PER_PARTITION, rows_per_block: int | None = None) -> DataFrame:
    """The struct column named by payload, with shard (int) and slot (long, from 0 without gaps in its shard). docs has
    that column and text."""
    keep = c.Scratch(docs)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    levels = max(0, math.ceil(math.log2(max(1, n / rows_per_partition, size / bytes_per_partition))))
    row = F.col(payload).alias("row")
    key = F.xxhash64(F.lit(seed), F.col("row"))
    keyed = docs.select(row).withColumn("key", key).withColumn("part", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "key"), 64 - levels).cast("int") if levels else F.lit(0))
    counts = keep(keyed.groupBy("part").agg(F.count(F.lit(1)).alias("k")), "shard-counts")
    path = keep(paths(counts, levels), "shard-paths") if levels else counts.select("part", F.array().cast("array<bigint>").alias("lefts"))
    sizes = capacities(n, shards)

    def deal(rows: pa.Table, at: pa.Table) -> pa.Table:
        p = at.column("part")[0].as_py()
        random = np.random.default_rng([seed, p, 1])
        order = random.permutation(np.argsort(rows.column("key").to_numpy(), kind="stable"))
        take, before = matrix_row(p, at.column("lefts")[0].as_py(), sizes, seed)
        to = np.repeat(np.arange(shards), take)
        slot = np.concatenate([bijection(before[s] + np.arange(take[s]), int(sizes[s]), seed, s) for s in range(shards) if take[s]] or [np.zeros(0, np.int64)])
        return pa.table({"row": rows.column("row").take(pa.array(order)), "shard": pa.array(to.astype(np.int32)), "slot": pa.array(slot)})

    schema = T.StructType([keyed.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    dealt = keyed.groupBy("part").cogroup(path.groupBy("part")).applyInArrow(deal, schema)
    # a block, too, follows rows and bytes
    each = rows_per_block or max(64, min(ROWS_PER_BLOCK, bytes_per_partition * n // max(1, size)))
    block = F.floor(F.col("slot") / each)
    return dealt.repartition("shard", block).sortWithinPartitions("shard", "slot").select(F.col("row").alias(payload), "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    measured = F.struct("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard(docs.select("text", measured.alias("x")), 40, "x")
    return out.select("x.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

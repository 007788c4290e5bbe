"""Mixing sources to target weights by hash-random keys, distributed prefix sums and an exact cut.

Each document gets a key drawn from a hash of its id. The key's leading bits name a range of the key space; within each
source, sizes are summed by range and the range sums are accumulated. That tells in which range a source's budget ends;
only the rows of that one range are ordered, and the row at which the budget ends is the source's cut. All rows are then
taken by comparing them with their source's cut, in one pass and without moving them. A source may hold any share of the
rows: no task ever sees more than one range of it.

The number of ranges follows the row count. Null text has size 0, and texts are counted whole; a null source is a source
of its own, last in order; rows with equal ids are ordered by size and their text's hash, and wholly equal rows are
interchangeable. Empty input gives no rows. Sources are one row each in two windows that rank them: a million are a small
task. Columns besides doc_id, source and text don't matter, whatever their names; mix() hands on one column that the
caller names, such as a struct of them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

WEIGHTS = (3, 1, 2)
ROWS_PER_RANGE = 4096


def size_of(text: Column) -> Column:
    return F.size(c.tokens(text)).cast("long")


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from source, size: a share of all sizes split by weight, no target above `most` times
    its source.

    Filling to a level: with sources by ascending (most * size / weight), those that stay below their fair part of what
    is left are full, and the others have one common level per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    t = (
        w.withColumn("whole", F.sum("source_size").over(all_) * F.lit(share)).withColumn("all_w", F.sum("weight").over(all_))
        .withColumn("m0", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("w0", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("most") * (F.col("all_w") - F.col("w0")) <= F.col("weight") * (F.col("whole") - F.col("m0")))
    )
    t = t.withColumn("m1", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_), F.lit(0.0))).withColumn(
        "w1", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(all_), F.lit(0.0))
    )
    level = F.col("weight") * (F.col("whole") - F.col("m1")) / (F.col("all_w") - F.col("w1"))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level).alias("target"))


def key_of(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def named(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def cuts(slim: DataFrame, keep: c.Scratch, weights: tuple[int, ...], share: float, most: int, rows_per_range: int) -> DataFrame:
    """One row for each source of slim(doc_id, source, size, tie, key): its key `s`, source_size, target, epochs (taken
    whole), and the row at which the rest of the budget ends: `at` (its place in order; null: nothing is taken beyond the
    epochs), `into` (words taken of that row and its equals) and `equals` (how many wholly equal rows are there)."""
    digits = max(1, min(15, math.ceil(math.log(max(1, slim.count() / rows_per_range), 16))))
    part = F.substring("key", 1, digits)
    sums = keep(slim.groupBy("source", part.alias("part")).agg(F.sum("size").alias("size")), "mix-ranges")
    target = budgets(sums, weights, share, most).withColumn("s", named(F.col("source"))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    target = target.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    target = keep(target, "mix-targets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).withColumn("s", named(F.col("source")))
    last = based.join(target.select("s", "rest"), "s").where("base <= rest AND rest < base + size").select("s", F.col("part").alias("p"), "base", "rest")
    last = c.small(keep(last, "mix-last"), c.BROADCAST_ROWS)
    rows = slim.select(named(F.col("source")).alias("s"), part.alias("p"), "key", "doc_id", "size", "tie").join(last, ["s", "p"])
    place = F.struct("key", "doc_id", "size", "tie")
    ahead = rows.groupBy("s", place.alias("at")).agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("equals"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("ahead", F.col("base") + F.coalesce(F.sum("all").over(inside), F.lit(0).cast("long")))
    cut = ahead.where("ahead <= rest AND rest < ahead + all").select("s", "at", (F.col("rest") - F.col("ahead")).alias("into"), "equals")
    return target.drop("rest").join(cut, "s", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 1, whole_documents: bool = False, payload: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, source_size, target, taken and the column named by payload, one row for each row of docs.

    Whole epochs of a source are taken first; the last one is cut in key order at the exact word. With whole_documents
    the document at the cut is taken whole if at least half of it is inside, else left out.
    """
    keep = c.Scratch(docs)
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    sized = keep(slim, "mix-sizes") if payload else c.stored(slim, "mix-sizes")
    slim = sized.withColumn("key", key_of(F.col("doc_id"), seed))
    cut = c.stored(cuts(slim, keep, weights, share, most, rows_per_range), "mix-cuts")
    rows = slim
    if payload:
        rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), payload).withColumn("key", key_of(F.col("doc_id"), seed))
    rows = rows.withColumn("s", named(F.col("source"))).join(c.small(cut, c.BROADCAST_ROWS), "s").withColumn("place", F.struct("key", "doc_id", "size", "tie"))
    nothing = F.lit(0).cast("long")

    def taken(into: Column) -> Column:
        if whole_documents:
            into = F.when(2 * into >= F.greatest(F.col("size"), F.lit(1)), F.col("size")).otherwise(nothing)
        return F.least(F.col("epochs") * F.col("size") + into, most * F.col("size")).cast("long").alias("taken")

    columns = ["doc_id", "size", "source_size", "target", *([payload] if payload else [])]
    at = F.col("place").eqNullSafe(F.col("at"))
    before = F.when(F.col("place") < F.col("at"), F.col("size")).otherwise(nothing)
    if cut.where("equals > 1").take(1):
        # rows that equal their source's cut in everything: they are counted off one by one
        turn = F.row_number().over(Window.partitionBy("s").orderBy(F.lit(1))) - 1
        equal = rows.where(at).withColumn("turn", turn)
        each = F.least(F.col("size"), F.greatest(nothing, F.col("into") - F.col("turn") * F.col("size")))
        out = rows.where(~at).select(*columns, taken(before)).unionByName(equal.select(*columns, taken(each)))
    else:
        out = rows.select(*columns, taken(F.when(at, F.least("size", "into")).otherwise(before)))
    keep.close()
    return out


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(c.read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS whole, sum(weight) OVER () AS all_w,
 coalesce(sum(most) OVER o, 0.0::DOUBLE) AS m0, coalesce(sum(weight) OVER o, 0.0::DOUBLE) AS w0 FROM w
 WINDOW o AS (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, most * (all_w - w0) <= weight * (whole - m0) AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * (whole - coalesce(sum(most) FILTER (is_full) OVER (), 0.0::DOUBLE)) / (all_w - coalesce(sum(weight) FILTER (is_full) OVER (), 0.0::DOUBLE)) END AS target FROM g),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
 CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(epochs * size + least(size, greatest(0, floor(target - epochs * source_size) - ahead)), 2 * size) AS BIGINT) AS taken FROM p
"""

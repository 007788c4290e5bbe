"""Removal of repeated passages of lines, whose boundaries the content defines.

Windows roll over the lines of a text: every two neighbouring lines, and every single line of more than LONG_WORDS words.
A window that occurs more than once in the corpus is compared byte by byte, and the lines of all its occurrences but the
first (by doc_id, then line) go. A removed chunk is thus the union of overlapping windows: it begins and ends where the
lines stop being repeated, whatever stands around it. A line only goes for an earlier copy of its window, so the earliest
copy of every line stays; and a window that overlaps its own first occurrence leaves that whole. A short line whose
neighbours do not repeat with it stays, and so do blank windows.

Only hashes of windows are counted over the corpus; bodies are built for repeated hashes alone. Equal bodies are
grouped by partial aggregates, and no pairs are formed. Null text has no lines and stays null; rows that share a doc_id
are told apart by their text's hash, and wholly equal rows count as one occurrence each only across different ids. Texts
of any length are cut whole; an empty table gives no rows. drop_repeated() carries the other columns as one struct, so
their names don't matter; its own n_lines and n_removed replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LONG_WORDS = 50
#: A line of more than LONG_WORDS words has at least so many bytes.
LONG_BYTES = 2 * LONG_WORDS + 1


def lined(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))


def line_windows(lines: Column) -> Column:
    """array<struct<start, n, h>> of an array of lines, start from 0: pairs, and lines long enough to count alone."""
    def window(i, n, h):
        return F.struct(i.alias("start"), F.lit(n).alias("n"), h.alias("h"))

    def pairs(hashes):
        return F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - 1), lambda x, i: window(i, 2, F.xxhash64(x, F.get(hashes, i + 1))))

    alone = F.transform(lines, lambda x, i: F.when(F.octet_length(x) >= LONG_BYTES, window(i, 1, F.xxhash64(x))))
    return F.concat(c.let(F.transform(lines, lambda x: F.xxhash64(x)), pairs), F.filter(alone, lambda x: x.isNotNull()))


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, n, h for each window."""
    out = lined(docs).select("doc_id", "row", F.explode_outer(line_windows(F.col("lines"))).alias("x"))
    return out.where("x IS NOT NULL").select("doc_id", "row", "x.*")


def bodies(docs: DataFrame, hits: DataFrame, keep: c.Scratch, most_rows: int | None) -> DataFrame:
    """doc_id, row, start, n, h, body of the stored windows hits(doc_id, row, at), at being 2 * start + n - 1, less blank
    windows and single lines of too few words. Only these small numbers go into a broadcast."""
    per = keep(hits.groupBy("doc_id", "row").agg(F.collect_set("at").alias("hits")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_rk"), "hits"), "chunk-places")
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("rk"), "text")
    met = c.matching(texts, per, most_rows).select("doc_id", F.col("rk").alias("row"), "hits", F.split("text", "\n", -1).alias("lines"))

    def body(x):
        start, n = F.shiftright(x, 1), x % 2 + 1
        return F.struct(start.alias("start"), n.alias("n"), F.array_join(F.slice("lines", start + 1, n), "\n").alias("body"))

    out = met.select("doc_id", "row", F.explode_outer(F.transform("hits", body)).alias("x")).select("doc_id", "row", "x.*").withColumn("h", F.xxhash64("body"))
    return out.where(F.when(F.col("n") == 1, F.size(c.tokens(F.col("body"))) > LONG_WORDS).otherwise(F.col("body").rlike(r"[^\x20\x09-\x0D]")))


def repeated(docs: DataFrame, keep: c.Scratch, most_rows: int | None = None) -> DataFrame:
    """doc_id, row, line (from 0) of the lines in every occurrence but the first of a repeated window."""
    bound = c.BROADCAST_ROWS if most_rows is None else most_rows
    again = windows(docs).groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    again = keep(again, "chunk-hashes")
    listed = windows(docs)
    if again.count() > bound:
        listed = listed.where(c.may_be_in(again, "h", F.col("h")))
    hits = keep(listed.join(c.small(again, bound), "h").select("doc_id", "row", (2 * F.col("start") + F.col("n") - 1).alias("at")), "chunk-windows")
    found = keep(bodies(docs, hits, keep, most_rows), "chunk-bodies")
    keep.drop(again, hits)
    # bodies are compared by grouping; only those whose hash stands for several need be joined by their bytes again
    place = F.struct("doc_id", "row", "start")
    first = lambda df: df.groupBy("h", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m"))
    by_hash = keep(first(found).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("m").alias("m"), F.min("first").alias("first")), "chunk-first")
    met = found.drop("body").join(c.small(by_hash.where("k = 1 AND m > 1").select("h", "first"), bound), "h")
    mixed = by_hash.where("k > 1").select("h")
    if mixed.take(1):
        apart = found.join(mixed, "h")
        met = met.unionByName(apart.join(first(apart).where("m > 1").drop("m"), ["h", "body"]).drop("body"))
    later = met.where(~place.eqNullSafe(F.col("first"))).withColumn("line", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("line") < F.col("first.start") + F.col("n"))
    return later.where(~own).select("doc_id", "row", "line")


def stretches(at: str) -> Column:
    """array<struct<start, n>> of the sorted array of line numbers in the column `at`."""
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) < x - 1, F.lit(True)))
    ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) > x + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))


def drop_repeated(docs: DataFrame, most_rows: int | None = None) -> DataFrame:
    """docs with text less its repeated passages, n_lines (before) and n_removed (lines)."""
    keep = c.Scratch(docs)
    gone = repeated(docs.select("doc_id", "text"), keep, most_rows)
    per = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("at")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_rk"), stretches("at").alias("gone"))
    per = c.stored(per, "chunk-gone")
    keep.close()
    rows = docs.select(F.struct("*").alias("payload"), "doc_id", F.xxhash64("text").alias("rk"), "text")
    out = c.looked_up(rows, per, most_rows).withColumn("lines", F.split("text", "\n", -1))
    # the kept stretches lie between the removed ones
    out = out.withColumn("gap", F.concat(F.col("gone"), F.array(F.struct(F.size("lines").alias("start"), F.lit(0).alias("n")))))

    def stretch(x, j):
        before = F.coalesce(F.get("gap", j - 1)["start"] + F.get("gap", j - 1)["n"], F.lit(0))
        return F.slice("lines", before + 1, x["start"] - before)

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform("gap", stretch)), "\n"))
    out = out.select(
        "payload", kept.alias("kept"), F.greatest(F.lit(0), F.coalesce(F.size("lines"), F.lit(0))).cast("long").alias("n"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long").alias("less"),
    )
    own = ("text", "n_lines", "n_removed")
    return out.select(*[F.col("payload")[x].alias(x) for x in docs.columns if x.lower() not in own], F.col("kept").alias("text"), F.col("n").alias("n_lines"), F.col("less").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated(c.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

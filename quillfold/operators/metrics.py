"""Operational metrics: counters, timers and gauges from results, their text form, health and build information."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the meters, the actions on images, and the build's entries.
PREFIX, IMAGES = "pcs.compression", "pcs.images"
ACTIONS = ("inspected", "downsampled", "recompressed", "unchanged")
BUILD = ("name", "version", "buildTime", "buildNumber", "gitSha")


def outcome(returned_original: Column) -> Column:
    return F.when(returned_original, "original").otherwise("compressed")


def tagged(df: DataFrame, tag: str, value: Column) -> DataFrame:
    """tag, requests, total, most, mean of a value by tag; negative values count as 0."""
    clamped = F.greatest(F.lit(0).cast("double"), value.cast("double"))
    return df.groupBy(tag).agg(F.count(F.lit(1)).alias("requests"), F.sum(clamped).alias("total"), F.max(clamped).alias("most"), F.avg(clamped).alias("mean"))


def actions(df: DataFrame, **counts: Column) -> DataFrame:
    """action, images: the sum of each named count, one row each."""
    one = df.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0).cast("long")).alias(k) for k, v in counts.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in counts)
    return one.selectExpr(f"stack({len(counts)}, {pairs}) AS (action, images)")


def capped_distinct(df: DataFrame, key: str, value: Column, most: int, name: str) -> DataFrame:
    """key, name: whether the key has more than `most` distinct values. Exact: distinct values are merged in parts."""
    return df.groupBy(key).agg((F.count_distinct(value) > most).alias(name))


def meters(results: DataFrame, failures: DataFrame | None = None, slots: int | None = None, in_flight: int | None = None) -> DataFrame:
    """meter, tag, value of compression results: requests and durations by outcome, bytes in, out and saved, saved percent,
    images by action; failures(reason) by reason; gauges of the slots. Saved bytes and percents below 0 count as 0."""
    done = results.withColumn("tag", outcome(F.col("returned_original")))
    ms = F.col("duration_millis") / 1000.0
    by = done.groupBy("tag").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(ms).alias("s"), F.max(ms).alias("m"))
    stack = lambda df, rows: df.selectExpr("tag", f"stack({len(rows)}, " + ", ".join(f"'{k}', CAST({v} AS double)" for k, v in rows) + ") AS (meter, value)").select("meter", "tag", "value")
    out = stack(by, [(f"{PREFIX}.requests", "n"), (f"{PREFIX}.duration.count", "n"), (f"{PREFIX}.duration.sum", "s"), (f"{PREFIX}.duration.max", "m")])
    least = lambda x: F.greatest(F.lit(0), F.col(x))
    whole = results.agg(
        F.sum("original_bytes").alias("i"), F.sum("compressed_bytes").alias("o"), F.sum(least("saved_bytes")).alias("b"), F.count(F.lit(1)).alias("c"), F.sum(least("saved_percent")).alias("p"), F.max(least("saved_percent")).alias("x")
    ).withColumn("tag", F.lit(""))
    out = out.unionByName(stack(whole, [(f"{PREFIX}.bytes.in", "i"), (f"{PREFIX}.bytes.out", "o"), (f"{PREFIX}.bytes.saved", "b"), (f"{PREFIX}.saved.percent.count", "c"), (f"{PREFIX}.saved.percent.sum", "p"), (f"{PREFIX}.saved.percent.max", "x")]))
    images = actions(results, **{a: F.col(f"images_{a}") for a in ACTIONS})
    out = out.unionByName(images.select(F.lit(IMAGES).alias("meter"), F.col("action").alias("tag"), F.col("images").cast("double").alias("value")))
    if failures is not None:
        out = out.unionByName(failures.groupBy("reason").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(f"{PREFIX}.failures").alias("meter"), F.col("reason").alias("tag"), "value"))
    gauges = [(f"{PREFIX}.slots.{k}", "", float(v)) for k, v in (("max", slots), ("inflight", in_flight)) if v is not None]
    if gauges:
        out = out.unionByName(results.sparkSession.createDataFrame(gauges, "meter string, tag string, value double"))
    return out.where("value IS NOT NULL")


TAGS = {f"{PREFIX}.requests": "outcome", f"{PREFIX}.duration.count": "outcome", f"{PREFIX}.duration.sum": "outcome", f"{PREFIX}.duration.max": "outcome", f"{PREFIX}.failures": "reason", IMAGES: "action"}


def exposition(found: DataFrame) -> DataFrame:
    """line: the meters in the text format that scrapers read."""
    name = F.regexp_replace("meter", r"[^a-zA-Z0-9_]", "_")
    tag = F.element_at(F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))]), F.col("meter"))
    quoted = F.regexp_replace("tag", r'([\\"])', r"\\$1")
    labels = F.when(tag.isNotNull(), F.concat(F.lit("{"), tag, F.lit('="'), quoted, F.lit('"}'))).otherwise("")
    return found.select(F.concat(name, labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def in_flight(jobs: DataFrame) -> int:
    """How many jobs run."""
    return jobs.where("status = 'RUNNING'").count()


def health(spark: SparkSession, folder: str, slots: int, running: int) -> dict:
    """Whether the folder for intermediate files can be written, and the slots in use."""
    jvm = spark.sparkContext._jvm
    probe = jvm.org.apache.hadoop.fs.Path(f"{folder}/health-{uuid.uuid4().hex}.tmp")
    try:
        system = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.create(probe, True).close()
        system.delete(probe, False)
        up = True
    except Exception:  # any failure of the store means that it can't be written
        up = False
    return {"status": "UP" if up else "DOWN", "tempDirWritable": up, "maxConcurrentCompressions": slots, "inFlightCompressions": running}


def version(build: dict | None) -> dict:
    """The build's entries in order; without any, an unknown version."""
    return {k: build.get(k) for k in BUILD} if build else {"version": "unknown"}

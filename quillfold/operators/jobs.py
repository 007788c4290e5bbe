"""Jobs: states, views, look-ups, results, eviction, admission and load."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage

# The states of a job, which of them end it, and the statistics that its view shows.
QUEUED, RUNNING, SUCCEEDED, FAILED = STATES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED")
ENDED = (SUCCEEDED, FAILED)
STATS = (
    ("originalBytes", "original_bytes"), ("compressedBytes", "compressed_bytes"), ("savedBytes", "saved_bytes"), ("savedPercent", "saved_percent"), ("pageCount", "page_count"),
    ("imagesInspected", "images_inspected"), ("imagesRecompressed", "images_recompressed"), ("durationMillis", "duration_millis"), ("returnedOriginal", "returned_original"),
)


def states(events: DataFrame) -> DataFrame:
    """job_id, status, filename, submitted_bytes, submitted_at, started_at, finished_at, error of events(job_id, seq, ts,
    status, filename, submitted_bytes, error): one row for each job. A job is queued, then runs, then ends; events that
    come after its end change nothing. The first of several starts counts."""
    end = F.col("status").isin(*ENDED)
    first_end = F.min(F.when(end, F.struct("seq", "status", "ts", "error")))
    per = events.groupBy("job_id").agg(
        first_end.alias("e"), F.min_by("filename", F.when(F.col("filename").isNotNull(), F.col("seq"))).alias("filename"), F.min_by("submitted_bytes", F.when(F.col("submitted_bytes").isNotNull(), F.col("seq"))).alias("submitted_bytes"),
        F.min(F.when(F.col("status") == QUEUED, F.struct("seq", "ts"))).alias("q"), F.min(F.when(F.col("status") == RUNNING, F.struct("seq", "ts"))).alias("r"),
    )
    began = F.when(F.col("e").isNull() | (F.col("r.seq") < F.col("e.seq")), F.col("r.ts"))
    status = F.when(F.col("e").isNotNull(), F.col("e.status")).when(F.col("r").isNotNull(), RUNNING).otherwise(QUEUED)
    return per.select("job_id", status.alias("status"), "filename", "submitted_bytes", F.col("q.ts").alias("submitted_at"), began.alias("started_at"), F.col("e.ts").alias("finished_at"), F.when(F.col("e.status") == FAILED, F.col("e.error")).alias("error"))


def result_url(status: Column, job: Column) -> Column:
    return F.when(status == SUCCEEDED, F.concat(F.lit("/jobs/"), job.cast("string"), F.lit("/result")))


def view(jobs: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """job_id and view, the job as JSON without nulls: its result's address and statistics only once it succeeded, its error
    only if it failed. results(job_id, ...) has the statistics."""
    met = jobs
    if results is not None:
        met = jobs.join(results.select("job_id", F.struct(*[F.col(c).alias(k) for k, c in STATS]).alias("stats")), "job_id", "left")
    stats = F.when(F.col("status") == SUCCEEDED, F.col("stats")) if results is not None else None
    shown = [
        F.col("job_id").cast("string").alias("jobId"), "status", "filename", F.col("submitted_bytes").alias("submittedBytes"), F.col("submitted_at").alias("submittedAt"), F.col("started_at").alias("startedAt"),
        F.col("finished_at").alias("finishedAt"), result_url(F.col("status"), F.col("job_id")).alias("resultUrl"), *([stats.alias("stats")] if stats is not None else []), F.when(F.col("status") == FAILED, F.col("error")).alias("error"),
    ]
    return met.select("job_id", F.to_json(F.struct(*shown)).alias("view"))


def looked_up(requests: DataFrame, jobs: DataFrame, needs_result: bool = False) -> DataFrame:
    """requests(job_id, ...) with code: 200, 404 where there is no such job, and with needs_result 409 where it has not
    succeeded."""
    met = requests.join(jobs.select("job_id", "status"), "job_id", "left")
    late = F.lit(needs_result) & (F.col("status") != SUCCEEDED)
    return met.withColumn("code", F.when(F.col("status").isNull(), 404).when(late, 409).otherwise(200))


def keep_results(results: DataFrame, path: str) -> None:
    """Adds results(job_id, ...) to the folder, one sub-folder a job; writing a job again replaces it."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def kept_result(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """One job's result: only its sub-folder is read."""
    return spark.read.parquet(path).where(F.col("job_id") == job_id)


def discard(spark: SparkSession, path: str, job_ids: list[str]) -> None:
    """Deletes the results of some jobs, or the whole folder's if none are named."""
    for name in [f"{path}/job_id={x}" for x in job_ids] or [path]:
        storage.discard(spark, name)


def evicted(finished: Column, now: Column, retention_seconds: int) -> Column:
    """Finished strictly before now less the retention; running jobs (no finish) never."""
    return F.coalesce(finished < now - F.make_dt_interval(secs=F.lit(retention_seconds)), F.lit(False))


def to_evict(jobs: DataFrame, retention_seconds: int, finished: str = "finished_at", now: Column | None = None, clock: str | None = None) -> DataFrame:
    """The jobs whose retention is over, at `now` or else at the latest time in the column `clock`. The latest time joins as
    one row, so an empty table has none to evict."""
    if now is not None:
        return jobs.where(evicted(F.col(finished), now, retention_seconds))
    latest = jobs.agg(F.max(clock or finished).alias("latest_time"))
    return jobs.join(F.broadcast(latest), evicted(F.col(finished), F.col("latest_time"), retention_seconds)).drop("latest_time")


def admit(jobs: DataFrame, most_active: int) -> DataFrame:
    """job_id, admitted for rows (lane, job_id, start, finish) in order of start: a job is rejected while most_active
    admitted jobs of its lane are running; a rejected one takes no slot.

    Lanes are independent queues, such as services with a limit of their own; one lane is one global limit. Each lane is
    scanned in order, streamed through a task that holds most_active finish times, since every verdict follows from those
    before it.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        lane, active = None, []
        for rows in batches:
            out = []
            for own, job, start, finish in rows.itertuples(index=False):
                if own != lane:
                    lane, active = own, []
                while active and active[0] <= start:
                    heapq.heappop(active)
                if ok := len(active) < most_active:
                    heapq.heappush(active, finish)
                out.append((job, ok))
            yield pd.DataFrame(out, columns=["job_id", "admitted"])

    named = jobs.select(F.coalesce(F.col("lane").cast("string"), F.lit("")).alias("lane"), "job_id", "start", "finish")
    return named.repartition("lane").sortWithinPartitions("lane", "start", "job_id").mapInPandas(scan, "job_id long, admitted boolean")


def peak_overlap(spans: DataFrame, key: str, start: str, finish: str, buckets: int = 1024) -> DataFrame:
    """key, peak: most spans open at once, ends before starts at equal times.

    Time is cut into equal stretches over all spans. Within a stretch the marks are summed in order; what is open when a
    stretch begins is the sum of all stretches before it. So a key's marks are sorted a stretch at a time.
    """
    ends = [F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(finish).alias("t"), F.lit(-1).alias("d"))]
    marks = spans.select(key, F.explode(F.array(*ends)).alias("m")).select(F.col(key).alias("k"), "m.*").withColumn("at", F.unix_micros(F.col("t").cast("timestamp")))
    bounds = marks.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    cut = marks.crossJoin(F.broadcast(bounds))  # one row
    cut = cut.withColumn("part", F.floor((F.col("at") - F.col("first")) / ((F.col("last") - F.col("first") + 1) / F.lit(buckets))))
    inside = Window.partitionBy("k", "part").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    per = cut.withColumn("open", F.sum("d").over(inside)).groupBy("k", "part").agg(F.max("open").alias("top"), F.sum("d").alias("left"))
    before = F.coalesce(F.sum("left").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("peak", F.col("top") + before).groupBy(F.col("k").alias(key)).agg(F.max("peak").alias("peak"))

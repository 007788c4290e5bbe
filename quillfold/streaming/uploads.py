"""Files that arrive in a landing folder, compressed as jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import engine
from ..config import Settings
from ..operators import jobs
from ..storage import Kept

# Fixed value: the size above which an upload is refused.
MOST_BYTES = 100 * 2**20


def incoming(spark: SparkSession, folder: str, files_per_trigger: int = 16, glob: str = "*.pdf") -> DataFrame:
    """path, length, content, modificationTime of new files as a stream, a bounded number each time."""
    read = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return read.schema("path string, modificationTime timestamp, length long, content binary").load(folder)


@dataclass
class Service:
    """Takes files in, compresses them, and keeps results and job events in folders. A batch that is run again after a
    failure writes the same jobs over its own."""

    spark: SparkSession
    folder: str
    settings: Settings = Settings()
    most_bytes: int = MOST_BYTES

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: one job for each file, named by its path's digest. Files that are too large are refused."""
        files = batch.withColumn("job_id", F.substring(F.sha2("path", 256), 1, 32))
        fits = files.where(F.col("length") <= self.most_bytes)
        scratch = Kept(self.spark, "uploads")
        done = engine.compress(fits.select("path", "length", "content"), self.settings, kept=scratch)
        done = done.join(files.select(F.col("path").alias("request_id"), "job_id"), "request_id")
        jobs.keep_results(done.withColumn("batch", F.lit(batch_id)), f"{self.folder}/results")
        kept = self.spark.read.parquet(f"{self.folder}/results").where(F.col("batch") == batch_id) if fits.take(1) else done.withColumn("batch", F.lit(batch_id))
        named = files.select("job_id", "path", "length", "modificationTime")
        end = F.when(F.col("length") > self.most_bytes, "TooLarge").otherwise(F.substring_index("error", ":", 1))
        met = named.join(kept.select(F.col("job_id").cast("string").alias("job_id"), "error", "duration_millis"), "job_id", "left").withColumn("why", end)
        began = F.col("modificationTime")
        steps = F.array(
            F.struct(F.lit(1).alias("k"), F.lit(jobs.QUEUED).alias("status"), began.alias("ts"), F.lit(None).cast("string").alias("error")), F.struct(F.lit(2).alias("k"), F.lit(jobs.RUNNING).alias("status"), began.alias("ts"), F.lit(None).cast("string").alias("error")),
            F.struct(F.lit(3).alias("k"), F.when(F.col("why").isNull(), jobs.SUCCEEDED).otherwise(jobs.FAILED).alias("status"), (began + F.make_dt_interval(secs=F.coalesce("duration_millis", F.lit(0)) / 1000)).alias("ts"), F.col("why").alias("error")),
        )
        events = met.select("job_id", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("submitted_bytes"), F.explode(steps).alias("e"))
        events = events.select("job_id", F.col("e.k").cast("long").alias("seq"), "e.ts", "e.status", "filename", "submitted_bytes", "e.error")
        events.write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch_id}")
        scratch.discard()

    def start(self, landing: str, files_per_trigger: int = 16) -> StreamingQuery:
        """Compresses what the landing folder holds, in batches, and ends; started again it takes what has come since."""
        stream = incoming(self.spark, landing, files_per_trigger).writeStream.foreachBatch(self.take)
        return stream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def jobs(self) -> DataFrame:
        return jobs.states(self.spark.read.parquet(f"{self.folder}/events"))

    def views(self) -> DataFrame:
        """job_id and its view as JSON."""
        results = self.spark.read.parquet(f"{self.folder}/results").withColumn("job_id", F.col("job_id").cast("string"))
        return jobs.view(self.jobs(), results)

    def result(self, job_id: str) -> DataFrame:
        return jobs.kept_result(self.spark, f"{self.folder}/results", job_id)

    def close(self) -> None:
        """Deletes all that the service keeps."""
        jobs.discard(self.spark, self.folder, [])

"""The log as a stream: ingest, ids, bounded history, replay that goes on into live events, and frames for viewers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import decisions as d

# The size of a viewer's queue, of the history, and how long a connection lasts.
QUEUE, HISTORY, CONNECTION_SECONDS = 8192, 5000, 30 * 60
ENTRY = "epochMillis long, level string, logger string, thread string, requestId string, message string"
FIELDS = ("id", "epochMillis", "level", "logger", "thread", "requestId", "message")


class ViewerDropped(RuntimeError):
    """A viewer that falls too far behind is dropped; the store and other viewers go on."""


def entries(events: DataFrame) -> DataFrame:
    """The columns of ENTRY from events(timestamp millis, level, logger, thread, mdc map, message, throwable): short logger
    names, an empty request id where there is none, and a stack trace behind the message on a line of its own."""
    message = F.coalesce("message", F.lit(""))
    return events.select(
        F.col("timestamp").cast("long").alias("epochMillis"), "level", d.short_logger(F.col("logger")).alias("logger"), "thread", F.coalesce(F.element_at("mdc", "requestId"), F.lit("")).alias("requestId"),
        F.when(F.col("throwable").isNull(), message).otherwise(F.concat(message, F.lit("\n"), F.col("throwable"))).alias("message"),
    )


def as_json(columns: tuple[str, ...] = FIELDS) -> Column:
    """An entry as one JSON object, its fields in order."""
    return F.to_json(F.struct(*columns))


def frame() -> Column:
    """An entry as a server-sent event."""
    return F.concat(F.lit("id:"), F.col("id").cast("string"), F.lit("\nevent:log\ndata:"), as_json(), F.lit("\n\n"))


class LogStore:
    """Entries in a folder, each batch of a stream in a sub-folder of its own.

    Ids go up by one in order of time (equal times: of the other fields), from where the batch before ended. A batch that
    is run again after a failure finds the same end before it and writes the same rows over its own, so ids have neither
    gaps nor doubles.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def schema(self) -> str:
        return f"id long, {ENTRY}, batch long"

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. The order within a batch is one sorted task, so batches are to be bounded at the source."""
        last = self.entries().where(F.col("batch") < batch_id).agg(F.max("id")).first()[0] or 0
        named = [x.split()[0] for x in ENTRY.split(", ")]
        numbered = batch.select(*named).withColumn("id", F.row_number().over(Window.orderBy(*named)) + F.lit(last).cast("long"))
        numbered.select("id", *named).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def entries(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not there.exists(where) or not there.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/*.parquet")):
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(self.path)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in a stream of ENTRY until it is stopped, or all there is with `available` data."""
        return events.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def history(self, capacity: int = HISTORY) -> DataFrame:
        """The latest entries."""
        return self.entries().orderBy(F.desc("id")).limit(capacity)

    def follow(self, after: int = 0, files_per_trigger: int = 16) -> DataFrame:
        """A stream of the entries after an id: first those there are, then those that come, none twice and none left out.
        A query's checkpoint takes it on from where it stopped."""
        read = self.spark.readStream.schema(self.schema()).option("maxFilesPerTrigger", files_per_trigger)
        return read.parquet(self.path).where(F.col("id") > after)

    def view(self, send: Callable[[list[str]], None], checkpoint: str, after: int = 0, queue: int = QUEUE) -> StreamingQuery:
        """A viewer: every batch of frames in order of id goes to `send` on the driver. A batch beyond the queue's size, or a
        `send` that raises, ends this viewer's query and no other."""

        def deliver(batch: DataFrame, _: int) -> None:
            rows = batch.select("id", frame().alias("frame")).orderBy("id").limit(queue + 1).collect()
            if len(rows) > queue:
                raise ViewerDropped(f"more than {queue} entries behind")
            send([r.frame for r in rows])

        return self.follow(after).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_for(query: StreamingQuery, seconds: float = CONNECTION_SECONDS) -> bool:
    """Ends a query when its time is over; whether it had ended by itself. Started again on its checkpoint it goes on."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def source(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of a folder (or one file) in arrival order, a bounded number each time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a table may be one file or a folder of part files: the glob takes either
    return one.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """event_type, n: everything there is now, counted by a stream that then ends."""
    name = f"log_counts_{uuid.uuid4().hex}"
    grouped = source(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    run = grouped.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)

"""Text and storage helpers that the corpus operators share.

All word rules are ASCII rules fixed by the operators' contracts: only A-Z are lower-cased, and words are separated by
the six ASCII white-space characters (or by everything that is not a letter, a digit or above ASCII).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The alphabets and separators of the contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Rows of an Arrow batch. Texts may be long, so batches are kept small; a session that sets its own value keeps it.
BATCH_ROWS = 200
#: Most rows of ids and hashes that are broadcast: at about 60 bytes each, 30 MB. Beyond it matching() and unmatched()
#: take a filter of bounded size and shuffle what passes it.
BROADCAST_ROWS = 500_000
#: Most 64-bit words of that filter: 4 MB, for 3 million keys at a false rate of a few in a hundred.
FILTER_WORDS = 1 << 19
PROBES = 3


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives the memory that this process no longer uses back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def larger(batches: Iterator[pa.RecordBatch], column: str, least: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Batches joined until their lists in the column have `least` entries: for work whose cost is by the batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(column).flatten())
        if size >= least:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow, with release() behind each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tokens(text: Column, separator: str = SPACES) -> Column:
    """Words of a text in order; null gives an empty array."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_remove(F.split(text, separator, -1), ""), none)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only where the session has none and runs on one
    machine, as in tests; a cluster without one is an error, since a local folder would lose what others wrote."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = "/tmp/quillfold-checkpoints"
            spark.sparkContext.setCheckpointDir(where)
        else:
            where = current.rsplit("/", 1)[0]
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/quillfold-{kind}-{uuid.uuid4().hex}"


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size: for files, theirs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Scratch:
    """Tables written to the shared folder. Each is dropped when its last reader has run, the rest by close().

    Tables about `docs` are written as at most four files a core, or one for each 32 MB of docs if that is more: a small
    table dealt over many partitions doesn't become as many tiny files.
    """

    def __init__(self, docs: DataFrame):
        self.spark, self.paths = docs.sparkSession, {}
        self.files = max(4 * self.spark.sparkContext.defaultParallelism, min(1_000_000, bytes_of(docs) >> 25))

    def __call__(self, df: DataFrame, kind: str) -> DataFrame:
        """df written as Parquet and read again: lineage ends and any executor may be lost."""
        path = scratch(self.spark, kind)
        df.coalesce(self.files).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                clear(self.spark, path)

    def close(self) -> None:
        self.drop(*[t for t, _ in self.paths.values()])


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, for results that outlive their operator."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this module."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(stored: DataFrame, most_rows: int) -> DataFrame:
    """A stored table marked for broadcast if it has at most most_rows rows, else as it is (Spark then shuffles). Rows are
    counted where they are; none reaches the driver."""
    return F.broadcast(stored) if stored.count() <= most_rows else stored


def may_be_in(keys: DataFrame, key: str, value: Column) -> Column:
    """Whether value may be among keys' column `key` (long): a Bloom filter of bounded size, as one array of words that
    comes into the plan by a scalar subquery. Never false for a key; often true for others once keys outnumber its bits."""
    spark = keys.sparkSession
    n = keys.count()
    words = 64
    while words < FILTER_WORDS and words * 64 < 12 * n:
        words *= 2

    def bits(x: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(x, F.lit(k)), F.lit(words * 64)) for k in range(PROBES)]

    set_ = keys.select(F.explode(F.array(*bits(F.col(key)))).alias("bit")).select(F.shiftright("bit", 6).alias("i"), F.expr("shiftleft(1L, CAST(bit & 63 AS int))").alias("w"))
    set_ = set_.groupBy("i").agg(F.bit_or("w").alias("w"))
    every = spark.range(words).withColumnRenamed("id", "i").join(set_, "i", "left")
    dense = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("words"))
    table = dense.scalar()
    hit = F.lit(True)
    for b in bits(value):
        hit = hit & (F.call_function("bit_get", F.element_at(table, (F.shiftright(b, 6) + 1).cast("int")), (b % 64).cast("int")) == 1)
    return hit


def paired(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["_id"]) & (docs["rk"] == keys["_rk"])


def matching(docs: DataFrame, keys: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Rows of docs(doc_id, rk, ...) with the columns of the stored keys(_id, _rk, ...) of equal id and text hash."""
    if keys.count() <= (BROADCAST_ROWS if most_rows is None else most_rows):
        return docs.join(F.broadcast(keys), paired(docs, keys))
    near = docs.where(may_be_in(keys, "_rk", F.col("rk")))
    return near.join(keys, paired(near, keys))


def unmatched(docs: DataFrame, keys: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Rows of docs(doc_id, rk, ...) whose id and text hash are not in the stored keys(_id, _rk). Beyond most_rows keys,
    only rows that a filter can't clear are shuffled; the others pass where they are."""
    if keys.count() <= (BROADCAST_ROWS if most_rows is None else most_rows):
        return docs.join(F.broadcast(keys), paired(docs, keys), "left_anti")
    maybe = F.coalesce(may_be_in(keys, "_rk", F.col("rk")), F.lit(False))
    near = docs.where(maybe)
    return docs.where(~maybe).unionByName(near.join(keys, paired(near, keys), "left_anti"))


def looked_up(docs: DataFrame, keys: DataFrame, most_rows: int | None = None) -> DataFrame:
    """All rows of docs(doc_id, rk, ...), with the other columns of the stored keys(_id, _rk, ...), which names a row once;
    null where it doesn't. Beyond most_rows keys, only rows that a filter can't clear are shuffled."""
    rest = [x for x in keys.columns if x not in ("_id", "_rk")]
    if keys.count() <= (BROADCAST_ROWS if most_rows is None else most_rows):
        return docs.join(F.broadcast(keys), paired(docs, keys), "left").drop("_id", "_rk")
    maybe = F.coalesce(may_be_in(keys, "_rk", F.col("rk")), F.lit(False))
    near = docs.where(maybe)
    clear_ = docs.where(~maybe).select("*", *[F.lit(None).cast(keys.schema[x].dataType).alias(x) for x in rest])
    return clear_.unionByName(near.join(keys, paired(near, keys), "left").drop("_id", "_rk"))

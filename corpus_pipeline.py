"""From raw documents to shuffled shards of a clean, balanced training mix.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before it kept. A stage's output is written as
Parquet in the shared folder and read again as the next one's docs. All stages but the last return the columns of
`documents`; the last adds shard and slot.

A stage carries each row as one struct, so any extra columns pass unchanged, whatever their names; a column named shard or
slot that comes in gives way to the stage's own. Null and empty texts are scored like others, link with nothing, are never
contaminated, have size 0 (so the mix doesn't take them) and go into shards like other rows. Rows with equal ids are told
apart by their texts; of wholly equal rows the Jaccard stage keeps one, and to the other stages each is a row of its own.
Empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm import common, decontaminate, jaccard, mixing, sharding, toxicity
from quillfold.llm.language import held_out

SHARDS = 40


def carried(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, rk (text hash), text, source."""
    return docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("rk"), "text", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half. Learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity.score(carried(docs), model, ("row",)).where("score < 0.5").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of its smallest id (null last), then its least text hash; of equal rows one. Wordless
    texts link with nothing and all stay. The rows to drop are named, which are far fewer than those to keep."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"), keep_root=True)
    several = found.where("n_shingles > 0").groupBy("root", "doc_id", "rk").agg(F.count(F.lit(1)).alias("times"))
    several = common.stored(several, "pipeline-rows")
    best = several.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk")).alias("x"), F.sum("times").alias("n")).where("n > 1")
    families = several.join(best.select(F.col("root").alias("r"), F.col("x.doc_id").alias("best_id"), F.col("x.rk").alias("best_rk")), F.col("root") == F.col("r"))
    chosen = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("rk") == F.col("best_rk"))
    families = common.stored(families.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "times", chosen.alias("chosen")), "pipeline-families")
    # rows with equal id and text share a component, so no row is named in two families
    gone = families.where("NOT chosen OR times > 1").select("_id", "_rk")
    rows = carried(docs)
    kept = common.unmatched(rows, gone).select("row")
    again = families.where("chosen AND times > 1").select("_id", "_rk")
    if again.take(1):  # chosen texts that several rows with one id have: the least of those rows
        met = common.matching(rows, again).groupBy("doc_id", "rk")
        kept = kept.unionByName(met.agg(F.min("row").alias("row")).select("row"))
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), common.read(spark, sf_dir, "benchmark"), keep_hash=True, slop=None)
    bad = common.stored(found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk")).distinct(), "pipeline-bad")
    return common.unmatched(carried(docs), bad).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it; the last epoch of a source ends at the document nearest its target."""
    out = mixing.mix(carried(docs), whole_documents=True, payload="row")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; shards differ by one row at most."""
    out = sharding.shard(carried(docs).select("row", "text"), SHARDS, "row")
    return out.select(*[F.col("row")[x].alias(x) for x in docs.columns if x.lower() not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: The toxicity and Jaccard stages can't be written in SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

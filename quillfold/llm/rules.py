"""Quality rules with host verdicts.

Each document is measured by cheap rules; failures are counted by host (the `source`), the hosts' failure rates are
shrunk towards the corpus by an empirical beta prior, and the verdict on the host joins back to its documents. The
per-host counts are partial aggregates, so a host with a third of all rows costs one row a task.

Null or empty text has no words and fails. A null source is a host of its own. Rows are judged one by one, so repeated
rows and ids give repeated results. An empty table gives no rows. Texts are measured whole, whatever their length, and
columns besides doc_id, source and text are ignored. Equal windows of words are told by 64-bit hashes: two different
ones of a text of n words agree with a probability of about n * n / 2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

RUN = 8
#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.5


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words that lie in a window of `run` words found twice or more in the text.

    Words are hashed once, and windows from their words' hashes. Most texts have no equal windows, which a set shows.
    In the others windows are sorted with their places, so equal ones are neighbours; the places of repeated ones,
    sorted again, cover run words each, less their overlap.
    """
    def windows(h):
        starts = F.when(F.size(h) >= run, F.sequence(F.lit(0), F.size(h) - run)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(run)]))

    def twice(s):
        last = F.size(s) - 1
        def at(j):
            return F.get(s, j)["h"]
        same = F.transform(s, lambda x, j: F.when((x["h"] == at(j - 1)) | ((j < last) & (x["h"] == at(j + 1))), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-(10**6)).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(run), i - a["last"])).alias("n"), i.alias("last")))["n"]

    def count(hashes):
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(c.let(c.let(placed, twice), covered))

    return c.let(c.let(F.transform(words, lambda x: F.xxhash64(x)), windows), count).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """docs' doc_id and source with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = docs.select("doc_id", "source", text.alias("text")).select(
        "doc_id", "source", c.tokens(F.col("text")).alias("w"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        c.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    m = m.select(
        "doc_id", "source", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """source, docs, failed, rate: the failure rate of each host, shrunk by a beta prior fitted to all hosts by moments.

    The prior is two numbers. With no spread between hosts beyond chance, it weighs as much as the corpus's mean host.
    """
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("docs")
    m = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("docs") * p * p).alias("q")).first()
    if not m["k"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = m["f"] / m["n"]
    within = mean * (1 - mean)
    chance = within * m["k"] / m["n"]
    between = max(0.0, m["q"] / m["n"] - mean * mean - chance)
    strength = within / between - 1 if between > 0 and within > between else m["n"] / m["k"]
    a, b = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of docs: its measures, host_rate and kept."""
    measured = c.stored(measures(docs), "rules")
    hosts = c.stored(host_rates(measured), "rules-hosts")
    hosts = hosts.select(F.col("source").alias("host"), F.col("rate").alias("host_rate"))
    out = measured.join(c.small(hosts, 100_000), F.col("source").eqNullSafe(F.col("host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit)).drop("host")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS q FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS m FROM n) WHERE m > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed)::DOUBLE AS failed FROM b GROUP BY source),
g AS (SELECT count(*)::DOUBLE AS k, sum(docs) AS n, sum(failed) / sum(docs) AS mean, sum(failed * failed / docs) / sum(docs) AS q FROM h),
v AS (SELECT n, k, mean, mean * (1 - mean) AS within, greatest(0, q - mean * mean - mean * (1 - mean) * k / n) AS between_ FROM g),
s AS (SELECT mean, CASE WHEN between_ > 0 AND within > between_ THEN within / between_ - 1 ELSE n / k END AS strength FROM v),
z AS (SELECT source, (failed + mean * strength) / (docs + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""

"""Queries over the shared test tables.

Each is a stand-in: the operator is the engine's, the table is whatever the test data has. The oracle SQL is written
independently, by joins and CASE chains where the query uses windows and column functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings, overlaid
from ..functions import decisions as d
from ..operators import composition, dedup, fonts, graph, images, jobs, likeness, logs, metrics

S = Settings()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def canonical_documents(spark, sf, *scope):
    docs = t(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("fp"))
    return dedup.canonical(docs, "fp", "doc_id", scope)


@query("SELECT a.doc_id, (SELECT min(b.doc_id) FROM documents b WHERE sha256(b.text) = sha256(a.text)) AS canonical FROM documents a")
def dedup_canonical(spark, sf):
    return canonical_documents(spark, sf).select("doc_id", "canonical")


@query("""SELECT CAST(sum(n - 1) AS BIGINT) AS merged, CAST(sum((n - 1) * bytes) AS BIGINT) AS bytes_saved, count(*) AS kept
FROM (SELECT sha256(text) AS fp, count(*) AS n, min(strlen(text)) AS bytes FROM documents GROUP BY fp)""")
def dedup_savings(spark, sf):
    c = canonical_documents(spark, sf)
    gone = F.col("doc_id") != F.col("canonical")
    return c.agg(F.count_if(gone).alias("merged"), F.sum(F.when(gone, F.col("bytes")).otherwise(0)).alias("bytes_saved"), F.count_if(~gone).alias("kept"))


@query("""WITH f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS canonical FROM documents)
SELECT l.doc_id, canonical, quality, toxic FROM labels l JOIN f ON f.doc_id = l.doc_id""")
def dedup_repoint(spark, sf):
    return dedup.repoint(t(spark, sf, "labels"), canonical_documents(spark, sf), "doc_id").select("doc_id", "canonical", "quality", "toxic")


@query("""SELECT role, count(*) AS turns, count(DISTINCT text) AS texts FROM conversations GROUP BY role""")
def dedup_conversation_text(spark, sf):
    c = t(spark, sf, "conversations").withColumn("fp", F.sha2(F.col("text").cast("binary"), 256)).withColumn("at", F.struct("conv_id", "turn"))
    c = dedup.canonical(c, "fp", "at", ["role"])
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("at") == F.col("canonical")).alias("texts"))


@query("""SELECT a.doc_id, a.source, min(b.doc_id) AS canonical FROM documents a JOIN documents b ON a.source = b.source AND a.text = b.text GROUP BY a.doc_id, a.source""")
def dedup_scoped(spark, sf):
    return canonical_documents(spark, sf, "source").select("doc_id", "source", "canonical")


@query("""SELECT doc_id, CASE WHEN lang = 'es' THEN 'stencil' WHEN n_chars < 160 THEN 'dimension' WHEN n_chars * 4 < 1000 THEN 'bytes' WHEN source = 'src3' THEN 'cmyk' WHEN n_chars * n_chars > 100000000 THEN 'pixels' END AS skip_reason FROM documents""")
def gate_decisions(spark, sf):
    s = Settings(min_dimension=160, min_byte_size=1000, max_decode_pixels=100_000_000)
    side = F.col("n_chars")
    return t(spark, sf, "documents").select("doc_id", d.skip_reason(F.col("lang") == "es", side, side, side * 4, F.when(F.col("source") == "src3", 4).otherwise(3), F.lit(False), s).alias("skip_reason"))


SCALE_SQL = """WITH l AS (SELECT l_partkey, max(l_quantity) AS w_pt, max(l_extendedprice / 1000) AS h_pt FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey),
p AS (SELECT p_partkey, (p_size * 10 + 100)::DOUBLE AS w, (p_size * 7 + 50)::DOUBLE AS h, CASE WHEN w_pt IS NOT NULL AND h_pt IS NOT NULL THEN least(w_pt / 72.0::DOUBLE * 150 / w, h_pt / 72.0::DOUBLE * 150 / h) ELSE 1.0::DOUBLE END AS s0 FROM part LEFT JOIN l ON l_partkey = p_partkey),
q AS (SELECT p_partkey, w, h, least(s0, 300 / w, 300 / h, 1.0::DOUBLE) AS scale FROM p)
SELECT p_partkey, floor(scale * 1000000 + 0.5::DOUBLE)::BIGINT AS scale_micro, scale < 1.0::DOUBLE / 1.1::DOUBLE AS downsample, greatest(1, floor(w * scale + 0.5::DOUBLE)::BIGINT) AS target_w, greatest(1, floor(h * scale + 0.5::DOUBLE)::BIGINT) AS target_h FROM q"""


@query(SCALE_SQL)
def scale_targets(spark, sf):
    drawn = t(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.max("l_quantity").alias("w_pt"), F.max(F.col("l_extendedprice") / 1000).alias("h_pt"))
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10 + 100).alias("w"), (F.col("p_size") * 7 + 50).alias("h"))
    p = p.join(drawn, F.col("l_partkey") == F.col("p_partkey"), "left")
    p = p.withColumn("s", d.scale(F.col("w"), F.col("h"), F.col("w_pt"), F.col("h_pt"), S.target_dpi, 300))
    return p.select("p_partkey", d.half_up(F.col("s") * 1000000.0).cast("long").alias("scale_micro"), d.wants_downsample(F.col("s"), F.lit(8)).alias("downsample"), d.target_side(F.col("w"), F.col("s")).alias("target_w"), d.target_side(F.col("h"), F.col("s")).alias("target_h"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount)) <= floor(l_extendedprice) * (1.0::DOUBLE - 0.1::FLOAT::DOUBLE) AS keep_original_accepts,
 floor(l_extendedprice * (1 - l_discount)) < floor(l_extendedprice) OR floor(l_extendedprice * (1 - l_discount)) <= floor(l_extendedprice) * (1.0::DOUBLE - 0.1::FLOAT::DOUBLE) AS use_smallest_accepts FROM lineitem""")
def size_guard(spark, sf):
    orig, cand = F.floor("l_extendedprice"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", d.accept_smaller(cand, orig, S).alias("keep_original_accepts"), d.accept_smaller(cand, orig, Settings(larger_result_policy="USE_SMALLEST")).alias("use_smallest_accepts"))


@query("""WITH o AS (SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS original, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS candidate FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, candidate > original * (1.0::DOUBLE - 0.1::FLOAT::DOUBLE) AS returned_original FROM o)
SELECT l_orderkey, original, CASE WHEN returned_original THEN original ELSE candidate END AS compressed, original - CASE WHEN returned_original THEN original ELSE candidate END AS saved,
 returned_original, CASE WHEN returned_original THEN 'original' ELSE 'compressed' END AS outcome, 'dpi=150,q=0.75' AS profile FROM r""")
def document_policy(spark, sf):
    o = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice")).alias("original"), F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("candidate"))
    o = o.withColumn("returned_original", d.keeps_original(F.col("candidate"), F.col("original"), S))
    o = o.withColumn("compressed", F.when(F.col("returned_original"), F.col("original")).otherwise(F.col("candidate")))
    return o.select("l_orderkey", "original", "compressed", (F.col("original") - F.col("compressed")).alias("saved"), "returned_original", F.when(F.col("returned_original"), "original").otherwise("compressed").alias("outcome"), d.profile(F.lit(S.target_dpi), F.lit(S.jpeg_quality)).alias("profile"))


@query("""WITH g AS (SELECT l_orderkey, l_quantity < 5 AS skipped, l_quantity >= 30 AS down, floor(l_extendedprice * (1 - l_discount)) <= floor(l_extendedprice) * (1.0::DOUBLE - 0.1::FLOAT::DOUBLE) AS smaller FROM lineitem)
SELECT l_orderkey, count(*) FILTER (NOT skipped) AS images_inspected, count(*) FILTER (NOT skipped AND smaller AND down) AS images_downsampled, count(*) FILTER (NOT skipped AND smaller) AS images_recompressed, count(*) FILTER (skipped OR NOT smaller) AS images_unchanged FROM g GROUP BY l_orderkey""")
def run_stats(spark, sf):
    orig, cand = F.floor("l_extendedprice"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    kind = F.when(F.col("l_quantity") < 5, "skipped").when(d.accept_smaller(cand, orig, S), "recompressed").otherwise("unchanged")
    found = t(spark, sf, "lineitem").select("l_orderkey", kind.alias("outcome"), (F.col("l_quantity") >= 30).alias("downsample"))
    return images.counters(found, ("l_orderkey",))


@query("""SELECT l_partkey, CAST(max(CAST(sqrt(l_quantity * l_quantity + l_tax * l_tax) AS FLOAT)) * 100 + 0.5 AS BIGINT) AS w_centi, CAST(floor(max(CAST(l_extendedprice AS FLOAT))::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) AS h_centi FROM lineitem GROUP BY l_partkey""".replace("CAST(max(CAST(sqrt", "CAST(floor(max(CAST(sqrt").replace("AS FLOAT)) * 100 + 0.5 AS BIGINT)", "AS FLOAT))::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT)"))
def max_extent(spark, sf):
    e = t(spark, sf, "lineitem").select(F.lit("").alias("path"), F.col("l_partkey").alias("image_id"), F.col("l_quantity").alias("scale_x"), F.col("l_tax").alias("shear_y"), F.lit(0.0).alias("shear_x"), F.col("l_extendedprice").alias("scale_y"))
    e = images.extents(e)
    return e.select(F.col("image_id").alias("l_partkey"), d.half_up(F.col("w_pt").cast("double") * 100.0).cast("long").alias("w_centi"), d.half_up(F.col("h_pt").cast("double") * 100.0).cast("long").alias("h_centi"))


COMPOSITION = """WITH c AS (SELECT CASE WHEN lang = 'en' THEN 'fonts' WHEN source = 'src1' THEN 'vectors' WHEN n_chars > 4000 THEN 'images' ELSE 'other' END AS category, strlen(text) AS size FROM documents)"""


@query(COMPOSITION + """ SELECT category, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS items, floor(sum(size) * 10000.0::DOUBLE / (SELECT sum(size) FROM c) + 0.5::DOUBLE) / 100.0::DOUBLE AS percent FROM c GROUP BY category""")
def composition_bytes(spark, sf):
    c = t(spark, sf, "documents").select(d.stream_category(F.col("lang") == "en", F.col("source") == "src1", F.when(F.col("n_chars") > 4000, "Image"), F.lit(False)).alias("category"), F.octet_length("text").cast("long").alias("size"))
    return composition.by_category(c, "category", F.col("size"))


TOTALS = COMPOSITION.replace("SELECT CASE", "SELECT source, n_chars, CASE") + """, z AS (SELECT source, sum(size) AS total, sum(CASE WHEN category = 'images' THEN size ELSE 0 END) AS images, sum(CASE WHEN category = 'fonts' THEN size ELSE 0 END) AS fonts,
 sum(CASE WHEN category = 'vectors' THEN size ELSE 0 END) AS vectors, sum(CASE WHEN category = 'other' THEN size ELSE 0 END) AS other, count(*) FILTER (category = 'fonts') AS n, count(*) FILTER (category = 'fonts' AND n_chars > 15000) AS m,
 sum(CASE WHEN category = 'fonts' AND n_chars > 15000 THEN size ELSE 0 END) AS sub FROM c GROUP BY source),
r AS (SELECT *, CAST(floor(images * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS ip, CAST(floor((fonts + vectors) * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS ap, CAST(floor(sub * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS sp FROM z)"""
NOTE_SQL = """CASE WHEN total = 0 THEN 'No stored streams found.' WHEN sub > 0 THEN 'Font subsetting could target ~' || sp || '% of stream bytes (' || sub || ' bytes of embedded TrueType fonts are not yet subset).'
 WHEN ip >= 80 THEN 'Images are ' || ip || '% of stream bytes; image optimization is where the savings are, vector/font optimization would move only ~' || ap || '%.'
 WHEN ap >= 40 THEN 'Fonts and vector/text content are ' || ap || '% of stream bytes, but the embedded fonts are already subset, so a font pass would not help much.' ELSE 'Images ' || ip || '%, fonts+vectors ' || ap || '% of stream bytes.' END"""


def source_composition(spark, sf):
    kind = d.stream_category(F.col("lang") == "en", F.col("source") == "src1", F.when(F.col("n_chars") > 4000, "Image"), F.lit(False))
    docs = t(spark, sf, "documents").select("source", "n_chars", kind.alias("category"), F.octet_length("text").cast("long").alias("size"))
    programs = docs.where("category = 'fonts'").select("source", F.when(F.col("n_chars") > 15000, "Serif").otherwise("ABCDEF+Serif").alias("name"), F.lit("TrueType").alias("program"), F.col("size").alias("font_bytes"))
    return composition.totals(docs, programs, ["source"])


@query(TOTALS + " SELECT source, CAST(total AS BIGINT) AS total_bytes, CAST(images AS BIGINT) AS images_bytes, CAST(fonts + vectors AS BIGINT) AS addressable_bytes, n AS embedded_fonts, m AS subsettable_fonts, CAST(sub AS BIGINT) AS subsettable_bytes, floor((fonts + vectors) * 10000.0::DOUBLE / total + 0.5::DOUBLE) / 100.0::DOUBLE AS addressable_percent FROM r")
def composition_totals(spark, sf):
    return source_composition(spark, sf).select("source", "total_bytes", "images_bytes", "addressable_bytes", "embedded_fonts", "subsettable_fonts", "subsettable_bytes", "addressable_percent")


@query(TOTALS + " SELECT source, " + NOTE_SQL + " AS note FROM r")
def composition_note(spark, sf):
    return source_composition(spark, sf).select("source", "note")


NOTE_CASES = "SELECT o_orderkey, 1000 AS total, o_orderkey % 1001 AS images, (o_orderkey * 7) % (1001 - o_orderkey % 1001) AS addr, CASE WHEN o_orderkey % 11 = 0 THEN 1 + o_orderkey % 97 ELSE 0 END AS sub FROM orders"


@query(f"WITH z AS ({NOTE_CASES}), r AS (SELECT *, CAST(floor(images * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS ip, CAST(floor(addr * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS ap, CAST(floor(sub * 100.0::DOUBLE / total + 0.5::DOUBLE) AS BIGINT) AS sp FROM z) SELECT o_orderkey, {NOTE_SQL} AS note FROM r")
def note_bounds(spark, sf):
    """Shares in steps of a tenth of a percent, on both sides of every bound."""
    t(spark, sf, "orders").createOrReplaceTempView("orders")
    z = spark.sql(NOTE_CASES)
    return z.select("o_orderkey", d.note(F.col("total"), F.col("images"), F.col("addr"), F.col("sub")).alias("note"))


@query("""WITH p AS (SELECT page_id, strlen(html) AS total, strlen(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_bytes FROM pages)
SELECT CASE WHEN total = 0 THEN 'empty' WHEN text_bytes * 2 >= total THEN 'text' ELSE 'markup' END AS category, CAST(sum(total) AS BIGINT) AS bytes, CAST(sum(text_bytes) AS BIGINT) AS text_bytes, count(*) AS items FROM p GROUP BY category""")
def html_composition(spark, sf):
    p = t(spark, sf, "pages").select(F.octet_length("html").cast("long").alias("total"), F.octet_length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_bytes"))
    kind = F.when(F.col("total") == 0, "empty").when(F.col("text_bytes") * 2 >= F.col("total"), "text").otherwise("markup")
    return p.groupBy(kind.alias("category")).agg(F.sum("total").alias("bytes"), F.sum("text_bytes").alias("text_bytes"), F.count(F.lit(1)).alias("items"))


@query("SELECT p_partkey, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) = 1 AS owned_once FROM part")
def refcount_one(spark, sf):
    n = fonts.reference_counts(t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_suppkey", ())
    return fonts.owned_once(t(spark, sf, "part").select("p_partkey"), n, ["p_partkey"])


@query("SELECT l_suppkey, bool_and(p_partkey IS NOT NULL) AS covered, count(*) FILTER (p_partkey IS NULL) AS missing FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY l_suppkey")
def glyph_coverage(spark, sf):
    used = t(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return fonts.coverage(used, t(spark, sf, "part").where("p_size <= 45").select("p_partkey"), "l_suppkey", "p_partkey")


@query("SELECT l_suppkey, count(*) AS codes, count(*) FILTER (p_size % 25 = s_nationkey) AS agreeing, bool_and(p_size % 25 = s_nationkey) AS all_agree FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey")
def code_agreement(spark, sf):
    used = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    j = used.join(t(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return fonts.agreement(j, "l_suppkey", F.col("p_size") % 25 == F.col("s_nationkey"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS used, max(l_partkey) AS max_cid FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def usage_sets(spark, sf):
    g = t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("cid"), F.col("l_partkey").alias("gid"), F.col("l_suppkey").alias("code"), F.col("l_linenumber").alias("seq"))
    return fonts.usage(g, ["l_orderkey"]).select("l_orderkey", F.array_join("gids", ",").alias("used"), "max_cid")


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS gid FROM lineitem GROUP BY l_partkey")
def last_wins_map(spark, sf):
    g = t(spark, sf, "lineitem").select(F.lit(0).alias("font"), F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("gid"), F.lit(0).alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return fonts.usage(g, ["font"]).select(F.explode("cid_to_gid").alias("x")).select(F.col("x.cid").alias("l_partkey"), F.col("x.gid").alias("gid"))


@query("SELECT s_suppkey, chr(65 + (i // 11881376) % 26) || chr(65 + (i // 456976) % 26) || chr(65 + (i // 17576) % 26) || chr(65 + (i // 676) % 26) || chr(65 + (i // 26) % 26) || chr(65 + i % 26) AS tag FROM (SELECT s_suppkey, CAST((SELECT count(*) FROM supplier b WHERE b.s_suppkey < a.s_suppkey AND b.s_nationkey = a.s_nationkey) AS INTEGER) AS i FROM supplier a)")
def subset_tag(spark, sf):
    return fonts.tagged(t(spark, sf, "supplier"), ["s_nationkey"], ["s_suppkey"]).select("s_suppkey", "tag")


@query("SELECT user_id, count(DISTINCT CAST(floor(value) AS BIGINT)) > 8 AS photographic FROM events GROUP BY user_id")
def distinct_capped(spark, sf):
    return metrics.capped_distinct(t(spark, sf, "events"), "user_id", F.floor("value"), 8, "photographic")


@query("SELECT event_type AS outcome, count(*) AS requests, CAST(sum(greatest(0, CAST(floor(value * 100) AS BIGINT))) AS BIGINT) AS value_centi, CAST(max(greatest(0, floor(value * 100))) AS BIGINT) AS max_centi, CAST(floor(avg(greatest(0, CAST(floor(value * 100) AS BIGINT))) + 0.5::DOUBLE) AS BIGINT) AS mean_centi FROM events GROUP BY event_type")
def metrics_by_tag(spark, sf):
    m = metrics.tagged(t(spark, sf, "events"), "event_type", F.floor(F.col("value") * 100))
    return m.select(F.col("event_type").alias("outcome"), "requests", F.col("total").cast("long").alias("value_centi"), F.col("most").cast("long").alias("max_centi"), d.half_up(F.col("mean")).cast("long").alias("mean_centi"))


@query("""SELECT 'inspected' AS action, count(*) FILTER (l_quantity >= 5) AS images FROM lineitem UNION ALL SELECT 'downsampled', count(*) FILTER (l_quantity >= 30) FROM lineitem UNION ALL SELECT 'unchanged', count(*) FILTER (l_quantity < 5) FROM lineitem""")
def metrics_actions(spark, sf):
    q = F.col("l_quantity")
    return metrics.actions(t(spark, sf, "lineitem"), inspected=(q >= 5).cast("int"), downsampled=(q >= 30).cast("int"), unchanged=(q < 5).cast("int"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 72 + CAST(c_custkey % 300 AS INTEGER) ELSE 150 END AS target_dpi, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 1000 AS INTEGER) ELSE 0 END AS max_image_dimension,
 CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 4)::DOUBLE / 4.0::DOUBLE ELSE 0.75::DOUBLE END AS jpeg_quality, c_custkey % 11 = 0 AS strip_metadata, coalesce(CASE WHEN c_custkey % 13 = 0 THEN c_custkey % 2 = 0 END, true) AS deduplicate_images FROM customer""")
def option_overlay(spark, sf):
    k = F.col("c_custkey")
    given = {"target_dpi": F.when(k % 3 == 0, (72 + k % 300).cast("int")), "max_image_dimension": F.when(k % 5 == 0, (k % 1000).cast("int")), "jpeg_quality": F.when(k % 7 == 0, (k % 4) / 4.0), "strip_metadata": F.when(k % 11 == 0, F.lit(True)), "deduplicate_images": F.when(k % 13 == 0, k % 2 == 0)}
    return t(spark, sf, "customer").select("c_custkey", *[overlaid(name, column, S).alias(name) for name, column in given.items()])


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def ring_buffer(spark, sf):
    return logs.ring(t(spark, sf, "events"), 500, "event_id").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 700")
def history_after(spark, sf):
    return logs.history_after(t(spark, sf, "events"), 700, "event_id").select("event_id", "event_type")


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '  ' || CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE 'x' || CAST(event_id AS VARCHAR) END AS BIGINT), 0) AS resume FROM events")
def resume_offset(spark, sf):
    k = F.col("event_id")
    header = F.when(k % 3 == 0, F.concat(F.lit("  "), k.cast("string"))).when(k % 3 == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise("  ")
    return t(spark, sf, "events").select("event_id", d.resume_offset(header, F.col("user_id").cast("string")).alias("resume"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND contains(lower(event_type || ' ' || props), 'lic')")
def log_filter(spark, sf):
    return t(spark, sf, "events").where(logs.visible(F.col("event_type"), ("click", "view", "purchase"), "LIC", F.col("event_type"), F.col("props"))).select("event_id")


@query("""SELECT event_id, '{"id":' || event_id || ',"level":"' || event_type || '","thread":"u' || user_id || '"' || CASE WHEN user_id % 2 = 0 THEN ',"requestId":"' || user_id || '"' ELSE '' END || '}' AS json FROM events""")
def log_json(spark, sf):
    u = F.col("user_id").cast("string")
    return t(spark, sf, "events").select("event_id", logs.as_json(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.concat(F.lit("u"), u).alias("thread"), F.when(F.col("user_id") % 2 == 0, u).alias("requestId")).alias("json"))


ORDER_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'QUEUED' ELSE 'FAILED' END"
JOB_SQL = f"""WITH j AS (SELECT o_orderkey, {ORDER_STATUS} AS s0, CASE WHEN o_orderkey % 17 = 0 THEN 'FAILED' ELSE {ORDER_STATUS} END AS status, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"""


def order_jobs(spark, sf):
    """Orders as jobs: their letter stands for a state, and some have failed."""
    state = F.expr(ORDER_STATUS)
    state = F.when(F.col("o_orderkey") % 17 == 0, "FAILED").otherwise(state)
    none = F.lit(None).cast("timestamp")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("status"), F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"), F.floor("o_totalprice").cast("long").alias("submitted_bytes"),
                                         none.alias("submitted_at"), none.alias("started_at"), none.alias("finished_at"), F.lit("InvalidPdf").alias("error"), "o_custkey")


@query(JOB_SQL + """ SELECT o_orderkey, '{"jobId":"' || o_orderkey || '","status":"' || status || '","filename":"f' || o_custkey || '.pdf","submittedBytes":' || size
 || CASE WHEN status = 'SUCCEEDED' THEN ',"resultUrl":"/jobs/' || o_orderkey || '/result","stats":{"originalBytes":' || size || ',"compressedBytes":' || size // 2 || ',"savedBytes":' || (size - size // 2) || ',"pageCount":1,"returnedOriginal":false}' ELSE '' END
 || CASE WHEN status = 'FAILED' THEN ',"error":"InvalidPdf"' ELSE '' END || '}' AS view FROM j JOIN (SELECT o_orderkey AS k, o_custkey FROM orders) ON k = o_orderkey""")
def job_view(spark, sf):
    j = order_jobs(spark, sf)
    size, none = F.col("submitted_bytes"), F.lit(None).cast("int")
    r = j.select("job_id", size.alias("original_bytes"), F.floor(size / 2).cast("long").alias("compressed_bytes"), (size - F.floor(size / 2)).cast("long").alias("saved_bytes"), F.lit(None).cast("double").alias("saved_percent"), F.lit(1).alias("page_count"),
                 none.alias("images_inspected"), none.alias("images_recompressed"), none.alias("duration_millis"), F.lit(False).alias("returned_original"))
    return jobs.view(j, r).withColumnRenamed("job_id", "o_orderkey")


@query(JOB_SQL + " SELECT l_orderkey, l_linenumber, CASE WHEN status IS NULL THEN 404 WHEN status <> 'SUCCEEDED' THEN 409 ELSE 200 END AS code FROM (SELECT l_orderkey, l_linenumber, l_orderkey + CASE WHEN l_linenumber > 5 THEN 100000000 ELSE 0 END AS wanted FROM lineitem) LEFT JOIN j ON wanted = o_orderkey")
def job_lookup(spark, sf):
    asked = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.when(F.col("l_linenumber") > 5, 100000000).otherwise(0)).alias("job_id"))
    return jobs.looked_up(asked, order_jobs(spark, sf), needs_result=True).select("l_orderkey", "l_linenumber", "code")


EVENT_JOBS = "SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN event_id % 2 = 0 THEN 'Odd' END AS error FROM events"


@query(f"""WITH e AS ({EVENT_JOBS}), f AS (SELECT job_id, min(seq) AS stop FROM e WHERE status IN ('SUCCEEDED', 'FAILED') GROUP BY job_id), a AS (SELECT e.job_id, e.status, e.error, e.seq FROM e JOIN f ON e.job_id = f.job_id AND seq = stop),
r AS (SELECT job_id, min(seq) AS run FROM e WHERE status = 'RUNNING' GROUP BY job_id)
SELECT j.job_id, CASE WHEN a.status IS NOT NULL THEN a.status WHEN run IS NOT NULL THEN 'RUNNING' ELSE 'QUEUED' END AS status, CASE WHEN a.status = 'FAILED' THEN a.error END AS error, coalesce(run < a.seq OR (run IS NOT NULL AND a.seq IS NULL), false) AS started
FROM (SELECT DISTINCT job_id FROM e) j LEFT JOIN a ON a.job_id = j.job_id LEFT JOIN r ON r.job_id = j.job_id""")
def job_states(spark, sf):
    t(spark, sf, "events").createOrReplaceTempView("events")
    e = spark.sql(EVENT_JOBS).withColumn("filename", F.lit(None).cast("string")).withColumn("submitted_bytes", F.lit(None).cast("long"))
    return jobs.states(e).select("job_id", "status", "error", F.col("started_at").isNotNull().alias("started"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE event_type <> 'view' AND ts < now - INTERVAL 3600 SECOND""")
def job_evict(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("finished_at", F.when(F.col("event_type") != "view", F.col("ts")))
    return jobs.to_evict(e, S.retention_seconds, clock="ts").select("event_id")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 422 WHEN 1 THEN 400 WHEN 2 THEN 409 WHEN 3 THEN 500 END AS status FROM events""")
def error_status(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("InvalidPdf", "InvalidOption", "JobNotReady", "Whatever", "AsyncEnded")])
    return t(spark, sf, "events").select("event_id", d.error_status(F.get(kinds, (F.col("event_id") % 5).cast("int"))).alias("status"))


@query("""WITH m AS (SELECT event_type, ts AS ats, 1 AS d FROM events UNION ALL SELECT event_type, ts + INTERVAL 600 SECOND, -1 FROM events)
SELECT event_type, max(o) AS peak FROM (SELECT event_type, CAST(sum(d) OVER (PARTITION BY event_type ORDER BY ats, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS o FROM m) GROUP BY event_type""")
def peak_in_flight(spark, sf):
    e = t(spark, sf, "events").select("event_type", F.col("ts").alias("a"), F.expr("ts + INTERVAL 600 SECOND").alias("b"))
    return jobs.peak_overlap(e, "event_type", "a", "b")


@query("""WITH RECURSIVE o AS (SELECT event_type AS lane, event_id AS job_id, epoch_us(ts) AS start, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT lane, CAST(0 AS BIGINT) AS rn, []::BIGINT[] AS active, CAST(NULL AS BIGINT) AS job_id, CAST(NULL AS BOOLEAN) AS admitted FROM (SELECT DISTINCT lane FROM o) UNION ALL
 SELECT lane, rn, CASE WHEN len(f) < 2 THEN list_append(f, start + 600000000) ELSE f END, job_id, len(f) < 2 FROM (SELECT o.lane, o.rn, o.start, o.job_id, list_filter(s.active, lambda x: x > o.start) AS f FROM s JOIN o ON o.lane = s.lane AND o.rn = s.rn + 1))
SELECT job_id, admitted FROM s WHERE rn > 0""")
def job_admission(spark, sf):
    """Rejected arrivals take no slot. One lane an event type."""
    e = t(spark, sf, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return jobs.admit(e.withColumn("finish", F.col("start") + 600_000_000), 2)


EDGES_SQL = """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || c_custkey, 'r' || (c_nationkey % 2) FROM customer WHERE c_custkey % 50 = 0),
x AS (SELECT 'r0' AS node UNION SELECT dst FROM x JOIN e ON src = node) SELECT node FROM x"""


@query(EDGES_SQL)
def reachable(spark, sf):
    def name(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))
    n = t(spark, sf, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    c = t(spark, sf, "customer")
    down = c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    back = c.where("c_custkey % 50 = 0").select(name("c", "c_custkey").alias("src"), F.concat(F.lit("r"), (F.col("c_nationkey") % 2).cast("string")).alias("dst"))
    return graph.reachable(n.unionByName(down).unionByName(back), spark.sql("SELECT 'r0' AS node"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'fonts' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 'vectors' WHEN o_orderpriority LIKE '1%' THEN 'images' ELSE 'other' END AS category FROM orders""")
def semi_flags(spark, sf):
    line = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "Image").alias("subtype"), F.lit(False).alias("pattern"))
    return composition.categorised(o, line.where("l_returnflag = 'R'"), line.where("l_quantity > 49"), ["o_orderkey"]).select("o_orderkey", "category")


@query("""WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings),
m AS (SELECT p.pair, p.pos // 8 AS block, avg(p.x) AS ma, avg(q.x) AS mb, var_samp(p.x) AS va, var_samp(q.x) AS vb, covar_samp(p.x, q.x) AS cab FROM v p JOIN v q ON p.pair = q.pair AND p.pos = q.pos AND p.side = 0 AND q.side = 1 GROUP BY p.pair, p.pos // 8)
SELECT CAST(pair AS BIGINT) AS pair, CAST(floor(avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * cab + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE))) * 10000 + 0.5::DOUBLE) AS BIGINT) AS likeness FROM m GROUP BY pair""")
def block_similarity(spark, sf):
    """Neighbouring vectors, whole, in blocks of 8 components."""
    e = t(spark, sf, "embeddings")
    half = lambda k: e.where(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").alias(f"e{k}"))
    return likeness.blocks(half(0).join(half(1), "pair"), "pair", "e0", "e1", 8).select("pair", d.half_up(F.col("likeness") * 10000.0).cast("long").alias("likeness"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_log_counts(spark, sf):
    from ..streaming import logs as streams

    return streams.counts(spark, f"{sf}/events.parquet")

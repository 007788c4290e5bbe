"""Stand-in queries for rules that one table's columns can show: images, fonts, results, metrics and log entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import engine
from ..functions import decisions as d
from ..operators import fonts, images, metrics, profiles
from ..streaming import logs as streams
from .standins import S, query, t

# images --------------------------------------------------------------------------------------------------------------

PLAN = """WITH l AS (SELECT l_partkey, max(l_quantity) AS w_pt, max(l_extendedprice / 1000) AS h_pt FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 8 END AS bpc, p_size * 40 + 10 AS w, p_size * 30 + 5 AS h, p_partkey * 97 % 30000 AS len, w_pt, h_pt FROM part LEFT JOIN l ON l_partkey = p_partkey),
q AS (SELECT *, CASE WHEN w_pt > 0 AND h_pt > 0 THEN least(w_pt / 72.0::DOUBLE * 150 / w, h_pt / 72.0::DOUBLE * 150 / h, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS scale FROM p),
r AS (SELECT *, CASE WHEN w < 16 OR h < 16 THEN 'dimension' WHEN len < 8192 THEN 'bytes' END AS skip_reason, CASE WHEN bpc = 1 THEN scale < 0.5::DOUBLE ELSE scale < 1.0::DOUBLE / 1.1::DOUBLE END AS downsample FROM q)"""


@query(PLAN + """ SELECT p_partkey, skip_reason, downsample, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN bpc = 1 AND NOT downsample THEN 'kept' ELSE 'pending' END AS action,
 CASE WHEN downsample THEN greatest(1, CAST(floor(w * scale + 0.5::DOUBLE) AS BIGINT)) ELSE w END AS target_w FROM r""")
def image_plan(spark, sf):
    """Gates, scale and targets of images with one and with eight bits a pixel, some never drawn."""
    drawn = t(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("image_id")).agg(F.max("l_quantity").alias("w_pt"), F.max(F.col("l_extendedprice") / 1000).alias("h_pt"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(8).alias("bpc"), (F.col("p_size") * 40 + 10).cast("int").alias("w"), (F.col("p_size") * 30 + 5).cast("int").alias("h"),
                                    (F.col("p_partkey") * 97 % 30000).alias("encoded_len"), F.lit(False).alias("stencil"), F.lit(3).alias("components"), F.lit("DeviceRGB").alias("color_space"))
    out = images.planned(p, drawn, S, S.target_dpi, S.max_image_dimension, ("image_id",))
    return out.select(F.col("image_id").alias("p_partkey"), "skip_reason", "downsample", "action", "target_w")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'BITONAL' WHEN p_brand LIKE '%3' THEN 'TRANSPARENT' WHEN p_size > 30 THEN 'GRAYSCALE' ELSE 'COLOR' END AS codec FROM part")
def codec_class(spark, sf):
    size = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", d.codec(F.when(size % 5 == 0, 1).otherwise(8), F.col("p_brand").endswith("3"), size > 30).alias("codec"))


IMAGE_ROWS = "SELECT user_id AS path, event_id AS image_id, event_id AS discovery_idx, event_id % 2 AS w, 1 AS h, 8 AS bpc, event_type AS color_space, 'F' AS filters, concat('', CAST(floor(value / 40) AS BIGINT)) AS content, CASE WHEN event_id % 4 = 0 THEN 'm' END AS mask FROM events"


@query(f"WITH x AS ({IMAGE_ROWS}) SELECT a.path, a.image_id, min(b.image_id) AS canonical FROM x a JOIN x b ON a.path = b.path AND a.w = b.w AND a.h = b.h AND a.color_space = b.color_space AND a.filters = b.filters AND a.content = b.content AND a.mask IS NOT DISTINCT FROM b.mask GROUP BY a.path, a.image_id HAVING min(b.image_id) < a.image_id")
def image_dedup(spark, sf):
    """Equal images of a document: shape, colours, filters, bytes and mask."""
    t(spark, sf, "events").createOrReplaceTempView("events")
    x = spark.sql(IMAGE_ROWS).withColumn("content", F.col("content").cast("binary")).withColumn("mask", F.col("mask").cast("binary"))
    return images.merged(images.fingerprinted(x))


@query(f"WITH x AS ({IMAGE_ROWS}) SELECT count(*) AS merged FROM (SELECT path, row_number() OVER (PARTITION BY path, w, h, color_space, filters, content, mask ORDER BY image_id) AS n FROM x) WHERE n > 1")
def image_merged_count(spark, sf):
    return image_dedup(spark, sf).agg(F.count(F.lit(1)).alias("merged"))


@query("SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS discovery_idx, CAST(count(*) AS INTEGER) AS n_refs, string_agg('o' || l_orderkey, ',' ORDER BY l_orderkey * 10 + l_linenumber) AS names FROM lineitem GROUP BY l_partkey")
def image_references(spark, sf):
    """All places that name an image, in order of discovery."""
    n = t(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_idx"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"))
    return images.references(n, ("l_partkey",)).select("l_partkey", "discovery_idx", "n_refs", F.array_join("names", ",").alias("names"))


@query("""WITH c AS (SELECT conv_id AS path, turn AS i, text, length(role) AS n FROM conversations), m AS (SELECT a.path, a.i, min(b.i) AS first, any_value(strlen(a.text)) AS size FROM c a JOIN c b ON a.path = b.path AND a.text = b.text AND a.n = b.n GROUP BY a.path, a.i)
SELECT path AS conv_id, count(*) AS profiles_merged, CAST(sum(size) AS BIGINT) AS bytes_saved FROM m WHERE first < i GROUP BY path""")
def profile_dedup(spark, sf):
    """A conversation's turns as its profiles; the role's length stands for the number of components."""
    p = t(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("array_idx"), F.col("turn").cast("int").alias("stream_id"), F.length("role").alias("components"), F.col("text").cast("binary").alias("content"))
    return profiles.saved(profiles.merged(p, "conv_id"), "conv_id")


# fonts ---------------------------------------------------------------------------------------------------------------

FONT = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_partkey END AS f2, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS f3, CASE WHEN p_size > 10 THEN p_partkey END AS f1, CASE p_partkey % 4 WHEN 0 THEN 'ABCDEF+' || p_brand WHEN 1 THEN 'ABCDEf+' || p_brand WHEN 2 THEN p_brand END AS name FROM part"


@query(f"WITH f AS ({FONT}), g AS (SELECT *, CASE WHEN f2 IS NOT NULL THEN 'TrueType' WHEN f3 IS NOT NULL THEN 'CFF' WHEN f1 IS NOT NULL THEN 'Type1' END AS program, coalesce(name, '(unnamed)') AS shown FROM f) SELECT p_partkey, program, shown, shown SIMILAR TO '[A-Z]{{6}}\\+.+' AS already_subset, coalesce(program = 'TrueType', false) AND NOT (shown SIMILAR TO '[A-Z]{{6}}\\+.+') AS subsettable FROM g")
def font_programs(spark, sf):
    t(spark, sf, "part").createOrReplaceTempView("part")
    f = spark.sql(FONT).withColumn("program", d.font_program(F.col("f2"), F.col("f3"), F.col("f1")))
    return f.select("p_partkey", "program", d.font_name(F.col("name")).alias("shown"), d.is_tagged(F.col("name")).alias("already_subset"), d.subsettable(F.col("program"), F.col("name")).alias("subsettable"))


GUARD = "SELECT l_orderkey, l_linenumber, l_suppkey % 7 <> 0 AS owned_once, CASE WHEN l_partkey % 9 <> 0 THEN 'F' END AS base_name, CAST(floor(l_quantity) AS INTEGER) % 4 AS n_glyphs, CASE WHEN l_tax > 0.07 THEN 'broken' END AS error, l_discount < 0.09 AS survived, CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS subset_len, CAST(floor(l_extendedprice) AS BIGINT) - 1000 AS compare_len FROM lineitem"


@query(f"WITH g AS ({GUARD}) SELECT l_orderkey, l_linenumber, CASE WHEN NOT owned_once THEN 'shared' WHEN base_name IS NULL THEN 'unnamed' WHEN n_glyphs < 1 THEN 'unused' WHEN error IS NOT NULL THEN error WHEN NOT survived THEN 'lost' WHEN subset_len >= compare_len THEN 'larger' END AS refusal FROM g")
def font_guards(spark, sf):
    t(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    g = spark.sql(GUARD)
    return g.select("l_orderkey", "l_linenumber", fonts.refusal(g).alias("refusal"))


@query(f"WITH g AS ({GUARD}) SELECT l_orderkey, CAST(count(*) FILTER (ok) AS INTEGER) AS fonts_subset, CAST(coalesce(sum(compare_len - subset_len) FILTER (ok), 0) AS BIGINT) AS font_bytes_saved FROM (SELECT *, owned_once AND base_name IS NOT NULL AND n_glyphs >= 1 AND error IS NULL AND survived AND subset_len < compare_len AS ok FROM g) GROUP BY l_orderkey")
def font_savings(spark, sf):
    t(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    g = spark.sql(GUARD)
    return fonts.saved(g.withColumn("refusal", fonts.refusal(g)), ["l_orderkey"])


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND (p_partkey % 2 = 0 OR (p_partkey % 5 = 0 AND p_size % 2 = 0 AND p_size <= 40))")
def font_eligible(spark, sf):
    """TrueType programs of composite fonts, or of simple ones that are embedded and not symbolic."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "composite").when(F.col("p_partkey") % 5 == 0, "simple").otherwise("other")
    f = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "TrueType").otherwise("CFF").alias("program"), kind.alias("kind"), (F.col("p_size") % 2 == 0).alias("embedded"), (F.col("p_size") > 40).alias("symbolic"))
    return fonts.eligible(f).select("p_partkey")


# results, metrics, log -----------------------------------------------------------------------------------------------

RESULTS = "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS original, CAST(floor(o_totalprice * (o_orderkey % 13) / 11) AS BIGINT) AS candidate, CAST(o_custkey % 5 AS INTEGER) AS pages FROM orders"


def order_results(spark, sf):
    """Orders as compressed documents, through the engine's own projection."""
    t(spark, sf, "orders").createOrReplaceTempView("orders")
    x = spark.sql(RESULTS)
    body = lambda c: F.expr(f"CAST(repeat('x', CAST({c} % 1000 AS int)) AS binary)")
    no = F.lit(None).cast("int")
    stats = x.select(F.col("o_orderkey").cast("string").alias("path"), body("candidate").alias("candidate"), body("original").alias("content"), (F.col("original") % 1000).alias("original_bytes"), "pages", no.alias("images_inspected"), no.alias("images_downsampled"),
                     no.alias("images_recompressed"), no.alias("images_unchanged"), no.alias("fonts_subset"), F.lit(S.target_dpi).alias("target_dpi"), F.lit(S.jpeg_quality).alias("jpeg_quality"), F.lit(7).cast("long").alias("millis"), F.lit(None).cast("string").alias("error"))
    return engine.results(stats, S)


RESULT_SQL = f"""WITH x AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, original % 1000 AS o, candidate % 1000 AS c, pages FROM ({RESULTS})),
r AS (SELECT *, c > o * (1.0::DOUBLE - 0.1::FLOAT::DOUBLE) AS back FROM x), y AS (SELECT *, CASE WHEN back THEN o ELSE c END AS z FROM r)"""


@query(RESULT_SQL + " SELECT request_id, o AS original_bytes, z AS compressed_bytes, o - z AS saved_bytes, CAST(floor(CASE WHEN o = 0 THEN 0.0::DOUBLE ELSE (o - z) * 100.0::DOUBLE / o END * 1000 + 0.5::DOUBLE) AS BIGINT) AS saved_milli, back AS returned_original, strlen(repeat('x', CAST(z AS INTEGER))) AS sent FROM y")
def result_rows(spark, sf):
    """Chosen bytes and savings, with empty documents."""
    r = order_results(spark, sf)
    return r.select("request_id", "original_bytes", "compressed_bytes", "saved_bytes", d.half_up(F.col("saved_percent") * 1000.0).cast("long").alias("saved_milli"), "returned_original", F.octet_length("compressed_pdf").cast("long").alias("sent"))


@query(RESULT_SQL + " SELECT request_id, CAST(13 AS INTEGER) AS n, CAST(z AS VARCHAR) AS compressed, CAST(back AS VARCHAR) AS returned, 'dpi=150,q=0.75' AS profile FROM y")
def response_headers(spark, sf):
    h = order_results(spark, sf).select("request_id", engine.headers().alias("h"))
    return h.select("request_id", F.size("h").alias("n"), F.col("h")["X-Compressed-Bytes"].alias("compressed"), F.col("h")["X-Returned-Original"].alias("returned"), F.col("h")["X-Profile"].alias("profile"))


METERS = RESULT_SQL + """, g AS (SELECT CASE WHEN back THEN 'original' ELSE 'compressed' END AS tag, count(*) AS n FROM y GROUP BY back),
m AS (SELECT 'pcs.compression.requests' AS meter, tag, n::DOUBLE AS value FROM g UNION ALL SELECT 'pcs.compression.duration.count', tag, n FROM g UNION ALL SELECT 'pcs.compression.duration.max', tag, 0.007::DOUBLE FROM g
UNION ALL SELECT 'pcs.compression.bytes.in', '', sum(o) FROM y UNION ALL SELECT 'pcs.compression.bytes.out', '', sum(z) FROM y UNION ALL SELECT 'pcs.compression.bytes.saved', '', sum(greatest(0, o - z)) FROM y UNION ALL SELECT 'pcs.compression.saved.percent.count', '', count(*) FROM y
UNION ALL SELECT 'pcs.images', unnest(['inspected', 'downsampled', 'recompressed', 'unchanged']), 0 UNION ALL SELECT 'pcs.compression.slots.max', '', 16 UNION ALL SELECT 'pcs.compression.slots.inflight', '', 3)"""


@query(METERS + " SELECT meter, tag, value FROM m")
def metrics_meters(spark, sf):
    m = metrics.meters(order_results(spark, sf), slots=S.slots(4), in_flight=3)
    return m.where("meter NOT LIKE '%.sum' AND meter <> 'pcs.compression.saved.percent.max'")


@query(METERS + """ SELECT CASE meter WHEN 'pcs.images' THEN 'pcs_images{action="' || tag || '"} ' ELSE 'pcs_compression_requests{outcome="' || tag || '"} ' END || CAST(value AS VARCHAR) AS line FROM m WHERE meter IN ('pcs.images', 'pcs.compression.requests')""")
def metrics_exposition(spark, sf):
    m = metrics.meters(order_results(spark, sf)).where("meter IN ('pcs.images', 'pcs.compression.requests')")
    return metrics.exposition(m)


@query("SELECT event_type AS reason, count(*)::DOUBLE AS value FROM events WHERE event_type <> 'click' GROUP BY event_type")
def metrics_failures(spark, sf):
    failed = t(spark, sf, "events").where("event_type <> 'click'").select(F.col("event_type").alias("reason"))
    m = metrics.meters(order_results(spark, sf).limit(0), failed)
    return m.where("meter = 'pcs.compression.failures'").select(F.col("tag").alias("reason"), "value")


def raw_events(spark, sf):
    """Events as a logger hands them over: some without a logger or a request, some with a stack trace."""
    k = F.col("event_id")
    logger = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "plain").when(k % 5 == 2, "ends.").otherwise(F.concat(F.lit("com.example."), F.col("event_type")))
    mdc = F.when(k % 2 == 0, F.create_map(F.lit("requestId"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return t(spark, sf, "events").select(k.alias("timestamp"), F.lit("INFO").alias("level"), logger.alias("logger"), F.lit("main").alias("thread"), mdc.alias("mdc"), F.col("event_type").alias("message"), F.when(k % 7 == 0, F.lit("Oops: 1\n\tat A")).alias("throwable"))


LOG = """WITH e AS (SELECT event_id AS "epochMillis", 'INFO' AS level, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'plain' WHEN 2 THEN 'ends.' ELSE event_type END AS logger, 'main' AS thread, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS "requestId",
 event_type || CASE WHEN event_id % 7 = 0 THEN chr(10) || 'Oops: 1' || chr(10) || chr(9) || 'at A' ELSE '' END AS message FROM events)"""


@query(LOG + " SELECT * FROM e")
def log_entries(spark, sf):
    return streams.entries(raw_events(spark, sf))


@query(LOG + """ SELECT 'id:' || "epochMillis" || chr(10) || 'event:log' || chr(10) || 'data:{"id":' || "epochMillis" || ',"epochMillis":' || "epochMillis" || ',"level":"INFO","logger":"' || logger || '","thread":"main","requestId":"' || "requestId" || '","message":"'
 || replace(replace(message, chr(10), '\\n'), chr(9), '\\t') || '"}' || chr(10) || chr(10) AS frame FROM e""")
def log_frames(spark, sf):
    e = streams.entries(raw_events(spark, sf)).withColumn("id", F.col("epochMillis"))
    return e.select(streams.frame().alias("frame"))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS BIGINT) AS batch FROM documents")
def image_batches(spark, sf):
    """A document's images in batches of four, in order of discovery."""
    return images.batched(t(spark, sf, "documents"), ["source"], "doc_id", 4).select("doc_id", "batch")


@query(LOG + """, n AS (SELECT row_number() OVER (ORDER BY "epochMillis") AS id, * FROM e) SELECT id, "epochMillis" FROM n WHERE id > 100""")
def stream_log_store(spark, sf):
    """A log taken in as a stream, numbered, and followed by a second stream from an id on."""
    import uuid

    from ..storage import shared_folder

    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    raw_events(spark, sf).coalesce(1).write.parquet(f"{folder}/raw")
    store = streams.LogStore(spark, f"{folder}/store")
    events = spark.readStream.schema(raw_events(spark, sf).schema).parquet(f"{folder}/raw")
    store.start(streams.entries(events), f"{folder}/in").awaitTermination()
    name = f"followed_{uuid.uuid4().hex}"
    run = store.follow(100).select("id", "epochMillis").writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={k}")).option("checkpointLocation", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id long, epochMillis long").parquet(f"{folder}/{name}").select("id", "epochMillis")

"""Settings, jobs, metrics and the log stream."""

import datetime
import os

import pytest

from quillfold import config
from quillfold.functions import decisions as d
from quillfold.operators import fonts, graph, jobs, likeness, metrics
from quillfold.streaming import jobs as job_stream
from quillfold.streaming import logs


def test_settings_from_everywhere():
    s = config.loaded("# c\npdf.compression.target-dpi=72\npdf.compression.async.retention=2h\npdf.compression.larger-result-policy=use_smallest\nother=1", {"PDF_COMPRESSION_JPEGQUALITY": "0.5", "PDF_COMPRESSION_ASYNC_MAXACTIVEJOBS": "7"}, ["--pdf.compression.target-dpi=96", "x"])
    assert (s.target_dpi, s.retention_seconds, s.larger_result_policy, s.jpeg_quality, s.max_active_jobs) == (96, 7200, "USE_SMALLEST", 0.5, 7)
    assert [config.seconds(x) for x in ("30s", "5m", "1h", "PT1H30M", "1500", "P1D")] == [30, 300, 3600, 5400, 1, 86400]
    for bad in ("target-dpi=0", "target-dpi=2401", "jpeg-quality=1.5", "jpeg-quality=nan", "min-dimension=10001", "async.retention=soon", "async.max-active-jobs=0", "strip-metadata=maybe", "stream-cache=disk", "max-decode-pixels=-1"):
        with pytest.raises(config.InvalidOption):
            config.loaded(f"pdf.compression.{bad}")
    assert config.Settings().overlay(target_dpi=10, jpeg_quality=None).target_dpi == 10 and config.Settings().slots(4) == 16 and config.Settings(max_concurrent_compressions=3).slots(4) == 3
    with pytest.raises(config.InvalidOption):
        config.Settings().overlay(min_dimension=3)


def test_row_overrides_out_of_bounds_raise(spark):
    with pytest.raises(Exception, match="out of bounds"):
        spark.sql("SELECT 3000 AS x").select(config.overlaid("target_dpi", d.F.col("x"), config.Settings())).collect()


def test_notes_round_before_they_compare(spark):
    rows = [(1000, 795, 0, 0), (1000, 794, 395, 0), (1000, 100, 395, 0), (1000, 100, 394, 0), (0, 0, 0, 0), (1000, 900, 50, 25), (1000, 0, 600, 0)]
    df = spark.createDataFrame(rows, "t long, i long, a long, s long").coalesce(1)
    got = [r[0] for r in df.select(d.note(*map(d.F.col, "tias"))).collect()]
    assert got[0].startswith("Images are 80% of") and got[1].startswith("Fonts and vector/text content are 40%") and got[2].startswith("Fonts and vector/text content are 40%")
    assert got[3] == "Images 10%, fonts+vectors 39% of stream bytes." and got[4] == "No stored streams found." and got[5].startswith("Font subsetting could target ~3% of stream bytes (25 bytes")


def test_small_rules(spark):
    one = spark.sql("SELECT 1 AS x")
    names = ["a.b.C", "C", "a.", "", None]
    assert [one.select(d.short_logger(d.F.lit(x).cast("string"))).first()[0] for x in names] == ["C", "C", "a.", "", ""]
    assert [one.select(d.error_status(d.F.lit(x).cast("string"))).first()[0] for x in ("InvalidPdf", None, "AsyncEnded", "X")] == [422, 500, None, 500]
    assert [one.select(d.wants_downsample(d.F.lit(s), d.F.lit(b))).first()[0] for s, b in ((0.49, 1), (0.5, 1), (0.9, 8), (0.91, 8))] == [True, False, True, False]
    assert [one.select(d.is_tagged(d.F.lit(x))).first()[0] for x in ("ArialMT", "ABCDEF+ArialMT", "QWERTY+MinionPro", "ABCDEF+")] == [False, True, True, False]
    assert [one.select(d.subsettable(d.F.lit(p), d.F.lit(x))).first()[0] for p, x in (("TrueType", "ArialMT"), ("TrueType", "ABCDEF+ArialMT"), ("CFF", "QWERTY+MinionPro"))] == [True, False, False]
    assert fonts.character("uni00E9") == "é" and fonts.character("comma") == "," and fonts.character("A") == "A" and fonts.character("strange") is None


def test_reach_is_not_bounded(spark):
    edges = spark.range(0, 25).selectExpr("id AS src", "id + 1 AS dst").union(spark.sql("SELECT 25L, 0L"))
    roots = spark.sql("SELECT 0L AS node UNION ALL SELECT NULL")
    assert graph.reachable(edges, roots).count() == 26
    assert graph.reachable(edges.where("false"), roots).count() == 1 and graph.reachable(edges, roots.where("false")).count() == 0


def at(minute: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1, 0, minute)


EVENTS = [("a", 1, at(0), "QUEUED", "f.pdf", 9, None), ("a", 2, at(1), "RUNNING", None, None, None), ("a", 3, at(2), "SUCCEEDED", None, None, None), ("a", 4, at(3), "RUNNING", None, None, None), ("b", 5, at(0), "QUEUED", "g.pdf", 3, None),
          ("b", 6, at(4), "FAILED", None, None, "InvalidPdf"), ("c", 7, at(5), "QUEUED", "h.pdf", 1, None), ("c", 8, at(6), "RUNNING", None, None, None), ("d", 9, at(7), "QUEUED", None, None, None)]
EVENT = "job_id string, seq long, ts timestamp, status string, filename string, submitted_bytes long, error string"


def test_job_states_and_views(spark):
    table = jobs.states(spark.createDataFrame(EVENTS, EVENT))
    got = {r.job_id: r for r in table.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "SUCCEEDED", "b": "FAILED", "c": "RUNNING", "d": "QUEUED"}
    assert (got["a"].started_at, got["a"].finished_at, got["b"].started_at, got["b"].error, got["a"].filename, got["c"].finished_at) == (at(1), at(2), None, "InvalidPdf", "f.pdf", None)
    view = {r.job_id: r.view for r in jobs.view(table).collect()}
    assert '"resultUrl":"/jobs/a/result"' in view["a"] and "error" not in view["a"] and '"error":"InvalidPdf"' in view["b"] and "finishedAt" not in view["c"]
    asked = spark.createDataFrame([("a",), ("c",), ("z",)], "job_id string")
    assert {r.job_id: r.code for r in jobs.looked_up(asked, table, True).collect()} == {"a": 200, "c": 409, "z": 404}
    assert jobs.states(table.where("false").select("job_id", d.F.lit(1).alias("seq"), d.F.col("started_at").alias("ts"), "status", "filename", "submitted_bytes", "error")).count() == 0
    assert {r.job_id for r in jobs.to_evict(table, 60, now=d.F.lit(at(4))).collect()} == {"a"} and jobs.to_evict(table.where("false"), 60).count() == 0
    assert {r.job_id for r in jobs.to_evict(table, 90).collect()} == {"a"}


def test_job_results_are_kept_and_discarded(spark, tmp_path):
    path = str(tmp_path / "results")
    jobs.keep_results(spark.createDataFrame([("a", b"1"), ("b", b"2")], "job_id string, content binary"), path)
    jobs.keep_results(spark.createDataFrame([("b", b"3")], "job_id string, content binary"), path)
    assert [bytes(r.content) for r in jobs.kept_result(spark, path, "b").collect()] == [b"3"] and jobs.kept_result(spark, path, "a").count() == 1
    jobs.discard(spark, path, ["a"])
    assert not os.path.exists(f"{path}/job_id=a") and os.path.exists(f"{path}/job_id=b")
    jobs.discard(spark, path, [])
    assert not os.path.exists(path)


def test_job_stream_keeps_state_and_evicts(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()

    def add(rows, k):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{k}")

    def run():
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        sink = lambda batch, _: out.extend(tuple(r) for r in batch.collect())
        job_stream.follow(events, 60).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    add(EVENTS[:2], 1)
    run()
    assert [(x[0], x[1], x[6]) for x in out] == [("a", "RUNNING", False)]
    add(EVENTS[2:], 2)
    add([("e", 10, at(30), "QUEUED", None, None, None)], 3)
    run()  # again from its checkpoint
    add([("e", 11, at(40), "RUNNING", None, None, None)], 4)
    run()
    last = {x[0]: (x[1], x[6]) for x in out}
    assert last == {"a": ("SUCCEEDED", True), "b": ("FAILED", True), "c": ("RUNNING", False), "d": ("QUEUED", False), "e": ("RUNNING", False)}
    assert next(x for x in out if x[0] == "a" and x[1] == "SUCCEEDED")[2:5] == (at(0), at(1), at(2))


def test_health_and_version(spark, tmp_path):
    assert metrics.health(spark, str(tmp_path), 16, 2) == {"status": "UP", "tempDirWritable": True, "maxConcurrentCompressions": 16, "inFlightCompressions": 2} and not os.listdir(tmp_path)
    assert metrics.health(spark, "/proc/none", 16, 0)["status"] == "DOWN"
    assert metrics.version(None) == {"version": "unknown"} and list(metrics.version({"version": "1", "name": "n"})) == ["name", "version", "buildTime", "buildNumber", "gitSha"]
    assert metrics.in_flight(jobs.states(spark.createDataFrame(EVENTS, EVENT))) == 1


def test_likeness_of_equal_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]), (2, None, [1.0])], "k int, a array<double>, b array<double>")
    assert [(r.k, round(r.likeness, 6)) for r in likeness.blocks(df, "k", "a", "b", 2).collect()] == [(1, 1.0)]


def entry(k):
    return (k, "INFO", "L", "t", "", f'say "{k}"\n\x01')


def test_log_store_numbers_replays_and_follows(spark, tmp_path):
    source, store, seen = tmp_path / "in", logs.LogStore(spark, str(tmp_path / "store")), []
    source.mkdir()
    assert store.entries().count() == 0

    def add(*keys):
        spark.createDataFrame([entry(k) for k in keys], logs.ENTRY).coalesce(1).write.mode("append").parquet(str(source))
        store.start(spark.readStream.schema(logs.ENTRY).parquet(str(source)), str(tmp_path / "taken")).awaitTermination()

    def view(name, after=0):
        store.view(seen.extend, str(tmp_path / name), after).awaitTermination()

    add(30, 10, 20)
    assert [(r.id, r.epochMillis) for r in store.entries().orderBy("id").collect()] == [(1, 10), (2, 20), (3, 30)]
    view("one", after=1)
    assert [x.split("\n")[0] for x in seen] == ["id:2", "id:3"] and seen[0].startswith('id:2\nevent:log\ndata:{"id":2,"epochMillis":20,"level":"INFO","logger":"L"') and '\\"20\\"\\n\\u0001' in seen[0] and seen[0].endswith("}\n\n")
    add(50, 40)
    view("one", after=1)  # goes on where it stopped
    assert [x.split("\n")[0] for x in seen] == ["id:2", "id:3", "id:4", "id:5"]
    store.append(spark.createDataFrame([entry(40), entry(50)], logs.ENTRY), 1)  # a batch run again
    assert store.entries().count() == 5 and [r.id for r in store.history(3).orderBy("id").collect()] == [3, 4, 5]


def test_a_slow_viewer_is_dropped_alone(spark, tmp_path):
    store = logs.LogStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([entry(k) for k in range(9)], logs.ENTRY), 0)
    with pytest.raises(Exception, match="entries behind"):
        store.view(list, str(tmp_path / "slow"), queue=4).awaitTermination()
    seen = []
    store.view(seen.extend, str(tmp_path / "other")).awaitTermination()
    assert len(seen) == 9


def test_connections_end(spark, tmp_path):
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
    assert logs.run_for(query, 1) is False and not query.isActive

"""Queries over generated PDF files: every supplier becomes a small file, and the engine reads it back or compresses it.

The files follow from the supplier's numbers by simple rules, so the oracle can state what their tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..config import Settings
from ..operators import images, metrics, profiles
from ..sinks import pdf as sink
from ..sources import pdf
from .standins import query, t


def made(key: int, nation: int) -> bytes:
    """A file of 1 + nation % 3 pages. Each draws the image of side 8 + key % 20 at 10 by 20 points times its number; the
    image is there twice if the key is even. Arrays of two profiles, equal if the key divides by 3, hang on the catalog."""
    side = 8 + key % 20
    picture = pdf.Stream({"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Image"), "Width": side, "Height": side, "BitsPerComponent": 8, "ColorSpace": pdf.Name("DeviceGray")}, bytes([key % 251]) * side * side)
    n = 1 + nation % 3
    kids = [pdf.Ref(10 + 2 * k) for k in range(n)]
    names = {"Im0": pdf.Ref(4)} | ({"Im1": pdf.Ref(5)} if key % 2 == 0 else {})
    objects: dict[int, object] = {
        1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2), "Spaces": [[pdf.Name("ICCBased"), pdf.Ref(6)], [pdf.Name("ICCBased"), pdf.Ref(7)]], "PieceInfo": {"A": pdf.Ref(8)}},
        2: {"Type": pdf.Name("Pages"), "Kids": kids, "Count": n, "MediaBox": [0, 0, 595, 842]}, 4: picture, 6: pdf.Stream({"N": 3}, b"p" * (100 + nation)), 7: pdf.Stream({"N": 3}, (b"p" if key % 3 == 0 else b"q") * (100 + nation)), 8: [key],
    }
    if key % 2 == 0:
        objects[5] = pdf.Stream(dict(picture.head), picture.raw)
    for k in range(n):
        body = b" ".join(b"q %d 0 0 %d 0 0 cm /%s Do Q" % (10 * (k + 1), 20 * (k + 1), x.encode()) for x in names)
        objects[10 + 2 * k] = {"Type": pdf.Name("Page"), "Parent": pdf.Ref(2), "Contents": pdf.Ref(11 + 2 * k), "Resources": {"XObject": names}, "Rotate": 90 * (key % 4)}
        objects[11 + 2 * k] = pdf.Stream({}, body)
    return sink.written(pdf.Pdf(objects=objects, trailer={"Root": pdf.Ref(1)}))


def supplier_files(spark, sf) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [made(k, n) for k, n in zip(b.column("s_suppkey").to_pylist(), b.column("s_nationkey").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("s_suppkey").cast(pa.string()), pa.array([len(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=["path", "length", "content"])

    return t(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("int").alias("s_nationkey")).mapInArrow(run, "path string, length long, content binary")


FILE = "WITH f AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS path, 1 + s_nationkey % 3 AS n, s_nationkey, 8 + s_suppkey % 20 AS side, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS m FROM supplier), p AS (SELECT *, unnest(range(0, n)) AS i FROM f), d AS (SELECT *, unnest(range(0, m)) AS j FROM p)"


@query(FILE + " SELECT path, CAST(n AS INTEGER) AS pages, CAST(6 + (m - 1) + 2 * n AS INTEGER) AS objects, false AS encrypted FROM f")
def pdf_documents(spark, sf):
    return pdf.documents(supplier_files(spark, sf)).select("path", "pages", "objects", "encrypted")


@query(FILE + " SELECT path, CAST(i AS INTEGER) AS page_idx, 595.0::DOUBLE AS media_w, 842.0::DOUBLE AS media_h, CAST(90 * (k % 4) AS INTEGER) AS rotate FROM p")
def pdf_pages(spark, sf):
    return pdf.pages(supplier_files(spark, sf)).select("path", "page_idx", "media_w", "media_h", "rotate")


@query(FILE + " SELECT path, count(*) AS streams, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT path, m * side * side AS size FROM f UNION ALL SELECT path, unnest([100 + s_nationkey, 100 + s_nationkey]) FROM f UNION ALL SELECT path, m * (24 + 2 * strlen(CAST(10 * (i + 1) AS VARCHAR))) + (m - 1) FROM p) GROUP BY path".replace("SELECT path, m * side * side AS size FROM f", "SELECT path, unnest(CASE WHEN m = 2 THEN [side * side, side * side] ELSE [side * side] END) AS size FROM f"))
def pdf_streams(spark, sf):
    o = pdf.objects(supplier_files(spark, sf)).where("kind = 'stream'")
    return o.groupBy("path").agg(F.count(F.lit(1)).alias("streams"), F.sum("stream_len").alias("bytes"))


@query(FILE + " SELECT path, CAST(i AS INTEGER) AS page_idx, CAST(i * m + j AS INTEGER) AS at, (10 * (i + 1))::DOUBLE AS w, (20 * (i + 1))::DOUBLE AS h FROM d".replace("i * m + j", "j"))
def pdf_draws(spark, sf):
    d = pdf.image_draws(supplier_files(spark, sf))
    return d.select("path", "page_idx", F.col("draw_seq").alias("at"), F.col("scale_x").alias("w"), F.col("scale_y").alias("h"))


@query(FILE + " SELECT path, CAST(j AS INTEGER) AS discovery_idx, max(10 * (i + 1))::DOUBLE AS w_pt, max(20 * (i + 1))::DOUBLE AS h_pt, CAST(1 AS INTEGER) AS named FROM d GROUP BY path, j")
def pdf_usage(spark, sf):
    """Images in order of discovery, the names resources give them, and the largest size at which they are drawn. Pages
    share one dictionary of names in each file only by value, so an image is named once a page."""
    raw = supplier_files(spark, sf)
    named = images.references(pdf.image_references(raw).where("page_idx = 0"))
    met = named.join(images.extents(pdf.image_draws(raw)), ["path", "image_id"])
    return met.select("path", "discovery_idx", F.col("w_pt").cast("double").alias("w_pt"), F.col("h_pt").cast("double").alias("h_pt"), F.col("n_refs").alias("named"))


@query(FILE + " SELECT path, CAST(1 AS BIGINT) AS profiles_merged, CAST(100 + s_nationkey AS BIGINT) AS bytes_saved FROM f WHERE k % 3 = 0")
def pdf_profiles(spark, sf):
    return profiles.saved(profiles.merged(pdf.profiles(supplier_files(spark, sf))))


@query(FILE + " SELECT path, count(*) AS n FROM (SELECT path, unnest(range(0, 5 + (m - 1) * n + 4 * n + CASE WHEN true THEN 0 END)) FROM f) GROUP BY path".replace("5 + (m - 1) * n + 4 * n + CASE WHEN true THEN 0 END", "1 + 1 + n + 2 + n * (2 + m)"))
def pdf_edges_left(spark, sf):
    """References left once private data are stripped: of the trailer, the catalog, the tree and the pages."""
    raw = supplier_files(spark, sf)
    return pdf.without_private(pdf.edges(raw), pdf.objects(raw)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(FILE + ", r AS (SELECT * FROM f) SELECT path AS request_id, CAST(n AS INTEGER) AS page_count, CAST(CASE WHEN side >= 16 AND side * side >= 300 THEN m ELSE 0 END AS INTEGER) AS images_inspected, CAST(0 AS INTEGER) AS fonts_subset, 'dpi=150,q=0.75' AS profile, CAST(NULL AS VARCHAR) AS error FROM r")
def pdf_compress(spark, sf):
    return engine.compress(supplier_files(spark, sf), Settings(min_byte_size=300)).select("request_id", "page_count", "images_inspected", "fonts_subset", "profile", "error")


@query(FILE + " SELECT 'inspected' AS tag, CAST(sum(CASE WHEN side >= 16 AND side * side >= 300 THEN m ELSE 0 END) AS BIGINT) AS images FROM f")
def pdf_meters(spark, sf):
    m = metrics.meters(engine.compress(supplier_files(spark, sf), Settings(min_byte_size=300)))
    return m.where("meter = 'pcs.images' AND tag = 'inspected'").select("tag", F.col("value").cast("long").alias("images"))

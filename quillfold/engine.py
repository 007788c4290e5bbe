"""Compression of PDF files as a flow of tables.

    compress(raw, settings, options) -> one result for each file

Files are parsed to tables, once for all of them; what is decided about images, profiles and fonts is decided by joins and column rules on them;
images are decoded and encoded a row each; the changes of a document come together by its path, and the document is written
anew in the task that holds its bytes. A document that can't be read, or written, keeps its bytes and has an error; an image
or font that can't be handled stays as it is. Null content is an error; an empty table gives no rows; paths are expected
to be distinct, as file paths are.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import OVERRIDES, Settings, overlaid
from .functions import decisions as d
from .operators import dedup
from .operators import fonts as font_rules
from .operators import images as image_rules
from .operators import profiles as profile_rules
from .sources import pdf
from .storage import Kept

RESULT = (
    "request_id string, original_bytes long, compressed_bytes long, saved_bytes long, saved_percent double, page_count int, images_inspected int, images_downsampled int, "
    "images_recompressed int, images_unchanged int, fonts_subset int, profile string, duration_millis long, returned_original boolean, compressed_pdf binary"
)
# Names of the response headers, and the columns they show.
HEADERS = {
    "X-Original-Bytes": "original_bytes", "X-Compressed-Bytes": "compressed_bytes", "X-Saved-Bytes": "saved_bytes", "X-Saved-Percent": "saved_percent", "X-Page-Count": "page_count",
    "X-Images-Inspected": "images_inspected", "X-Images-Downsampled": "images_downsampled", "X-Images-Recompressed": "images_recompressed", "X-Images-Unchanged": "images_unchanged",
    "X-Fonts-Subset": "fonts_subset", "X-Profile": "profile", "X-Duration-Millis": "duration_millis", "X-Returned-Original": "returned_original",
}


def effective(raw: DataFrame, s: Settings, options: DataFrame | None) -> DataFrame:
    """path and the five request options of each file: its own where options(path, ...) has them, else the settings'."""
    given = raw.select("path")
    if options is not None:
        given = given.join(options.select("path", *[x for x in OVERRIDES if x in options.columns]), "path", "left")
    kinds = {int: "int", float: "double", bool: "boolean"}
    own = {x: (F.col(x) if x in given.columns else F.lit(None)).cast(kinds[type(getattr(s, x))]) for x in OVERRIDES}
    return given.select("path", *[overlaid(x, own[x], s).alias(x) for x in OVERRIDES])


def image_outcomes(tables: DataFrame, s: Settings, own: DataFrame) -> DataFrame:
    """Every image that resources name, with its plan, what was made of it, its outcome, and its fingerprint as the document
    will have it. Decisions are made on descriptions; bytes are digested where they are read, and only those of pending
    images move, once."""
    images = pdf.one(tables, "images")
    shape = ["path", "image_id", "w", "h", "bpc", "color_space", "filters", "stencil", "components", "encoded_len"]
    described = image_rules.fingerprinted(images.select(*shape, "content", F.col("mask_content").alias("mask")))
    met = described.join(image_rules.references(pdf.one(tables, "references")), ["path", "image_id"]).join(own, "path")
    plan = image_rules.planned(met, image_rules.extents(pdf.one(tables, "draws")), s, F.col("target_dpi"), F.col("max_image_dimension"))
    pending = plan.where("action = 'pending'").select("path", "image_id", "target_w", "target_h", F.col("jpeg_quality").alias("quality"))
    made = image_rules.transformed(pending.join(images.select("path", "image_id", "info", "content", "mask_content"), ["path", "image_id"]))
    found = image_rules.outcomes(plan, made, s)
    new = found.select("*", *[F.col(f"new_{a}").alias(f"final_{b}") for a, b in (("w", "w"), ("h", "h"), ("bpc", "bpc"), ("space", "color_space"), ("filter", "filters"))])
    digest = dedup.image_fingerprint(*[F.col(f"final_{x}") for x in ("w", "h", "bpc", "color_space", "filters")], F.col("new_data"), F.col("new_mask"))
    new = new.withColumn("fingerprint", F.when(F.col("outcome") == "recompressed", digest).otherwise(F.col("fingerprint")))
    return new.drop(*[f"final_{x}" for x in ("w", "h", "bpc", "color_space", "filters")])


WRITTEN = "path string, candidate binary, pages int, encrypted boolean, error string, millis long"
#: Columns that go through the writer, so that the documents' bytes move once.
PASSED = "content binary, original_bytes long, target_dpi int, jpeg_quality double, fonts_subset int"


def rewritten(raw: DataFrame) -> DataFrame:
    """The columns of WRITTEN and PASSED for raw(path, images, moves, fonts, strip_metadata, strip_private_data, and those
    of PASSED)."""
    from .sinks import pdf as sink

    def changes(row: dict) -> sink.Changes:
        out = sink.Changes(strip_metadata=bool(row["strip_metadata"]), strip_private=bool(row["strip_private_data"]))
        for m in row["moves"] or []:
            out.moved[m["old"]] = m["new"]
        return out

    def replaced(parsed: pdf.Pdf, out: sink.Changes, x: dict) -> None:
        """The image's own entries stay, but for those that its encoding sets."""
        old = parsed.get(pdf.Ref(x["image_id"])).head
        gone = ("Width", "Height", "BitsPerComponent", "ColorSpace", "Filter", "F", "DecodeParms", "DP", "Decode", "Length", "SMask", "SMaskInData", "ImageMask", "Mask")
        head = {k: v for k, v in old.items() if k not in gone}
        head |= {"Width": x["new_w"], "Height": x["new_h"], "BitsPerComponent": x["new_bpc"], "ColorSpace": pdf.Name(x["new_space"]), "Filter": pdf.Name(x["new_filter"])}
        if parms := json.loads(x["new_parms"]):
            head["DecodeParms"] = parms
        if x["new_mask"] is not None:
            number = max([*parsed.objects, *out.streams]) + 1
            soft = {"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Image"), "Width": x["new_w"], "Height": x["new_h"], "BitsPerComponent": 8, "ColorSpace": pdf.Name("DeviceGray"), "Filter": pdf.Name("FlateDecode")}
            out.streams[number] = pdf.Stream(soft, x["new_mask"])
            head["SMask"] = pdf.Ref(number)
        out.streams[x["image_id"]] = pdf.Stream(head, x["new_data"])

    def lettered(parsed: pdf.Pdf, out: sink.Changes, x: dict) -> None:
        program = sink.packed(x["subset"], Length1=len(x["subset"]))
        out.streams[x["program_id"]] = program
        name = {"BaseFont": pdf.Name(x["new_name"])}
        out.entries[x["font_id"]] = dict(name)
        if x["cid_map"] is not None:
            number = max([*parsed.objects, *out.streams]) + 1
            out.streams[number] = sink.packed(x["cid_map"])
            out.entries[x["font_id"]]["CIDToGIDMap"] = pdf.Ref(number)
            if x["type0_id"]:
                out.entries[x["type0_id"]] = dict(name)
        if x["descriptor"]:
            out.entries[x["descriptor"]] = {"FontName": pdf.Name(x["new_name"])}

    def one(row: dict) -> tuple:
        began = time.monotonic_ns()
        parsed, error, out = None, None, None
        try:
            parsed = pdf.parse(row["content"] or b"")
            change = changes(row)
            for x in row["images"] or []:
                replaced(parsed, change, x)
            for x in row["fonts"] or []:
                lettered(parsed, change, x)
            pages = sum(1 for _ in pdf.pages_of(parsed))
            out = sink.written(parsed, change)
        except (ValueError, TypeError, KeyError, AttributeError, RecursionError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
        millis = (time.monotonic_ns() - began) // 1_000_000
        return (row["path"], out, *((pages, parsed.encrypted) if parsed and not error else (None, None)), error, millis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in WRITTEN.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                found = one({x: batch.column(x)[k].as_py() for x in used})
                yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(found, kinds, strict=True)), *(batch.column(x).slice(k, 1) for x in passed)], names=[*names, *passed])

    used, passed = ["path", "content", "images", "moves", "fonts", "strip_metadata", "strip_private_data"], [x.split()[0] for x in PASSED.split(", ")]
    return raw.select(*used, *passed[1:]).mapInArrow(run, f"{WRITTEN}, {PASSED}")


def compress(raw: DataFrame, s: Settings | None = None, options: DataFrame | None = None, kept: Kept | None = None) -> DataFrame:
    """The columns of RESULT and error for PDF files raw(path, length, content); the path is the request's id. options(path,
    ...) may override the request options of some files. Tables of the files and of their images are kept in the shared
    folder: the caller may hand over `kept` to discard them once the result is written."""
    s, kept = s or Settings(), kept or Kept(raw.sparkSession, "compress")
    own = effective(raw, s, options)
    tables = kept(pdf.gathered(raw, "images", "draws", "references", "fonts", "glyphs", "profiles"), "tables")
    found = kept(image_outcomes(tables, s, own), "images")
    shape = ["image_id", "new_w", "new_h", "new_bpc", "new_space", "new_filter", "new_parms", "new_data", "new_mask"]
    new = found.where("outcome = 'recompressed'").groupBy("path").agg(F.collect_list(F.struct(*shape)).alias("images"))
    same = image_rules.merged(found.where("deduplicate_images")).select("path", F.col("image_id").alias("old"), F.col("canonical").alias("new"))
    profile = profile_rules.merged(pdf.one(tables, "profiles")).select("path", F.col("stream_id").alias("old"), F.col("canonical").alias("new"))
    moves = same.unionByName(profile).distinct().groupBy("path").agg(F.collect_list(F.struct("old", "new")).alias("moves"))
    whole = raw.select("path", "content", F.octet_length("content").cast("long").alias("original_bytes")).join(own, "path").join(new, "path", "left").join(moves, "path", "left")
    if s.subset_fonts:
        cut = font_rules.plan(pdf.one(tables, "fonts"), pdf.one(tables, "glyphs"), raw)
        taken = F.when(F.col("refusal").isNull(), F.struct("font_id", "type0_id", "descriptor", "program_id", "subset", "cid_map", "new_name"))
        fonts = cut.groupBy("path").agg(F.collect_list(taken).alias("fonts"), F.count_if(F.col("refusal").isNull()).cast("int").alias("fonts_subset"))
        whole = whole.join(fonts, "path", "left")
    else:
        whole = whole.withColumns({"fonts": F.lit(None).cast("array<struct<font_id:int>>"), "fonts_subset": F.lit(0)})
    made = rewritten(whole.withColumn("strip_private_data", F.lit(s.strip_private_data)))
    return results(made.join(image_rules.counters(found), "path", "left"), s)


def results(stats: DataFrame, s: Settings) -> DataFrame:
    """RESULT and error from a row for each document with its original and candidate bytes and its counters."""
    size = F.octet_length("candidate").cast("long")
    original = F.coalesce(F.col("original_bytes"), F.lit(0).cast("long"))
    back = F.coalesce(d.keeps_original(size, original, s), F.lit(True))
    length = F.when(back, original).otherwise(size)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("int").alias(x)
    return stats.select(
        F.col("path").alias("request_id"), original.alias("original_bytes"), length.alias("compressed_bytes"), (original - length).alias("saved_bytes"), d.saved_percent(original - length, original).alias("saved_percent"),
        F.col("pages").alias("page_count"), zero("images_inspected"), zero("images_downsampled"), zero("images_recompressed"), zero("images_unchanged"), zero("fonts_subset"),
        d.profile(F.col("target_dpi"), F.col("jpeg_quality")).alias("profile"), F.col("millis").alias("duration_millis"), back.alias("returned_original"), chosen(back).alias("compressed_pdf"), "error",
    )


def chosen(returned_original: Column, original: str = "content", candidate: str = "candidate") -> Column:
    """The bytes that go out."""
    return F.when(returned_original, F.col(original)).otherwise(F.col(candidate))


def headers() -> Column:
    """A result's response headers, as a map of strings."""
    return F.create_map(*[x for k, c in HEADERS.items() for x in (F.lit(k), F.col(c).cast("string"))])

"""Images of documents: how large they are drawn, what is decided about them, and what becomes of them.

Decisions are column expressions over the images' descriptions. Only images that pass them are decoded, each in a row of its
own, so a document of many images is spread over tasks; an image that can't be decoded carries an error and stays as it is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import decisions as d
from . import dedup


def extents(draws: DataFrame) -> DataFrame:
    """path, image_id, w_pt, h_pt: the largest size in points at which an image is drawn, each axis by itself."""
    sized = draws.where("image_id IS NOT NULL").select("path", "image_id", d.extent(F.col("scale_x"), F.col("shear_y")).alias("w"), d.extent(F.col("shear_x"), F.col("scale_y")).alias("h"))
    return sized.groupBy("path", "image_id").agg(F.max("w").alias("w_pt"), F.max("h").alias("h_pt"))


def references(named: DataFrame, keys: tuple[str, ...] = ("path", "image_id"), order: str = "ref_idx", name: str = "name") -> DataFrame:
    """The keys, discovery_idx (the first place in order) and refs (count and names in order) of each image once."""
    per = named.groupBy(*keys).agg(F.min(order).alias("discovery_idx"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(name).alias("name")))).alias("r"))
    return per.select(*keys, "discovery_idx", F.size("r").alias("n_refs"), F.transform("r", lambda x: x["name"]).alias("names"))


def planned(images: DataFrame, drawn: DataFrame, s: Settings, dpi: Column | int, cap: Column | int, keys: tuple[str, ...] = ("path", "image_id")) -> DataFrame:
    """images(w, h, bpc, stencil, components, color_space, encoded_len, ...) with skip_reason, scale, downsample, target_w,
    target_h and action: skipped, kept (one bit a pixel and not too large) or pending. An image never drawn has no extent."""
    met = images.join(drawn, list(keys), "left")
    four = F.coalesce(F.col("components") == 4, F.lit(False)) | F.coalesce(F.col("color_space") == "DeviceCMYK", F.lit(False))
    unsized = F.col("w").isNull() | F.col("h").isNull()
    reason = F.when(F.col("stencil"), "stencil").when(unsized, "dimension").otherwise(d.skip_reason(F.col("stencil"), F.col("w"), F.col("h"), F.col("encoded_len"), F.col("components"), four, s))
    out = met.withColumn("skip_reason", reason).withColumn("scale", d.scale(F.col("w"), F.col("h"), F.col("w_pt"), F.col("h_pt"), dpi, cap))
    out = out.withColumn("downsample", F.coalesce(d.wants_downsample(F.col("scale"), F.col("bpc")), F.lit(False)))
    side = lambda x: F.when(F.col("downsample"), d.target_side(F.col(x), F.col("scale"))).otherwise(F.col(x).cast("long"))
    kept = (F.col("bpc") == 1) & ~F.col("downsample")
    action = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.coalesce(kept, F.lit(False)), "kept").otherwise("pending")
    return out.withColumn("target_w", side("w")).withColumn("target_h", side("h")).withColumn("action", action)


def batched(df: DataFrame, scope: list[str], order: str, size: int) -> DataFrame:
    """df with batch: the number of the group of `size` rows that a row belongs to in its scope's order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1) / size))


TRANSFORMED = "codec string, new_w int, new_h int, new_bpc int, new_space string, new_filter string, new_parms string, new_data binary, new_mask binary, error string"


def transformed(plan: DataFrame) -> DataFrame:
    """path, image_id and the columns of TRANSFORMED for plan(path, image_id, info, content, mask_content, target_w,
    target_h, quality): decoded, classed, resized and encoded. One image at a time is held."""
    from ..media.images import Picture, codec, pixels
    from ..media.images import transformed as encoded

    def picture(info: dict, data: bytes, mask: bytes | None) -> Picture:
        if not info or info.get("space") is None or not info.get("w") or not info.get("h"):
            raise ValueError("no decoder for this colour space")
        soft = picture(info["mask"], mask, None) if info.get("mask") and mask is not None else None
        return Picture(info["w"], info["h"], info["bpc"], info["space"], data, info["filters"], info["parms"], info["decode"], bytes.fromhex(info["palette"]), info["base"] or "RGB", soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]
        names = ["path", "image_id", *(x.split()[0] for x in TRANSFORMED.split(", "))]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {x: batch.column(x)[k].as_py() for x in batch.schema.names}
                try:
                    p = picture(json.loads(row["info"]), row["content"], row["mask_content"])
                    x = pixels(p)
                    kind = codec(p, x)
                    c = encoded(x, kind, int(row["target_w"]), int(row["target_h"]), float(row["quality"]))
                    out = (kind, c.w, c.h, c.bpc, c.space, c.filter, json.dumps(c.parms), c.data, c.mask, None)
                except (ValueError, TypeError, KeyError, IndexError, ArithmeticError, RecursionError, MemoryError, zlib.error) as e:
                    out = (*[None] * 9, f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row["path"], row["image_id"], *out), kinds, strict=True)], names=names)

    return plan.select("path", "image_id", "info", "content", "mask_content", "target_w", "target_h", "quality").mapInArrow(run, f"path string, image_id int, {TRANSFORMED}")


def outcomes(plan: DataFrame, made: DataFrame, s: Settings) -> DataFrame:
    """plan with what was made of its images, and outcome: skipped (also where an image can't be decoded), unchanged, or
    recompressed if the new bytes are enough fewer. A soft mask's bytes don't count."""
    met = plan.join(made, ["path", "image_id"], "left")
    enough = F.coalesce(d.accept_smaller(F.octet_length("new_data"), F.col("encoded_len"), s), F.lit(False))
    kind = F.when((F.col("action") == "skipped") | F.col("error").isNotNull(), "skipped").when(enough, "recompressed").otherwise("unchanged")
    return met.withColumn("outcome", kind)


def counters(found: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The keys with images_inspected, images_downsampled, images_recompressed, images_unchanged from outcome and
    downsample. Skipped images count as unchanged, not as inspected."""
    seen, done = F.col("outcome") != "skipped", F.col("outcome") == "recompressed"
    flags = {"images_inspected": seen, "images_downsampled": done & F.col("downsample"), "images_recompressed": done, "images_unchanged": ~done}
    return found.groupBy(*keys).agg(*[F.count_if(v).cast("int").alias(k) for k, v in flags.items()])


def fingerprinted(images: DataFrame) -> DataFrame:
    """images(w, h, bpc, color_space, filters, content, mask, ...) with their fingerprint instead of their bytes."""
    own = dedup.image_fingerprint(F.col("w"), F.col("h"), F.col("bpc"), F.col("color_space"), F.col("filters"), F.col("content"), F.col("mask"))
    return images.withColumn("fingerprint", own).drop("content", "mask")


def merged(final: DataFrame, scope: tuple[str, ...] = ("path",)) -> DataFrame:
    """The scope, image_id and canonical of the images final(image_id, discovery_idx, fingerprint) whose content equals that of
    one discovered earlier in the same scope."""
    named = final.select(*scope, "image_id", "fingerprint", F.struct("discovery_idx", "image_id").alias("at"))
    found = dedup.canonical(named, "fingerprint", "at", scope)
    return found.where(F.col("canonical.image_id") != F.col("image_id")).select(*scope, "image_id", F.col("canonical.image_id").alias("canonical"))

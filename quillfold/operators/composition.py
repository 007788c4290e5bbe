"""Bytes by category and the derived shares, and the report on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d

# The categories in the report's order.
CATEGORIES = ("images", "fonts", "vectors", "other")


def by_category(df: DataFrame, category: str, size: Column) -> DataFrame:
    """category, bytes, items, percent; negative sizes count as 0. The total is a window over the few category rows."""
    per = df.groupBy(category).agg(F.sum(F.greatest(F.lit(0), size)).alias("bytes"), F.count(F.lit(1)).alias("items"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)))
    return per.select(category, "bytes", "items", d.rounded_percent(F.col("bytes"), total).alias("percent"))


def categorised(streams: DataFrame, fonts: DataFrame, contents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """streams(keys, subtype, pattern, ...) with category. A stream that fonts or contents name by the keys belongs there."""
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    met = streams.join(flag(fonts, "of_font"), list(keys), "left").join(flag(contents, "of_page"), list(keys), "left")
    no = F.lit(False)
    return met.withColumn("category", d.stream_category(F.coalesce("of_font", no), F.coalesce("of_page", no), F.col("subtype"), F.col("pattern"))).drop("of_font", "of_page")


def totals(streams: DataFrame, fonts: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """One row for each document: bytes, percent and count of each category, total, addressable (fonts and vectors),
    embedded and subsettable fonts, and the note. streams has category and size, fonts has name, program and font_bytes."""
    length = F.greatest(F.lit(0).cast("long"), F.col(size).cast("long"))
    zero = F.lit(0).cast("long")
    per = streams.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, length)), zero).alias(f"{c}_bytes") for c in CATEGORIES],
        *[F.count_if(F.col("category") == c).alias(f"{c}_count") for c in CATEGORIES], F.coalesce(F.sum(length), zero).alias("total_bytes"),
    )
    can = d.subsettable(F.col("program"), F.col("name"))
    of = fonts.groupBy(*keys).agg(F.count(F.lit(1)).alias("embedded_fonts"), F.count_if(can).alias("subsettable_fonts"), F.coalesce(F.sum(F.when(can, F.greatest(zero, F.col("font_bytes")))), zero).alias("subsettable_bytes"))
    met = per.join(of, list(keys), "left").na.fill(0, ["embedded_fonts", "subsettable_fonts", "subsettable_bytes"]).withColumn("addressable_bytes", F.col("fonts_bytes") + F.col("vectors_bytes"))
    whole = F.col("total_bytes")
    met = met.withColumns({f"{c}_percent": d.rounded_percent(F.col(f"{c}_bytes"), whole) for c in (*CATEGORIES, "addressable")})
    return met.withColumn("note", d.note(whole, F.col("images_bytes"), F.col("addressable_bytes"), F.col("subsettable_bytes")))


# Keys of the report's line, and the columns they show.
LINE = (
    ("pages", "pages"), ("streamBytes", "total_bytes"), ("imageBytes", "images_bytes"), ("imagePercent", "images_percent"), ("fontBytes", "fonts_bytes"), ("fontPercent", "fonts_percent"),
    ("vectorBytes", "vectors_bytes"), ("vectorPercent", "vectors_percent"), ("otherBytes", "other_bytes"), ("otherPercent", "other_percent"), ("addressableBytes", "addressable_bytes"),
    ("addressablePercent", "addressable_percent"), ("embeddedFonts", "embedded_fonts"), ("subsettableFonts", "subsettable_fonts"), ("subsettableFontBytes", "subsettable_bytes"),
)


def line(request: Column) -> Column:
    """The report as one line of key=value over the columns of totals() and pages."""
    parts = [F.concat(F.lit("requestId="), request), F.lit("action=composition"), *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in LINE]]
    return F.concat_ws(" ", *parts, F.concat(F.lit('note="'), F.col("note"), F.lit('"')))


def report(raw: DataFrame) -> DataFrame:
    """path, pages and the columns of totals() for PDF files raw(path, length, content)."""
    from ..sources import pdf

    objects, edges = pdf.objects(raw), pdf.edges(raw)
    streams = objects.where("kind = 'stream' AND type IS DISTINCT FROM 'XRef' AND type IS DISTINCT FROM 'ObjStm'")
    streams = streams.select("path", "obj_num", "subtype", (F.coalesce(F.col("type"), F.lit("")) == "Pattern").alias("pattern"), F.col("stream_len").alias("size"))
    programs = pdf.fonts(raw).where("program_id IS NOT NULL").groupBy("path", F.col("program_id").alias("obj_num")).agg(F.min_by("name", "font_id").alias("name"), F.first("program").alias("program"))
    owners = objects.where("type = 'Page'").select("path", F.col("obj_num").alias("src"))
    direct = edges.where("key = 'Contents'").join(owners, ["path", "src"])
    arrays = objects.where("kind = 'array'").select("path", F.col("obj_num").alias("dst"))
    listed = direct.join(arrays, ["path", "dst"]).select("path", F.col("dst").alias("src")).join(edges.select("path", "src", "dst"), ["path", "src"])
    contents = direct.select("path", F.col("dst").alias("obj_num")).unionByName(listed.select("path", F.col("dst").alias("obj_num")))
    sized = programs.join(streams.select("path", "obj_num", F.col("size").alias("font_bytes")), ["path", "obj_num"])
    sorted_ = categorised(streams, programs, contents, ["path", "obj_num"])
    return pdf.documents(raw).where("error IS NULL").select("path", "pages").join(totals(sorted_, sized, ["path"]), "path")

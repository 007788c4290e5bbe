"""Decision rules as column functions: the same code serves tables, streams and stand-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings

# Thresholds of the downsampling rules and of the photographic test.
BITONAL_SCALE, DOWNSAMPLE_SCALE, COLOURS = 0.5, 1.0 / 1.1, 256


def as_float(x: float) -> Column:
    """A setting kept in single precision, widened: 0.10 is 0.10000000149..., and comparisons depend on it."""
    return F.lit(x).cast("float").cast("double")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def skip_reason(stencil: Column, w: Column, h: Column, size: Column, components: Column, cmyk: Column, s: Settings) -> Column:
    """First failing gate of an image, or null."""
    four = (components == 4) | F.coalesce(cmyk, F.lit(False))
    bomb = F.lit(s.max_decode_pixels > 0) & (w.cast("long") * h.cast("long") > s.max_decode_pixels)
    return (
        F.when(stencil, "stencil").when((w < s.min_dimension) | (h < s.min_dimension), "dimension").when(size < s.min_byte_size, "bytes")
        .when(four & F.lit(not s.recompress_cmyk), "cmyk").when(bomb, "pixels")
    )


def scale(w: Column, h: Column, w_pt: Column, h_pt: Column, dpi: Column | int, cap: Column | int) -> Column:
    """Largest scale that keeps the effective resolution and the dimension cap; never above 1."""
    dpi, cap = (x if isinstance(x, Column) else F.lit(x) for x in (dpi, cap))
    w, h = w.cast("double"), h.cast("double")
    drawn = F.when((w_pt > 0) & (h_pt > 0), F.least(w_pt.cast("double") / 72.0 * dpi / w, h_pt.cast("double") / 72.0 * dpi / h)).otherwise(1.0)
    capped = F.when(cap > 0, F.least(drawn, cap / w, cap / h)).otherwise(drawn)
    return F.least(capped, F.lit(1.0))


def wants_downsample(s: Column, bits: Column) -> Column:
    return F.when(bits == 1, s < BITONAL_SCALE).otherwise(s < DOWNSAMPLE_SCALE)


def target_side(side: Column, s: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_up(side * s).cast("long"))


def codec(bits: Column, transparent: Column, grey: Column) -> Column:
    return F.when(bits == 1, "BITONAL").when(transparent, "TRANSPARENT").when(grey, "GRAYSCALE").otherwise("COLOR")


def accept_smaller(candidate: Column, original: Column, s: Settings) -> Column:
    """Per-image guard."""
    enough = candidate <= original * (F.lit(1.0) - as_float(s.min_reduction_ratio))
    return enough | (F.lit(s.larger_result_policy == "USE_SMALLEST") & (candidate < original))


def keeps_original(candidate: Column, original: Column, s: Settings) -> Column:
    """Whole-document guard."""
    if s.larger_result_policy == "USE_SMALLEST":
        return candidate >= original
    return candidate > original * (F.lit(1.0) - as_float(s.min_reduction_ratio))


def saved_percent(saved: Column, original: Column) -> Column:
    return F.when(original == 0, 0.0).otherwise(saved * 100.0 / original)


def rounded_percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(half_up(part * 10000.0 / total) / F.lit(100.0))


def profile(dpi: Column, quality: Column) -> Column:
    return F.concat(F.lit("dpi="), dpi.cast("int").cast("string"), F.lit(",q="), quality.cast("float").cast("string"))


def font_program(file2: Column, file3: Column, file1: Column) -> Column:
    return F.when(file2.isNotNull(), "TrueType").when(file3.isNotNull(), "CFF").when(file1.isNotNull(), "Type1")


def font_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("(unnamed)"))


def is_tagged(name: Column) -> Column:
    """Whether a font's name carries the tag of a subset."""
    return font_name(name).rlike(r"^[A-Z]{6}[+].+$")


def subsettable(program: Column, name: Column) -> Column:
    return F.coalesce(program == "TrueType", F.lit(False)) & ~is_tagged(name)


def stream_category(font: Column, content: Column, subtype: Column, pattern: Column) -> Column:
    return F.when(font, "fonts").when(content, "vectors").when(subtype == "Image", "images").when((subtype == "Form") | F.coalesce(pattern, F.lit(False)), "vectors").otherwise("other")


# The remarks of the composition report.
EMPTY_NOTE = "No stored streams found."
FONT_NOTE = ("Font subsetting could target ~", "% of stream bytes (", " bytes of embedded TrueType fonts are not yet subset).")
IMAGE_NOTE = ("Images are ", "% of stream bytes; image optimization is where the savings are, vector/font optimization would move only ~", "%.")
VECTOR_NOTE = ("Fonts and vector/text content are ", "% of stream bytes, but the embedded fonts are already subset, so a font pass would not help much.")
MIXED_NOTE = ("Images ", "%, fonts+vectors ", "% of stream bytes.")


def whole_percent(part: Column, total: Column) -> Column:
    """A share in percent as a whole number, rounded half up; null if the total is 0."""
    return F.when(total != 0, half_up(part * 100.0 / total).cast("long"))


def note(total: Column, images: Column, addressable: Column, subsettable: Column) -> Column:
    """The report's remark from bytes. Shares are rounded before they are compared."""
    image, other = whole_percent(images, total), whole_percent(addressable, total)

    def joined(texts, *values):
        parts = [F.lit(texts[0])]
        for value, after in zip(values, texts[1:], strict=True):
            parts += [value.cast("string"), F.lit(after)]
        return F.concat(*parts)
    return (
        F.when(total == 0, EMPTY_NOTE).when(subsettable > 0, joined(FONT_NOTE, whole_percent(subsettable, total), subsettable))
        .when(image >= 80, joined(IMAGE_NOTE, image, other)).when(other >= 40, joined(VECTOR_NOTE, other)).otherwise(joined(MIXED_NOTE, image, other))
    )


def extent(scaled: Column, sheared: Column) -> Column:
    return F.hypot(scaled, sheared).cast("float")


def subset_tag(index: Column) -> Column:
    """Six letters, base 26, most significant first."""
    letters = [F.chr(F.lit(65) + F.floor(index / F.lit(26**k)).cast("long") % 26) for k in reversed(range(6))]
    return F.concat(*letters)


def short_logger(name: Column) -> Column:
    tail = F.regexp_extract(name, r"([^.]+)$", 1)
    return F.when(name.isNull(), "").when(tail == "", name).otherwise(tail)


def resume_offset(header: Column, query: Column) -> Column:
    given = F.when(F.trim(header) != "", F.trim(header)).otherwise(F.trim(query))
    return F.coalesce(given.try_cast("long"), F.lit(0).cast("long"))


#: HTTP status of each error class.
STATUS = {"InvalidPdf": 422, "InvalidOption": 400, "MissingPart": 400, "JobNotFound": 404, "JobNotReady": 409, "TooManyJobs": 429, "NoResource": 404, "Autostart": 500, "Compression": 500}


def error_status(kind: Column) -> Column:
    out = F.lit(500)
    for name, code in STATUS.items():
        out = F.when(kind == name, code).otherwise(out)
    return F.when(kind.isNull() | (kind != "AsyncEnded"), out)

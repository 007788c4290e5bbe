"""Embedded fonts: the glyphs in use, which fonts may be cut down to them, and what that gives.

Usage, reference counts and guards are tables and column rules. The programs themselves are cut in Python, a font a row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d


def usage(glyphs: DataFrame, keys: Sequence[str] = ("path", "font_id"), cid: str = "cid", gid: str = "gid", code: str = "code", seq: str = "seq") -> DataFrame:
    """The keys with gids and codes (sorted, distinct), cid_to_gid (cid and the glyph it was last shown with, sorted) and
    max_cid."""
    last = glyphs.groupBy(*keys, F.col(cid).alias("cid")).agg(F.max_by(gid, seq).alias("gid"), F.collect_set(gid).alias("g"), F.collect_set(code).alias("c"))
    pair = F.when(F.col("cid").isNotNull(), F.struct("cid", "gid"))
    return last.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("gids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("codes"),
        F.array_sort(F.collect_list(pair)).alias("cid_to_gid"), F.max("cid").alias("max_cid"),
    )


def reference_counts(owners: DataFrame, program: str = "program_id", owner: str = "descriptor", scope: Sequence[str] = ("path",)) -> DataFrame:
    """scope, program, n: how many owners name each program."""
    return owners.where(F.col(program).isNotNull()).groupBy(*scope, program).agg(F.count_distinct(owner).alias("n"))


def owned_once(programs: DataFrame, counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """programs with owned_once: whether exactly one owner names it; none is not one."""
    return programs.join(counts, list(on), "left").withColumn("owned_once", F.coalesce(F.col("n"), F.lit(0)) == 1).drop("n")


def coverage(used: DataFrame, kept: DataFrame, font: str, glyph: str) -> DataFrame:
    """font, covered, missing: whether all used glyphs are among the kept ones. Both tables are of distinct rows."""
    missing = used.join(kept, glyph, "left_anti").groupBy(font).agg(F.count(F.lit(1)).alias("missing"))
    return used.select(font).distinct().join(missing, font, "left").select(font, F.col("missing").isNull().alias("covered"), F.coalesce("missing", F.lit(0)).alias("missing"))


def agreement(codes: DataFrame, font: str, same: Column) -> DataFrame:
    """font, codes, agreeing, all_agree over a row for each code; `same` says that both ways lead to one glyph."""
    return codes.groupBy(font).agg(F.count(F.lit(1)).alias("codes"), F.count_if(same).alias("agreeing"), F.bool_and(same).alias("all_agree"))


def eligible(fonts: DataFrame) -> DataFrame:
    """Fonts of the kinds that can be cut: TrueType programs of composite fonts, or of simple ones that are not symbolic."""
    return fonts.where((F.col("program") == "TrueType") & ((F.col("kind") == "composite") | ((F.col("kind") == "simple") & F.col("embedded") & ~F.col("symbolic"))))


def tagged(fonts: DataFrame, scope: Sequence[str] = ("path",), order: Sequence[str] = ("kind", "font_id"), name: str = "tag") -> DataFrame:
    """fonts with a six-letter tag by their place within the scope, composite fonts first."""
    return fonts.withColumn(name, d.subset_tag(F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1))


def without_tag(font: Column) -> Column:
    return F.when(d.is_tagged(font), F.substring(font, 8, 1_000_000)).otherwise(font)


def refusal(fonts: DataFrame) -> Column:
    """Why a font stays as it is, or null: guards in their order, over owned_once, base_name, n_glyphs, survived, subset_len
    and compare_len."""
    return (
        F.when(~F.col("owned_once"), "shared").when(F.col("base_name").isNull(), "unnamed").when(F.col("n_glyphs") < 1, "unused")
        .when(F.col("error").isNotNull(), F.col("error")).when(~F.col("survived"), "lost").when(F.col("subset_len") >= F.col("compare_len"), "larger")
    )


def saved(cut: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """The keys with fonts_subset and font_bytes_saved of cut(refusal, compare_len, subset_len)."""
    gain = F.when(F.col("refusal").isNull(), F.col("compare_len") - F.col("subset_len"))
    return cut.groupBy(*keys).agg(F.count_if(gain > 0).cast("int").alias("fonts_subset"), F.coalesce(F.sum(F.when(gain > 0, gain)), F.lit(0)).alias("font_bytes_saved"))


# Names of the ASCII signs in fonts' encodings.
SIGNS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(),
    " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", strict=True)) | dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))


def character(name: str) -> str | None:
    """What a glyph's name stands for, where that is certain."""
    if len(name) == 1 and name.isalpha() and name.isascii():
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    return SIGNS.get(name)


def encoding_of(pdf, head: dict) -> dict[int, str | None]:
    """Code to character of a simple font that is not symbolic, by its encoding; null where a name is unknown."""
    found = pdf.get(head.get("Encoding"))
    base = pdf.get(found.get("BaseEncoding")) if isinstance(found, dict) else found
    page = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(str(base), "ascii")
    out = {c: bytes([c]).decode(page, "ignore") or None for c in range(32, 256)}
    at = 0
    for x in pdf.get(found.get("Differences")) or [] if isinstance(found, dict) else []:
        if isinstance(x, int):
            at = x
        else:
            out[at] = character(str(x))
            at += 1
    return out


CHARACTERS = re.compile(rb"begin(bfchar|bfrange)(.*?)end(?:bfchar|bfrange)", re.DOTALL)
HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>|\[([^\]]*)\]")


def named_characters(body: bytes) -> dict[int, str]:
    """Code to text of a font's own character map; codes of one byte or two."""
    read = lambda x: bytes.fromhex(re.sub(rb"\s", b"", x).decode())
    text = lambda x: x.decode("utf-16-be", "ignore")
    out: dict[int, str] = {}
    for kind, rows in CHARACTERS.findall(body):
        marks = HEX.findall(rows)
        if kind == b"bfchar":
            out |= {int.from_bytes(read(a[0]), "big"): text(read(b[0])) for a, b in zip(marks[::2], marks[1::2], strict=False)}
            continue
        for a, b, c in zip(marks[::3], marks[1::3], marks[2::3], strict=False):
            lo, hi = (int.from_bytes(read(x[0]), "big") for x in (a, b))
            listed = [read(x[0]) for x in HEX.findall(c[1])]
            first = read(c[0])
            for k in range(min(hi - lo + 1, 65536)):
                value = (listed[k] if k < len(listed) else b"") if c[1] else first[:-2] + ((int.from_bytes(first[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")
                out[lo + k] = text(value)
    return out


CUT = "font_id int, subset binary, cid_map binary, subset_len long, survived boolean, error string"


def cut(usage_rows: DataFrame, raw: DataFrame) -> DataFrame:
    """path and the columns of CUT for the fonts of usage_rows(path, font_id, program_id, kind, gids, codes, cid_to_gid):
    the program of the glyphs in use and, for composite fonts, the new map from character ids. Files are parsed once each."""
    from ..media import truetype
    from ..sources import pdf as source

    def one(pdf, f: dict) -> tuple:
        program = truetype.parse(pdf.decoded(pdf.get(source.Ref(f["program_id"]))))
        if f["kind"] == "composite":
            data, new = truetype.subset(program, set(f["gids"]))
            pairs = [(x["cid"], new.get(x["gid"])) for x in f["cid_to_gid"]]
            if any(g is None for _, g in pairs):
                return None, None, len(data), False, None
            table = bytearray(2 * (max((c for c, _ in pairs), default=0) + 1))
            for c, g in pairs:
                table[2 * c : 2 * c + 2] = g.to_bytes(2, "big")
            return data, bytes(table), len(data), True, None
        characters = truetype.unicode_map(program)
        if characters is None:
            return None, None, None, False, "no character map"
        head = pdf.head(source.Ref(f["font_id"]))
        drawn, own = encoding_of(pdf, head), pdf.get(head.get("ToUnicode"))
        means = named_characters(pdf.decoded(own)) if isinstance(own, source.Stream) else {}
        pairs = {}
        for code in f["codes"]:
            ch, text = drawn.get(code), means.get(code) or drawn.get(code)
            if not ch or not text or ord(ch) not in characters:
                return None, None, None, False, "a code without a character"
            if characters.get(ord(text[0])) != characters[ord(ch)]:
                return None, None, None, False, "text and glyph disagree"
            pairs[ord(ch)] = characters[ord(ch)]
        data, _ = truetype.subset(program, set(pairs.values()), pairs)
        return data, None, len(data), True, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column("path")[k].as_py()
                rows = []
                try:
                    pdf = source.parse(batch.column("content")[k].as_py() or b"")
                except (ValueError, TypeError, RecursionError, zlib.error):
                    continue
                for f in batch.column("f")[k].as_py():
                    try:
                        rows.append((path, f["font_id"], *one(pdf, f)))
                    except (ValueError, TypeError, KeyError, AttributeError, IndexError, zlib.error) as e:
                        rows.append((path, f["font_id"], None, None, None, False, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", *(x.split()[0] for x in CUT.split(", "))])

    per = usage_rows.groupBy("path").agg(F.collect_list(F.struct("font_id", "program_id", "kind", "gids", "codes", "cid_to_gid")).alias("f"))
    return raw.select("path", "content").join(per, "path").mapInArrow(run, f"path string, {CUT}")


def plan(fonts: DataFrame, glyphs: DataFrame, raw: DataFrame) -> DataFrame:
    """path, font_id, type0_id, descriptor, program_id, kind, subset, cid_map, new_name, compare_len, subset_len and refusal
    of every font that can be cut and is shown. A document whose text can't all be read has none."""
    broken = glyphs.where("error IS NOT NULL").select("path").distinct()
    used = usage(glyphs.where("error IS NULL")).join(broken, "path", "left_anti")
    rows = owned_once(fonts, reference_counts(fonts), ["path", "program_id"])
    rows = tagged(eligible(rows).join(used, ["path", "font_id"]))
    glyph = F.when(F.col("kind") == "composite", F.size(F.array_remove("gids", 0))).otherwise(F.size("codes"))
    rows = rows.withColumn("base_name", without_tag(F.col("name"))).withColumn("n_glyphs", glyph).withColumn("compare_len", F.when(F.col("length1") > 0, F.col("length1")).otherwise(F.col("stored_len")))
    open_ = rows.where("owned_once AND base_name IS NOT NULL AND n_glyphs > 0")
    met = rows.join(cut(open_, raw), ["path", "font_id"], "left")
    met = met.withColumn("refusal", refusal(met)).withColumn("new_name", F.concat("tag", F.lit("+"), "base_name"))
    return met.select("path", "font_id", "type0_id", "descriptor", "program_id", "kind", "subset", "cid_map", "new_name", "compare_len", "subset_len", "refusal")

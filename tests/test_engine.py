"""Whole files through the engine: sizes, counters, policies and what the written files hold."""

import os

import numpy as np
import pytest

from quillfold import engine
from quillfold.config import InvalidOption, Settings
from quillfold.media import images as media
from quillfold.media import raster, truetype
from quillfold.operators import composition, fonts
from quillfold.sources import pdf
from quillfold.streaming import uploads
from tests.made import PROFILE, document, image, lettered, made, photo, stream

FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSerif.ttf"
BIG = photo(800, 600)
BITS = (np.random.default_rng(4).random((500, 400)) < 0.8).astype(np.uint8)


def cases() -> dict[str, bytes]:
    jpg, noise = image(BIG, "jpeg"), lambda n: image(np.random.default_rng(n).integers(0, 256, (n, n, 3)).astype(np.uint8), "flate")
    profile = {30: stream("/N 3", PROFILE), 31: stream("/N 3", PROFILE), 32: b"[/ICCBased 30 0 R]", 33: b"[/ICCBased 31 0 R]"}
    out = {
        "scan": document([(jpg, 200, 150)]), "equal": document([(image(photo(320, 240), "jpeg"), 320, 240)] * 6), "tiny": document([(noise(15), 10, 10)]), "edge": document([(noise(60), 100, 100)]),
        "optimal": document([(image(photo(300, 200), "low"), 590, 400)]), "bits": document([(image(BITS, "fax"), 400, 500)]), "large_bits": document([(image(np.kron(BITS, np.ones((4, 4), np.uint8)), "bits"), 90, 110)]),
        "poison": document([(image(BIG, "poison"), 200, 150), (jpg, 200, 150)]), "junk": b"not a file", "none": None,
        "profiles": document([], profile, page="/CS << /A 32 0 R /B 33 0 R >>"),
        "private": document([(image(photo(300, 200), "jpeg"), 590, 400)], {40: stream("/Type /Metadata", b"m" * 5000), 41: b"<< /Title (a) >>"}, trailer="/Root 1 0 R /Info 41 0 R", catalog="/Metadata 40 0 R /PieceInfo << /X 1 >>"),
        "unreadable": document([(jpg, 200, 150)], {11: b"<< /Subtype /Bogus >>"}, page="/Annots [50 0 R]") + b"\n50 0 obj\n<< /AP << /N << /On 51 0 R >> >> >>\nendobj\n51 0 obj\n" + stream("/Subtype /Form /Resources << /XObject << /Q 11 0 R /P 10 0 R >> >>", b"") + b"\nendobj\n",
    }
    if os.path.exists(FONT):
        program = open(FONT, "rb").read()
        glyphs = truetype.unicode_map(truetype.parse(program))
        out |= {"composite": lettered(program, "Hello wörld", True, glyphs), "simple": lettered(program, "Hello wörld", False, glyphs), "tagged": lettered(program, "Hi", True, glyphs, "ABCDEF+DejaVuSerif")}
    return out


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(k, len(v or b""), v) for k, v in cases().items()]
    return spark.createDataFrame(rows, "path string, length long, content binary").repartition(4)


@pytest.fixture(scope="module")
def done(raw):
    return {r.request_id: r for r in engine.compress(raw).collect()}


def test_invariants(raw, done):
    assert set(done) == set(cases())
    for name, r in done.items():
        assert r.images_downsampled <= r.images_recompressed <= r.images_inspected and r.saved_bytes == r.original_bytes - r.compressed_bytes
        assert (r.compressed_pdf is None) == (name == "none") and len(r.compressed_pdf or b"") == r.compressed_bytes and r.profile == "dpi=150,q=0.75"
        assert r.returned_original == (r.compressed_pdf == cases()[name])
    assert done["junk"].error and done["none"].error and done["junk"].returned_original


def test_large_images_shrink(done):
    r = done["scan"]
    assert (r.images_inspected, r.images_downsampled, r.images_recompressed, r.images_unchanged, r.page_count) == (1, 1, 1, 0, 1)
    assert not r.returned_original and r.saved_percent > 50
    parsed = pdf.parse(r.compressed_pdf)
    (x,) = [x for x in parsed.objects.values() if isinstance(x, pdf.Stream) and x.head.get("Subtype") == "Image"]
    assert (x.head["Width"], x.head["Height"], x.head["Filter"]) == (417, 312, "DCTDecode")
    got = media.pixels(media.Picture(417, 312, 8, "RGB", x.raw, ["DCTDecode"], [{}]))
    assert raster.likeness(raster.resize(BIG, 417, 312), got) > 0.7


def test_small_and_optimal_images_stay(done):
    assert (done["tiny"].images_inspected, done["tiny"].images_unchanged, done["tiny"].images_recompressed) == (0, 1, 0)
    assert done["edge"].images_inspected == 1 and done["optimal"].returned_original
    assert (done["bits"].images_inspected, done["bits"].images_unchanged) == (1, 1)


def test_bitonal_images_become_fax(done):
    r = done["large_bits"]
    assert r.images_downsampled == 1 and b"CCITTFaxDecode" in r.compressed_pdf
    parsed = pdf.parse(r.compressed_pdf)
    (x,) = [x for x in parsed.objects.values() if isinstance(x, pdf.Stream) and x.head.get("Subtype") == "Image"]
    w, h = x.head["Width"], x.head["Height"]
    got = media.pixels(media.Picture(w, h, 1, "Gray", x.raw, ["CCITTFaxDecode"], parsed.parms(x.head)))
    want = raster.threshold(raster.resize(np.kron(BITS, np.ones((4, 4), np.uint8)) * 255, w, h))
    assert (got == want).all()


def test_an_image_without_decoder_passes(done):
    r = done["poison"]
    assert (r.images_inspected, r.images_recompressed, r.images_unchanged) == (1, 1, 1) and b"JPXDecode" in r.compressed_pdf
    assert done["unreadable"].images_inspected == 1


def images_in(data: bytes) -> int:
    return sum(isinstance(x, pdf.Stream) and x.head.get("Subtype") == "Image" for x in pdf.parse(data).objects.values())


def test_equal_images_merge(raw, done):
    assert images_in(done["equal"].compressed_pdf) == 1 and not done["equal"].returned_original
    off = engine.compress(raw.where("path = 'equal'"), Settings(deduplicate_images=False, larger_result_policy="USE_SMALLEST", min_reduction_ratio=0.0)).first()
    assert images_in(off.compressed_pdf) == 6


def test_equal_profiles_merge(done):
    parsed = pdf.parse(done["profiles"].compressed_pdf)
    assert sum(isinstance(x, pdf.Stream) and x.head.get("N") == 3 for x in parsed.objects.values()) == 1 and done["profiles"].saved_bytes > 9000


def test_stripping(raw, done):
    assert b"/Metadata" in done["private"].compressed_pdf
    s = Settings(strip_metadata=True, strip_private_data=True, larger_result_policy="USE_SMALLEST", min_reduction_ratio=0.0)
    out = engine.compress(raw.where("path = 'private'"), s).first()
    assert not out.returned_original and not any(x in out.compressed_pdf for x in (b"Metadata", b"PieceInfo", b"/Info", b"mmm"))


@pytest.mark.skipif(not os.path.exists(FONT), reason="no font")
def test_fonts_are_cut(done):
    program = truetype.parse(open(FONT, "rb").read())
    glyphs = truetype.unicode_map(program)
    for name in ("composite", "simple", "tagged"):
        r = done[name]
        parsed = pdf.parse(r.compressed_pdf)
        assert r.fonts_subset == 1 and r.saved_percent > 90 and b"+DejaVuSerif" in r.compressed_pdf and b"ABCDEF" not in r.compressed_pdf
        heads = [x for x in parsed.objects.values() if isinstance(x, dict)]
        descriptor = next(x for x in heads if x.get("Type") == "FontDescriptor")
        own = truetype.parse(parsed.decoded(parsed.get(descriptor["FontFile2"])))
        for c in "Hi" if name == "tagged" else "Hello wörld":
            if name == "simple":
                new = truetype.unicode_map(own)[ord(c)]
            else:
                cid = next(x for x in heads if x.get("Subtype") == "CIDFontType2")
                table = parsed.decoded(parsed.get(cid["CIDToGIDMap"]))
                new = int.from_bytes(table[2 * glyphs[ord(c)] :][:2], "big")
            old = program.glyph(glyphs[ord(c)])
            assert new and (truetype.parts(old) or own.glyph(new).rstrip(b"\0") == old.rstrip(b"\0"))


def test_character_maps():
    body = b"1 beginbfchar <41> <00420043> endbfchar 2 beginbfrange <20> <22> <0041> <30> <31> [<0061> <0062>] endbfrange"
    assert fonts.named_characters(body) == {0x41: "BC", 0x20: "A", 0x21: "B", 0x22: "C", 0x30: "a", 0x31: "b"}


def test_uploads_become_jobs(spark, tmp_path):
    landing, service = tmp_path / "landing", uploads.Service(spark, str(tmp_path / "service"), most_bytes=300_000)
    landing.mkdir()
    for name in ("scan", "junk", "tiny"):
        (landing / f"{name}.pdf").write_bytes(cases()[name])
    (landing / "large.pdf").write_bytes(b"x" * 400_000)
    service.most_bytes = max(300_000, len(cases()["scan"]) + 1) if len(cases()["scan"]) < 400_000 else service.most_bytes
    service.start(str(landing)).awaitTermination()
    service.start(str(landing)).awaitTermination()  # nothing new
    got = {r.filename: r for r in service.jobs().collect()}
    assert {k: (r.status, r.error) for k, r in got.items()} == {"scan.pdf": ("SUCCEEDED", None), "junk.pdf": ("FAILED", "ValueError"), "tiny.pdf": ("SUCCEEDED", None), "large.pdf": ("FAILED", "TooLarge")}
    assert service.result(got["scan.pdf"].job_id).first().images_downsampled == 1
    views = {r.job_id: r.view for r in service.views().collect()}
    assert '"imagesRecompressed":1' in views[got["scan.pdf"].job_id] and '"error":"TooLarge"' in views[got["large.pdf"].job_id]
    service.close()
    assert not (tmp_path / "service").exists()


def test_a_second_pass_changes_little(spark, done):
    rows = [(k, r.compressed_bytes, r.compressed_pdf) for k, r in done.items() if k in ("scan", "equal", "large_bits")]
    again = engine.compress(spark.createDataFrame(rows, "path string, length long, content binary")).collect()
    for r in again:
        assert r.images_downsampled == 0 and r.compressed_bytes <= done[r.request_id].compressed_bytes * 1.02


def test_request_options(spark, raw):
    options = spark.createDataFrame([("scan", 72, 100)], "path string, target_dpi int, max_image_dimension int")
    r = engine.compress(raw.where("path IN ('scan', 'optimal')"), options=options).orderBy("request_id").collect()
    assert [x.profile for x in r] == ["dpi=150,q=0.75", "dpi=72,q=0.75"]
    assert b"/Width 100" in r[1].compressed_pdf
    with pytest.raises(InvalidOption):
        Settings(target_dpi=0)


def test_bomb_guard(raw):
    r = engine.compress(raw.where("path = 'scan'"), Settings(max_decode_pixels=1000)).first()
    assert r.images_inspected == 0 and r.returned_original


def test_headers(raw):
    r = engine.compress(raw.where("path = 'tiny'")).select(engine.headers().alias("h")).first().h
    assert len(r) == 13 and r["X-Profile"] == "dpi=150,q=0.75" and r["X-Returned-Original"] == "true"


def test_composition(raw):
    rows = {r.path: r for r in composition.report(raw).select("*", composition.line(composition.F.col("path")).alias("line")).collect()}
    assert "junk" not in rows and rows["scan"].images_percent > 95 and rows["scan"].note.startswith("Images are ") and "action=composition pages=1" in rows["scan"].line
    if os.path.exists(FONT):
        r = rows["composite"]
        assert (r.embedded_fonts, r.subsettable_fonts) == (1, 1) and r.note.startswith("Font subsetting could target ~") and rows["tagged"].subsettable_fonts == 0 and rows["tagged"].note.startswith("Fonts and vector")


def test_empty(raw):
    assert engine.compress(raw.where("false")).count() == 0 and composition.report(raw.where("false")).count() == 0


def test_written_files_parse_alike():
    first = pdf.parse(made({1: b"<< /Type /Catalog /Pages 2 0 R /T (a\\(b\\051) /N /A#20B /X [1 -2.5 true null <0aff>] >>", 2: b"<< /Type /Pages /Kids [] >>"}))
    from quillfold.sinks import pdf as sink

    again = pdf.parse(sink.written(first))
    assert again.head(again.trailer["Root"]) == first.head(first.trailer["Root"])

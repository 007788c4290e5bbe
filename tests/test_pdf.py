"""The PDF source on hand-made files."""

import zlib

import pytest

from quillfold.sources import pdf


def stream(head: str, body: bytes) -> bytes:
    return f"<< {head} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"


def made(objects: dict[int, bytes], trailer: str = "/Root 1 0 R") -> bytes:
    return b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n".encode() + x + b"\nendobj\n" for n, x in objects.items()) + f"trailer\n<< {trailer} >>\n%%EOF".encode()


PAGE = b"q 200 0 0 100 10 20 cm /Im0 Do Q (a \\) (nested) string) Tj q 2 0 0 2 0 0 cm /Fm0 Do Q BI /W 1 /H 1 ID \x01 /Im0 Do EI "
FONT = b"<< /Type /Font /Name /A#42 >>"
INNER = f"13 0 14 {len(FONT)} ".encode() + FONT + b"[ 13 0 R 99 0 R ]"
GOOD = {
    1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 11 0 R /PieceInfo 14 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /Count 2 /MediaBox [0 0 595 842] /Resources << /XObject << /Im0 6 0 R /Fm0 7 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] /Thumb 6 0 R >>",
    4: b"<< /Type /Page /Parent 2 0 R /Rotate -90 /MediaBox [10 10 110 60] >>",
    5: stream("/Filter /FlateDecode", zlib.compress(PAGE)),
    6: stream("/Type /XObject /Subtype /Image /Width 40 /Height 30 /BitsPerComponent 8 /ColorSpace [/ICCBased 11 0 R] /Filter /DCTDecode /SMask 8 0 R", b"8 0 obj endobj 77 0 obj"),
    7: stream("/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /Resources << /XObject << /Im0 6 0 R /Fm0 7 0 R >> >>", b"3 0 0 4 0 0 cm /Im0 Do /Fm0 Do"),
    8: stream("/Subtype /Image /Width 40 /Height 30 /ImageMask true", b"x"),
    9: b"<< /Broken (no end",
    10: stream("/Type /ObjStm /N 2 /First 11 /Filter /FlateDecode", zlib.compress(INNER)),
    11: stream("/N 3", b"profile"),
}


@pytest.fixture(scope="module")
def raw(spark):
    late = made(GOOD) + b"\n4 0 obj\n<< /Type /Page /Parent 2 0 R /Rotate 180 >>\nendobj\n"
    cases = {"a": made(GOOD), "updated": late, "junk": b"not a file of this kind", "none": None, "bare": b"%PDF-1.4\n", "deep": made({1: b"[" * 100_000}), "locked": made(GOOD, "/Root 1 0 R /Encrypt 11 0 R")}
    return spark.createDataFrame([(k, len(v or b""), v) for k, v in cases.items()], "path string, length long, content binary")


def test_documents(raw):
    got = {r.path: r for r in pdf.documents(raw).collect()}
    assert len(got) == 7 and (got["a"].pages, got["a"].encrypted, got["a"].error) == (2, False, None) and got["locked"].encrypted
    assert all(got[x].error and got[x].pages is None for x in ("junk", "none", "bare", "deep"))


def test_objects(raw):
    got = {r.obj_num: r for r in pdf.objects(raw).where("path = 'a'").collect()}
    assert 77 not in got and got[8].subtype == "Image" and got[6].stream_len == 23 and got[9].error and got[9].kind is None
    assert (got[13].kind, got[13].type, got[14].kind) == ("dict", "Font", "array")


def test_edges_and_stripping(raw):
    one = raw.where("path = 'a'")
    edges = pdf.edges(one)
    assert {(r.src, r.dst, r.key) for r in edges.collect()} >= {(0, 1, "Root"), (14, 13, ""), (14, 99, ""), (6, 11, "ColorSpace"), (2, 6, "Resources/XObject/Im0")}
    left = pdf.without_private(edges, pdf.objects(one))
    gone = {(r.src, r.key) for r in edges.subtract(left).collect()}
    assert gone == {(1, "Metadata"), (1, "PieceInfo"), (3, "Thumb")}


def test_pages(raw):
    got = [tuple(r)[1:] for r in pdf.pages(raw).where("path = 'a'").orderBy("page_idx").collect()]
    assert got == [(0, 3, 595.0, 842.0, 0), (1, 4, 100.0, 50.0, 270)]
    assert pdf.pages(raw).where("path = 'updated' AND page_idx = 1").first().rotate == 180


def test_images_and_draws(raw):
    image = pdf.images(raw).where("path = 'a' AND image_id = 6").first()
    assert (image.w, image.h, image.bpc, image.color_space, image.filters, image.soft_mask, image.encoded_len, image.stencil) == (40, 30, 8, "ICCBased", "DCTDecode", 8, 23, False)
    got = [tuple(r)[1:] for r in pdf.image_draws(raw).where("path = 'a'").orderBy("page_idx", "draw_seq").collect()]
    assert got == [(0, 0, 6, 200.0, 0.0, 0.0, 100.0, None), (0, 1, 6, 6.0, 0.0, 0.0, 8.0, None)]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(made(GOOD))
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r.pages for r in pdf.documents(pdf.files(spark, str(tmp_path))).collect()] == [2]
    assert pdf.objects(pdf.files(spark, str(tmp_path), "*.none")).count() == 0

"""Small PDF files made by hand for tests."""

import zlib

import numpy as np

from quillfold.media import fax, jpeg

PROFILE = bytes(range(256)) * 40


def stream(head: str, body: bytes) -> bytes:
    return f"<< {head} /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"


def made(objects: dict[int, bytes], trailer: str = "/Root 1 0 R") -> bytes:
    return b"%PDF-1.7\n" + b"".join(f"{n} 0 obj\n".encode() + x + b"\nendobj\n" for n, x in objects.items()) + f"trailer\n<< {trailer} >>\n%%EOF".encode()


def photo(w: int, h: int, seed: int = 42) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    noise = np.random.default_rng(seed).integers(0, 60, (h, w, 3))
    return (np.stack([x * 180 // w, y * 180 // h, (x + y) * 180 // (w + h)], 2) + noise).astype(np.uint8)


def image(pixels: np.ndarray, kind: str, more: str = "") -> bytes:
    h, w = pixels.shape[:2]
    space = "/DeviceGray" if pixels.ndim == 2 else "/DeviceRGB"
    body, head = {
        "jpeg": lambda: (jpeg.encode(pixels, 0.95), f"/ColorSpace {space} /BitsPerComponent 8 /Filter /DCTDecode"),
        "low": lambda: (jpeg.encode(pixels, 0.2), f"/ColorSpace {space} /BitsPerComponent 8 /Filter /DCTDecode"),
        "flate": lambda: (zlib.compress(pixels.tobytes(), 1), f"/ColorSpace {space} /BitsPerComponent 8 /Filter /FlateDecode"),
        "bits": lambda: (np.packbits(pixels, axis=1).tobytes(), "/ColorSpace /DeviceGray /BitsPerComponent 1"),
        "fax": lambda: (fax.encode(1 - pixels), f"/ColorSpace /DeviceGray /BitsPerComponent 1 /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns {w} /Rows {h} >>"),
        "poison": lambda: (np.random.default_rng(1).bytes(9000), "/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /JPXDecode"),
    }[kind]()
    return stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} {head} {more}", body)


def document(images: list[tuple[bytes, int, int]], more: dict[int, bytes] | None = None, page: str = "", trailer: str = "/Root 1 0 R", catalog: str = "") -> bytes:
    """One A4 page with each image drawn at its size in points; images are objects from 10 on."""
    body = b" ".join(b"q %d 0 0 %d 0 0 cm /Im%d Do Q" % (w, h, k) for k, (_, w, h) in enumerate(images))
    names = " ".join(f"/Im{k} {10 + k} 0 R" for k in range(len(images)))
    objects = {
        1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>".encode(), 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /XObject << {names} >> >> {page} >>".encode(), 4: stream("", body),
    }
    return made(objects | {10 + k: x for k, (x, _, _) in enumerate(images)} | (more or {}), trailer)


def lettered(program: bytes, text: str, composite: bool, glyphs: dict[int, int], name: str = "DejaVuSerif") -> bytes:
    """A page that shows a text in an embedded TrueType font."""
    from quillfold.media import truetype

    if composite:
        shown = "".join(f"{glyphs[ord(c)]:04X}" for c in text)
        fonts = {20: f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [21 0 R] >>".encode(), 21: f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{name} /CIDToGIDMap /Identity /FontDescriptor 22 0 R >>".encode()}
    else:
        shown = text.encode("cp1252").hex()
        fonts = {20: f"<< /Type /Font /Subtype /TrueType /BaseFont /{name} /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 33 /Widths [300 300] /FontDescriptor 22 0 R >>".encode()}
    assert truetype.parse(program).glyphs
    flat = zlib.compress(program)
    objects = fonts | {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F0 20 0 R >> >> >>", 4: stream("", f"BT /F0 12 Tf 50 700 Td <{shown}> Tj ET".encode()),
        22: f"<< /Type /FontDescriptor /FontName /{name} /Flags 32 /FontFile2 23 0 R >>".encode(), 23: stream(f"/Filter /FlateDecode /Length1 {len(program)}", flat),
    }
    return made(dict(sorted(objects.items())))

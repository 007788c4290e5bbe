"""Codecs, filters and rasters: round trips and known values."""

import base64
import os
import zlib

import numpy as np
import pytest

from quillfold.media import fax, filters, images, jpeg, raster, truetype

FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSerif.ttf"
R = np.random.default_rng(7)


def test_run_codes_are_prefix_free():
    for codes in (fax.WHITE + fax.LONG, fax.BLACK + fax.LONG, list(fax.MODES)):
        assert not any(a != b and b.startswith(a) for a in codes for b in codes) and len(set(codes)) == len(codes)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
def test_fax_round_trip(share):
    for w, h in ((1, 1), (7, 3), (300, 9), (6000, 2)):
        x = (R.random((h, w)) < share).astype(np.uint8)
        assert (fax.decode(fax.encode(x), w) == x).all() and fax.decode(fax.encode(x), w).shape == x.shape


def test_fax_refuses_nonsense():
    with pytest.raises(ValueError):
        fax.decode(b"\0\1\2\3" * 9, 40, 9)


@pytest.mark.parametrize("shape", [(40, 50, 3), (17, 9), (8, 8), (1, 1, 3)])
def test_jpeg_round_trip(shape):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    smooth = np.stack([128 + 60 * np.sin(x / 9 + k) + 40 * np.cos(y / 7) for k in range(3)], 2).astype(np.uint8)
    p = smooth if len(shape) == 3 else smooth[..., 0]
    assert np.abs(jpeg.decode(jpeg.encode(p, 0.95)).astype(int) - p).mean() < 4
    with pytest.raises(ValueError):
        jpeg.decode(b"\xff\xd8\xff\xd9")


#: A grey progressive file of 64 by 48 pixels, written by another encoder.
PROGRESSIVE = (
    "/9j/4AAQSkZJRgABAgAAAQABAAD/2wBDAAYEBQYFBAYGBQYHBwYIChAKCgkJChQODwwQFxQYGBcUFhYaHSUfGhsjHBYWICwgIyYnKSopGR8tMC0oMCUoKSj/"
    "wgALCAAwAEABAREA/8QAGgAAAgMBAQAAAAAAAAAAAAAABAUBAgMGAP/aAAgBAQAAAAHgzeg1RLJ8RSZi+kN0GXru3i8BVjN2jQVBsZYbCLDndLvzqu3v/8QA"
    "HxAAAQQCAwEBAAAAAAAAAAAAAAECAxESEwQQMSEg/9oACAEBAAEFAiL4QyohJMlTLYveujw2KbFLsRlmlTXROxEJPemnHbY2JKnYiEsuQ/tpE/ETkfJZcjIa"
    "ljYLF49Dm0WZKZdQ+wIlSIlT/j//xAAUEAEAAAAAAAAAAAAAAAAAAABQ/9oACAEBAAY/AkP/xAAbEAADAQEBAQEAAAAAAAAAAAAAAREQMSFBYf/aAAgBAQAB"
    "PyEehAMC5nRTo2FMC2x/IbixMEho7ERcNQ5k9M4eie5krrEmws+Bnxjc4Jj6ciFctVXB9Es//9oACAEBAAAAEMbsEYxTMv/EABsQAQEBAQEAAwAAAAAAAAAA"
    "AAEAESExQVFh/9oACAEBAAE/EDrGKwsUkYJEwgkOb1e6TtHlbyKw/bL4IQ3V6pE4Fwi2sbxuQSg4WKCEPYbJAzr4nAxY7ZCAHsp62wIHSEazt5KuMfcyXrfi"
    "I6TOCCsyJQ0sk7y//9k="
)


def test_progressive_files_are_read():
    x = jpeg.decode(base64.b64decode(PROGRESSIVE))
    assert x.shape == (48, 64) and abs(x.mean() - 65.175) < 0.01 and (x[0, 0], x[20, 30], x[47, 63]) == (40, 41, 52)


def test_lengths_of_codes_stay_in_bounds():
    times = {k: 2**k for k in range(40)}
    got = jpeg.code_lengths(times)
    assert max(got.values()) <= 16 and sum(2.0**-n for n in got.values()) < 1


def test_lzw_example_and_run_lengths():
    assert filters.lzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    assert filters.runs(bytes([2, 1, 2, 3, 254, 9, 128, 7])) == b"\1\2\3\x09\x09\x09" and filters.hexadecimal(b"4 1 5>") == b"AP"


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    rows, out, above = R.integers(0, 256, (6, 15)).astype(np.uint8), b"", np.zeros(15, np.uint8)
    for row in rows:
        left, corner = (np.concatenate([np.zeros(3, np.uint8), x[:-3]]) for x in (row, above))
        q = left.astype(int) + above - corner
        near = [abs(q - x.astype(int)) for x in (left, above, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        guess = [0 * row, left, above, ((left.astype(int) + above) // 2).astype(np.uint8), paeth][kind]
        out, above = out + bytes([kind]) + (row - guess).astype(np.uint8).tobytes(), row
    assert filters.unpredicted(out, {"Predictor": 15, "Colors": 3, "Columns": 5}) == rows.tobytes()


def test_pictures_of_every_space():
    x = R.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    flat = zlib.compress(x.tobytes())
    mask = images.Picture(5, 4, 8, "Gray", bytes(range(20)))
    assert (images.pixels(images.Picture(5, 4, 8, "RGB", flat, ["FlateDecode"], [{}])) == x).all()
    got = images.pixels(images.Picture(5, 4, 8, "RGB", flat, ["FlateDecode"], [{}], mask=mask))
    assert got.shape == (4, 5, 4) and images.codec(mask, got) == "TRANSPARENT" and got[..., 3].ravel().tolist() == list(range(20))
    assert images.pixels(images.Picture(4, 1, 2, "Indexed", bytes([0b00011011]), palette=bytes(range(12))))[0, 3].tolist() == [9, 10, 11]
    assert images.pixels(images.Picture(8, 1, 1, "Gray", b"\xaa", decode=[1.0, 0.0])).tolist() == [[0, 255] * 4]
    assert images.pixels(images.Picture(1, 1, 8, "CMYK", b"\0\xff\0\0"))[0, 0].tolist() == [255, 0, 255]
    for bad in (images.Picture(9, 9, 8, "RGB", b"x"), images.Picture(9, 9, 8, "RGB", b"x", ["JPXDecode"], [{}])):
        with pytest.raises(ValueError):
            images.pixels(bad)


def test_classes_choose_their_coding():
    photo, flat = R.integers(0, 256, (40, 40, 3)).astype(np.uint8), np.zeros((40, 40, 3), np.uint8)
    assert images.transformed(photo, "COLOR", 20, 20, 0.5).filter == "DCTDecode" and images.transformed(flat, "COLOR", 20, 20, 0.5).filter == "FlateDecode"
    assert images.transformed(photo[..., 0], "GRAYSCALE", 20, 20, 0.5).space == "DeviceGray" and images.transformed(np.dstack([photo, photo[..., :1]]), "TRANSPARENT", 20, 20, 0.5).mask
    assert raster.photographic(photo) and not raster.photographic(flat)


def test_resize_and_likeness():
    x = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    assert raster.resize(x, 64, 64) is x and raster.resize(x, 16, 8).shape == (8, 16) and np.abs(raster.resize(x, 32, 32).astype(int) - x[::2, ::2]).max() <= 3
    assert raster.likeness(x, x) == pytest.approx(1) and raster.difference(x, x) == 0 and raster.difference(x, 255 - x) > 90 and raster.likeness(x, 255 - x) < 0.5
    assert raster.threshold(np.array([[127, 128]], np.uint8)).tolist() == [[0, 255]]


@pytest.mark.skipif(not os.path.exists(FONT), reason="no font")
def test_subset_keeps_outlines_parts_and_widths():
    font = truetype.parse(open(FONT, "rb").read())
    characters = truetype.unicode_map(font)
    pairs = {ord(c): characters[ord(c)] for c in "Hé ÀW"}
    data, new = truetype.subset(font, set(pairs.values()), pairs)
    again = truetype.parse(data)
    assert truetype.unicode_map(again) == {c: new[g] for c, g in pairs.items()} and truetype.checksum(data) == 0xB1B0AFBA and len(data) < 20_000
    accented = pairs[ord("À")]
    assert [new[p] for _, p in truetype.parts(font.glyph(accented))] == [p for _, p in truetype.parts(again.glyph(new[accented]))]
    for g in pairs.values():
        assert again.tables[b"hmtx"][4 * new[g] :][:2] == font.tables[b"hmtx"][4 * min(g, font.metrics - 1) :][:2]
    for bad in (b"", b"\0\1\0\0\0\x09", b"OTTO"):
        with pytest.raises(ValueError):
            truetype.parse(bad)

"""Images of the file format, decoded to rasters, classed, transformed and encoded again.

An image is its encoded bytes and a description: w, h, bpc, space (Gray, RGB, CMYK or Indexed), palette and its base, decode
array, filters and their parameters, and the same of its soft mask. JPEG (sequential), CCITT with K below 0, and all plain
filters are decoded; JPEG 2000, JBIG2 and progressive JPEG are reported as errors and left as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

from . import fax, filters, jpeg, raster

CODED = ("DCTDecode", "DCT", "CCITTFaxDecode", "CCF", "JPXDecode", "JBIG2Decode")
CHANNELS = {"Gray": 1, "RGB": 3, "CMYK": 4, "Indexed": 1}


@dataclass
class Picture:
    w: int
    h: int
    bpc: int
    space: str
    data: bytes
    filters: list[str] = field(default_factory=list)
    parms: list[dict] = field(default_factory=list)
    decode: list[float] = field(default_factory=list)
    palette: bytes = b""
    base: str = "RGB"
    mask: Picture | None = None


@dataclass
class Coded:
    """What an image becomes: the entries of its dictionary that follow from its encoding, its bytes, and a soft mask's."""

    w: int
    h: int
    bpc: int
    space: str
    filter: str
    data: bytes
    parms: dict = field(default_factory=dict)
    mask: bytes | None = None


def samples(p: Picture) -> np.ndarray:
    """(h, w, channels) sample values as they are stored, before any decode array or palette."""
    data, left, parms = filters.decoded(p.data, p.filters, p.parms, CODED)
    if left:
        if left[0] in ("DCTDecode", "DCT"):
            out = jpeg.decode(data)
            return out[..., None] if out.ndim == 2 else out
        if left[0] in ("CCITTFaxDecode", "CCF") and int(parms[0].get("K", 0)) < 0:
            rows = fax.decode(data, int(parms[0].get("Columns", 1728)), p.h)[: p.h]
            full = np.zeros((p.h, rows.shape[1]), np.uint8)
            full[: len(rows)] = rows
            return (full if parms[0].get("BlackIs1") else 1 - full)[:, : p.w, None]
        raise ValueError(f"no decoder for {left[0]}")
    n = CHANNELS[p.space]
    line = (p.w * n * p.bpc + 7) // 8
    if len(data) < line * p.h:
        raise ValueError("too few samples")
    rows = np.frombuffer(data[: line * p.h], np.uint8).reshape(p.h, line)
    if p.bpc == 16:
        flat = rows.reshape(p.h, -1, 2)[..., 0]
    elif p.bpc == 8:
        flat = rows
    else:
        bits = np.unpackbits(rows, axis=1)[:, : p.w * n * p.bpc].reshape(p.h, -1, p.bpc)
        flat = (bits * (1 << np.arange(p.bpc - 1, -1, -1))).sum(2).astype(np.uint8)
    return flat[:, : p.w * n].reshape(p.h, p.w, n)


def pixels(p: Picture) -> np.ndarray:
    """The raster: grey (h, w), colour (h, w, 3), or with the soft mask as its fourth channel."""
    x = samples(p)
    if p.space == "Indexed":
        n = CHANNELS[p.base]
        table = np.frombuffer(p.palette[: len(p.palette) // n * n], np.uint8).reshape(-1, n)
        x = table[np.minimum(x[..., 0], len(table) - 1)]
    else:
        wide = 255 if p.bpc in (8, 16) or x.max(initial=0) > (1 << p.bpc) - 1 else (1 << p.bpc) - 1
        if wide != 255:
            x = (x.astype(np.uint16) * 255 // wide).astype(np.uint8)
        if len(p.decode) == 2 * x.shape[2] and p.decode[0] > p.decode[1]:
            x = 255 - x
    if x.shape[2] == 4:
        ink = 255 - x.astype(np.uint16)
        x = (ink[..., :3] * ink[..., 3:] // 255).astype(np.uint8)
    out = x[..., 0] if x.shape[2] == 1 else x
    if p.mask is None:
        return out
    alpha = raster.grey(pixels(p.mask))
    if alpha.shape != out.shape[:2]:
        alpha = raster.resize(alpha, out.shape[1], out.shape[0]) if alpha.size > out.shape[0] * out.shape[1] else raster.scaled(alpha, out.shape[1], out.shape[0])
    return np.concatenate([raster.rgb(out), alpha[..., None]], 2)


def codec(p: Picture, x: np.ndarray) -> str:
    """BITONAL, TRANSPARENT, GRAYSCALE or COLOR, in this order."""
    if p.bpc == 1 and p.space != "Indexed":
        return "BITONAL"
    if x.ndim == 3 and x.shape[2] == 4:
        return "TRANSPARENT"
    return "GRAYSCALE" if x.ndim == 2 else "COLOR"


def transformed(x: np.ndarray, kind: str, w: int, h: int, quality: float) -> Coded:
    """The raster at its target size, encoded as its class asks: CCITT, Flate, or JPEG (for colour only if photographic)."""
    if kind == "BITONAL":
        bits = (raster.threshold(raster.resize(raster.grey(x), w, h)) == 0).astype(np.uint8)
        return Coded(w, h, 1, "DeviceGray", "CCITTFaxDecode", fax.encode(bits), {"K": -1, "Columns": w, "Rows": h})
    x = raster.resize(x, w, h)
    if kind == "TRANSPARENT":
        return Coded(w, h, 8, "DeviceRGB", "FlateDecode", zlib.compress(np.ascontiguousarray(x[..., :3]).tobytes(), 9), mask=zlib.compress(np.ascontiguousarray(x[..., 3]).tobytes(), 9))
    if kind == "GRAYSCALE":
        return Coded(w, h, 8, "DeviceGray", "DCTDecode", jpeg.encode(raster.grey(x), quality))
    if raster.photographic(x):
        return Coded(w, h, 8, "DeviceRGB", "DCTDecode", jpeg.encode(raster.rgb(x), quality))
    return Coded(w, h, 8, "DeviceRGB", "FlateDecode", zlib.compress(raster.rgb(x).tobytes(), 9))

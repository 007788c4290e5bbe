"""Raster work in NumPy: conversion, resizing, thresholding, colour counts and likeness.

Rasters are uint8 arrays (h, w) for grey and (h, w, 3 or 4) for colour with or without alpha. Resampling is bicubic with
the Catmull-Rom kernel; results are near other libraries', not bit-equal with them.
"""

from __future__ import annotations

import numpy as np

# Bounds of the photographic test, the bitonal threshold, and the constants of the likeness index.
SAMPLES, COLOURS, BLACK_BELOW = 20_000, 256, 128
BLOCK, C1, C2 = 8, (0.01 * 255) ** 2, (0.03 * 255) ** 2


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of a colour raster; a grey one as it is."""
    if pixels.ndim == 2:
        return pixels
    r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5), 0, 255).astype(np.uint8)


def rgb(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(pixels[..., None], 3, 2) if pixels.ndim == 2 else np.ascontiguousarray(pixels[..., :3])


def weights(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the target the four nearest places of the source and their shares."""
    at = (np.arange(target) + 0.5) * size / target - 0.5
    first = np.floor(at).astype(int) - 1
    t = np.abs(at[:, None] - (first[:, None] + np.arange(4)))
    near, far = 1.5 * t**3 - 2.5 * t**2 + 1, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2
    share = np.where(t <= 1, near, np.where(t < 2, far, 0.0))
    return np.clip(first[:, None] + np.arange(4), 0, size - 1), share / share.sum(1, keepdims=True)


def scaled(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """One bicubic step, rows first."""
    out = pixels.astype(np.float64)
    for axis, target in ((0, h), (1, w)):
        at, share = weights(out.shape[axis], target)
        shape = [1] * out.ndim
        shape[axis] = target
        out = sum(np.take(out, at[:, k], axis) * share[:, k].reshape(shape) for k in range(4))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """The raster at w by h: halved while both sides are over twice their target, then one last step."""
    while pixels.shape[1] > 2 * w and pixels.shape[0] > 2 * h:
        pixels = scaled(pixels, max(w, pixels.shape[1] // 2), max(h, pixels.shape[0] // 2))
    return pixels if pixels.shape[:2] == (h, w) else scaled(pixels, w, h)


def threshold(pixels: np.ndarray) -> np.ndarray:
    """Grey to black (0) and white (255)."""
    return np.where(grey(pixels) < BLACK_BELOW, 0, 255).astype(np.uint8)


def photographic(pixels: np.ndarray, most: int = COLOURS) -> bool:
    """Whether a sparse grid of the raster has more than `most` colours."""
    h, w = pixels.shape[:2]
    step = int(max(1.0, (w * h / SAMPLES) ** 0.5))
    c = rgb(pixels)[::step, ::step].astype(np.uint32)
    return len(np.unique(c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2])) > most


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of two rasters' lumas over blocks of 8 by 8 without overlap, sample moments; sides that
    don't divide lose their last rows and columns. Rasters of different sizes, or below a block, have none (nan)."""
    x, y = grey(a).astype(np.float64), grey(b).astype(np.float64)
    h, w = (n // BLOCK * BLOCK for n in x.shape)
    if x.shape != y.shape or not h or not w:
        return float("nan")

    def blocks(v: np.ndarray) -> np.ndarray:
        return v[:h, :w].reshape(h // BLOCK, BLOCK, w // BLOCK, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK * BLOCK)

    x, y = blocks(x), blocks(y)
    mx, my = x.mean(1), y.mean(1)
    both = ((x - mx[:, None]) * (y - my[:, None])).sum(1) / (BLOCK * BLOCK - 1)
    return float(((2 * mx * my + C1) * (2 * both + C2) / ((mx**2 + my**2 + C1) * (x.var(1, ddof=1) + y.var(1, ddof=1) + C2))).mean())


def difference(a: np.ndarray, b: np.ndarray, tolerance: int = 4) -> float:
    """Share of pixels in percent of which some channel differs by more than the tolerance."""
    if a.shape[:2] != b.shape[:2]:
        return 100.0
    return float((np.abs(rgb(a).astype(int) - rgb(b).astype(int)).max(2) > tolerance).mean() * 100)

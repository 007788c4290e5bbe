"""JPEG in NumPy: a baseline encoder with Huffman codes made for each image, and a decoder of sequential and progressive files.

Arithmetic and lossless files are refused with a ValueError. Grey and three-channel rasters are written; files of one,
three and four channels are read, four of them as they stand.
"""

from __future__ import annotations

import numpy as np

# The standard's example quantisation tables, row by row.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
        18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
#: Places of an 8 by 8 block from low frequencies to high, along its diagonals in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_K = np.arange(8)
DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)


def quantisers(quality: float) -> list[np.ndarray]:
    """The two tables at a quality from 0 to 1: as they are at one half, all ones at 1."""
    q = max(0.01, min(1.0, quality)) * 100
    factor = 50 / q if q < 50 else 2 - q / 50
    return [np.clip(np.floor(np.array(t) * factor + 0.5), 1, 255).astype(np.int64) for t in (LUMA, CHROMA)]


def code_lengths(times: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; no code is all ones."""
    import heapq

    heap = [(n, -1, i, (s,)) for i, (s, n) in enumerate(sorted(times.items()))] + [(0, -2, 0, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*times, 256], 0)
    k = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[3] + b[3]:
            depth[s] += 1
        k += 1
        heapq.heappush(heap, (a[0] + b[0], k, 0, a[3] + b[3]))
    count = np.bincount(list(depth.values()), minlength=64)
    for n in range(len(count) - 1, 16, -1):  # move pairs of too long codes up
        while count[n]:
            up = n - 2
            while not count[up]:
                up -= 1
            count[n] -= 2
            count[n - 1] += 1
            count[up + 1] += 2
            count[up] -= 1
    order = sorted(depth, key=lambda s: (depth[s], s == 256, s))
    each = np.repeat(np.arange(len(count)), count)
    out = dict(zip(order, each.tolist(), strict=True))
    last = max(out, key=lambda s: (out[s], s == 256))
    if last != 256:  # the reserved code must be the longest
        out[last], out[256] = out[256], out[last]
    out.pop(256)
    return out


def canonical(length: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and each symbol's code and length."""
    symbols = sorted(length, key=lambda s: (length[s], s))
    code, codes, n = 0, {}, 0
    for s in symbols:
        code <<= length[s] - n
        n = length[s]
        codes[s] = (code, n)
        code += 1
    return [sum(v == k for v in length.values()) for k in range(1, 17)], symbols, codes


def blocks_of(channel: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) blocks; the last row and column are repeated to fill them."""
    h, w = channel.shape
    full = np.pad(channel, ((0, -h % 8), (0, -w % 8)), "edge").astype(np.float64) - 128
    return full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)


def coefficients(channel: np.ndarray, table: np.ndarray) -> np.ndarray:
    x = DCT @ blocks_of(channel) @ DCT.T
    return np.rint(x.reshape(-1, 64) / table)[:, ZIGZAG].astype(np.int64)


def size_of(v: np.ndarray) -> np.ndarray:
    """Bits that a value needs beside its sign."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def symbols_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) of the blocks' coefficients; symbols of the first ones are marked by 256."""
    out: list[tuple[int, int, int]] = []
    first = np.diff(x[:, 0], prepend=0)
    sizes = size_of(x)
    first_size = size_of(first)
    extra = np.where(x < 0, x + (1 << sizes) - 1, x)
    first_extra = np.where(first < 0, first + (1 << first_size) - 1, first)
    rows, places = np.nonzero(x[:, 1:])
    cut = np.searchsorted(rows, np.arange(len(x) + 1))
    for i in range(len(x)):
        out.append((256 + int(first_size[i]), int(first_extra[i]), int(first_size[i])))
        last = 0
        for p in (places[cut[i] : cut[i + 1]] + 1).tolist():
            gap = p - last - 1
            while gap > 15:
                out.append((0xF0, 0, 0))
                gap -= 16
            n = int(sizes[i, p])
            out.append((gap << 4 | n, int(extra[i, p]), n))
            last = p
        if last < 63:
            out.append((0, 0, 0))
    return out


def segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(pixels: np.ndarray, quality: float = 0.75) -> bytes:
    """A baseline file of a grey (h, w) or colour (h, w, 3) raster. Channels are scanned one after another, chroma at half
    size."""
    h, w = pixels.shape[:2]
    tables = quantisers(quality)
    if pixels.ndim == 2:
        channels, sample = [pixels.astype(np.float64)], [(1, 1)]
    else:
        r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        chroma = [128 + (b - y) * 0.5 / (1 - 0.114), 128 + (r - y) * 0.5 / (1 - 0.299)]

        def half(c):
            full = np.pad(c, ((0, h % 2), (0, w % 2)), "edge")
            return (full[::2, ::2] + full[1::2, ::2] + full[::2, 1::2] + full[1::2, 1::2]) / 4
        channels, sample = [y, *map(half, chroma)], [(2, 2), (1, 1), (1, 1)]
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    used = tables[: min(2, len(channels))]
    out += [segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(used)]
    parts = b"".join(bytes([k + 1, sx << 4 | sy, min(k, 1)]) for k, (sx, sy) in enumerate(sample))
    out.append(segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(channels)]) + parts))
    for k, channel in enumerate(channels):
        found = symbols_of(coefficients(channel, tables[min(k, 1)]))
        codes: dict[int, tuple[int, int]] = {}
        for kind in (0, 1):
            times: dict[int, int] = {}
            for s, _, _ in found:
                if (s >= 256) == (kind == 0):
                    times[s & 255] = times.get(s & 255, 0) + 1
            counts, symbols, own = canonical(code_lengths(times or {0: 1}))
            out.append(segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(symbols)))
            codes |= {s | (0 if kind else 256): c for s, c in own.items()}
        bits = np.fromiter((codes[s][1] + n for s, _, n in found), np.int64, len(found))
        values = np.fromiter((codes[s][0] << n | v for s, v, n in found), np.int64, len(found))
        out += [segment(0xDA, bytes([1, k + 1, 0, 0, 63, 0])), packed(values, bits)]
    return b"".join(out) + b"\xff\xd9"


def packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Values of so many bits, one after another, filled up with ones; a zero byte goes behind every 255."""
    ends = np.cumsum(bits)
    total = int(ends[-1])
    at = np.arange(total)
    of = np.searchsorted(ends, at, side="right")
    flat = (values[of] >> (ends[of] - 1 - at)) & 1
    data = np.packbits(np.concatenate([flat, np.ones(-total % 8, np.int64)]).astype(np.uint8))
    return data.tobytes().replace(b"\xff", b"\xff\0")


class Bits:
    def __init__(self, data: bytes):
        self.value, self.left, self.data, self.at = 0, 0, data, 0

    def fill(self) -> None:
        chunk = self.data[self.at : self.at + 32]
        self.at += 32
        chunk = chunk.ljust(32, b"\xff") if self.at <= len(self.data) + 64 else None
        if chunk is None:
            raise ValueError("the scan ends too soon")
        self.value = (self.value & ((1 << self.left) - 1)) << 256 | int.from_bytes(chunk, "big")
        self.left += 256

    def peek(self, n: int) -> int:
        if self.left < n:
            self.fill()
        return self.value >> (self.left - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.left -= n
        return out


def lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """For every 16 bits the symbol that they begin with, and its length."""
    table: list[tuple[int, int] | None] = []
    k = 0
    for n, times in enumerate(counts, 1):
        for _ in range(times):
            table += [(symbols[k], n)] * (1 << (16 - n))
            k += 1
    return table + [None] * ((1 << 16) - len(table))


def decode(data: bytes) -> np.ndarray:
    """Raster (h, w) or (h, w, n). Three channels are turned from YCbCr to RGB unless an Adobe mark says they are RGB."""
    at, quant, huff, frame, restart, adobe = 2, {}, {}, None, 0, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                flat = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                quant[body[0] & 15] = flat
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark in (0xC0, 0xC1, 0xC2):
            progressive = mark == 0xC2
            h, w, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            if body[0] != 8 or not h or not w or len(body) < 6 + 3 * n:
                raise ValueError("unsupported frame")
            frame = [{"id": body[6 + 3 * k], "sx": body[7 + 3 * k] >> 4, "sy": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
            mx, my = max(c["sx"] for c in frame), max(c["sy"] for c in frame)
            cols, rows = -(-w // (8 * mx)), -(-h // (8 * my))
            for c in frame:
                c["own"] = (-(-(-(-h * c["sy"] // my)) // 8), -(-(-(-w * c["sx"] // mx)) // 8))
                c["x"] = np.zeros((rows * c["sy"], cols * c["sx"], 64), np.int64)
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("this kind of JPEG is not supported")
        elif mark == 0xDA:
            if not frame:
                raise ValueError("a scan before its frame")
            chosen = [(next(c for c in frame if c["id"] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            n = body[0]
            band = (body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15) if progressive else None
            at = scan(data, at, chosen, huff, restart, (rows, cols), band)
    if not frame:
        raise ValueError("no frame")
    out = []
    for c in frame:
        x = np.zeros_like(c["x"])
        x[..., ZIGZAG] = c["x"] * quant[c["q"]]
        p = DCT.T @ x.reshape(*x.shape[:2], 8, 8).astype(np.float64) @ DCT + 128
        p = np.clip(np.rint(p), 0, 255).swapaxes(1, 2).reshape(x.shape[0] * 8, x.shape[1] * 8)
        out.append(np.repeat(np.repeat(p, my // c["sy"], 0), mx // c["sx"], 1)[:h, :w])
    if len(out) == 1:
        return out[0].astype(np.uint8)
    if len(out) == 3 and adobe != 0:
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        out = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(out, 2)), 0, 255).astype(np.uint8)


def scan(data: bytes, at: int, chosen: list, huff: dict, restart: int, grid: tuple[int, int], band: tuple[int, int, int, int] | None = None) -> int:
    """Reads a scan's coefficients into its channels; returns where it ends. band: of a progressive scan the first and last
    place, and the bits read before and left to read."""
    end = at
    while not (data[end : end + 1] == b"\xff" and data[end + 1 : end + 2] not in (b"\0", *[bytes([0xD0 + k]) for k in range(8)])):
        end = data.find(b"\xff", end + 1)
        if end < 0:
            end = len(data)
            break
    pieces, begin = [], at
    while restart and (cut := next((i for i in range(begin, end - 1) if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7), -1)) >= 0:
        pieces.append(data[begin:cut])
        begin = cut + 2
    pieces = [p.replace(b"\xff\0", b"\xff") for p in [*pieces, data[begin:end]]]
    alone = len(chosen) == 1
    rows, cols = chosen[0][0]["own"] if alone else grid
    units = [(r, c) for r in range(rows) for c in range(cols)]
    each = restart or len(units)
    for k, piece in enumerate(pieces):
        bits, last, left = Bits(piece), [0] * len(chosen), [0]
        for r, c in units[k * each : (k + 1) * each]:
            for i, (channel, tables) in enumerate(chosen):
                sx, sy = (1, 1) if alone else (channel["sx"], channel["sy"])
                dc, ac = huff.get(tables >> 4), huff.get(0x10 | tables & 15)
                for v in range(sy):
                    for u in range(sx):
                        out = channel["x"][r * sy + v, c * sx + u]
                        if band is None:
                            last[i] = block(bits, dc, ac, out, last[i])
                        elif band[0] == 0:
                            last[i] = first_place(bits, dc, out, last[i], band)
                        else:
                            (refined if band[2] else begun)(bits, ac, out, left, band)
    return end


def symbol(bits: Bits, table: list) -> int:
    found = table[bits.peek(16)] if table else None
    if found is None:
        raise ValueError("no such code")
    bits.left -= found[1]
    return found[0]


def value(bits: Bits, n: int) -> int:
    v = bits.take(n)
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def block(bits: Bits, dc: list, ac: list, out: np.ndarray, last: int) -> int:
    last += value(bits, symbol(bits, dc))
    out[0] = last
    k = 1
    while k < 64:
        s = symbol(bits, ac)
        if s == 0:
            break
        k += s >> 4
        if s & 15:
            if k > 63:
                raise ValueError("too many coefficients")
            out[k] = value(bits, s & 15)
        k += 1
    return last


def first_place(bits: Bits, dc: list, out: np.ndarray, last: int, band: tuple) -> int:
    """The upper bits of a block's mean, or one bit more of it."""
    if band[2]:
        out[0] |= bits.take(1) << band[3]
        return last
    last += value(bits, symbol(bits, dc))
    out[0] = last << band[3]
    return last


def begun(bits: Bits, ac: list, out: np.ndarray, left: list[int], band: tuple) -> None:
    """The upper bits of a band; left[0] counts the blocks that follow without any."""
    if left[0]:
        left[0] -= 1
        return
    k, end, _, low = band
    while k <= end:
        s = symbol(bits, ac)
        gap, n = s >> 4, s & 15
        if n:
            k += gap
            if k > 63:
                raise ValueError("too many coefficients")
            out[k] = value(bits, n) << low
            k += 1
        elif gap == 15:
            k += 16
        else:
            left[0] = (1 << gap) - 1 + bits.take(gap)
            return


def refined(bits: Bits, ac: list, out: np.ndarray, left: list[int], band: tuple) -> None:
    """One bit more of a band: of the places that have a value, and places that get their first."""
    k, end, _, low = band
    one = 1 << low

    def more(at: int) -> None:
        if bits.take(1) and not abs(int(out[at])) & one:
            out[at] += one if out[at] > 0 else -one

    if not left[0]:
        while k <= end:
            s = symbol(bits, ac)
            gap, n, new = s >> 4, s & 15, 0
            if n:
                new = one if bits.take(1) else -one
            elif gap < 15:
                left[0] = (1 << gap) + bits.take(gap)
                break
            while k <= end:
                if out[k]:
                    more(k)
                elif gap == 0:
                    break
                else:
                    gap -= 1
                k += 1
            if new:
                if k > 63:
                    raise ValueError("too many coefficients")
                out[k] = new
            k += 1
    if left[0]:
        for at in range(k, end + 1):
            if out[at]:
                more(at)
        left[0] -= 1

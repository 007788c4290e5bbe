"""TrueType programs: tables, character maps, and subsets by glyph.

A subset keeps glyph 0, the glyphs asked for and the parts of compound ones, renumbered in order, with the tables that a
renderer of an embedded font needs. A subset by code points also gets a character map of them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Tables that go into a subset unchanged, and the flags of a compound glyph's parts.
COPIED = (b"cvt ", b"fpgm", b"prep", b"gasp", b"OS/2", b"name")
WORDS, XY, SCALE, MORE, SCALES, MATRIX = 0x1, 0x2, 0x8, 0x20, 0x40, 0x80


@dataclass
class Font:
    tables: dict[bytes, bytes]
    glyphs: int
    metrics: int
    loca: list[int]

    def glyph(self, gid: int) -> bytes:
        return self.tables[b"glyf"][self.loca[gid] : self.loca[gid + 1]] if 0 <= gid < self.glyphs else b""


def parse(data: bytes) -> Font:
    """ValueError where the program lacks a table or a table its bytes."""
    if data[:4] not in (b"\0\1\0\0", b"true"):
        raise ValueError("no TrueType program")
    try:
        tables = {}
        for k in range(struct.unpack(">H", data[4:6])[0]):
            tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
            tables[tag] = data[at : at + size]
        glyphs = struct.unpack(">H", tables[b"maxp"][4:6])[0]
        wide = struct.unpack(">h", tables[b"head"][50:52])[0]
        metrics = struct.unpack(">H", tables[b"hhea"][34:36])[0]
        loca = struct.unpack(f">{glyphs + 1}{'I' if wide else 'H'}", tables[b"loca"][: (glyphs + 1) * (4 if wide else 2)])
        tables[b"glyf"], tables[b"hmtx"]
    except (struct.error, KeyError) as e:
        raise ValueError(f"broken TrueType program: {e}") from e
    return Font(tables, glyphs, metrics, [x if wide else 2 * x for x in loca])


def parts(glyph: bytes) -> list[tuple[int, int]]:
    """(where its number stands, number) of each part of a compound glyph; none for a simple one."""
    if len(glyph) < 10 or struct.unpack(">h", glyph[:2])[0] >= 0:
        return []
    out, at, flags = [], 10, MORE
    while flags & MORE and at + 4 <= len(glyph):
        flags, gid = struct.unpack(">HH", glyph[at : at + 4])
        out.append((at + 2, gid))
        at += 4 + (4 if flags & WORDS else 2) + (2 if flags & SCALE else 4 if flags & SCALES else 8 if flags & MATRIX else 0)
    return out


def closure(font: Font, gids: set[int]) -> list[int]:
    """The glyphs asked for that exist, glyph 0, and all their parts, in order."""
    todo, seen = [0, *gids], set()
    while todo:
        gid = todo.pop()
        if gid not in seen and 0 <= gid < font.glyphs:
            seen.add(gid)
            todo += [p for _, p in parts(font.glyph(gid))]
    return sorted(seen)


def unicode_map(font: Font) -> dict[int, int] | None:
    """Code point to glyph by the font's Unicode character map; None if it has none."""
    table = font.tables.get(b"cmap", b"")
    found = {}
    try:
        for k in range(struct.unpack(">H", table[2:4])[0] if table else 0):
            platform, encoding, at = struct.unpack(">HHI", table[4 + 8 * k : 12 + 8 * k])
            rank = {(3, 10): 3, (0, 4): 3, (0, 6): 3, (3, 1): 2}.get((platform, encoding), 1 if platform == 0 and encoding < 4 else 0)
            kind = struct.unpack(">H", table[at : at + 2])[0]
            if rank and kind in (4, 12):
                found[rank] = (kind, table[at:])
        if not found:
            return None
        kind, body = found[max(found)]
        return segments(body) if kind == 4 else {c: g + i for a, b, g in struct.iter_unpack(">III", body[16 : 16 + 12 * struct.unpack(">I", body[12:16])[0]]) for i, c in enumerate(range(a, min(b, a + 0x110000) + 1))}
    except struct.error:
        return None


def segments(body: bytes) -> dict[int, int]:
    n = struct.unpack(">H", body[6:8])[0] // 2
    ends, starts, deltas, offsets = (struct.unpack(f">{n}H", body[at : at + 2 * n]) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
    out = {}
    for k in range(n):
        for c in range(starts[k], ends[k] + 1):
            gid = c
            if offsets[k]:
                at = 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                gid = struct.unpack(">H", body[at : at + 2])[0] if at + 2 <= len(body) else 0
            if gid or not offsets[k]:
                gid = (gid + deltas[k]) & 0xFFFF
            if gid and c != 0xFFFF:
                out[c] = gid
    return out


def character_map(pairs: dict[int, int]) -> bytes:
    """A table with one map of 32-bit groups, and of 16-bit segments for what lies below 0x10000."""
    runs: list[list[int]] = []
    for c, g in sorted(pairs.items()):
        if runs and c == runs[-1][1] + 1 and g == runs[-1][2] + c - runs[-1][0]:
            runs[-1][1] = c
        else:
            runs.append([c, c, g])
    low = [[a, min(b, 0xFFFE), g] for a, b, g in runs if a < 0xFFFF] + [[0xFFFF, 0xFFFF, 0]]
    n = len(low)
    deltas = [(g - a) & 0xFFFF if a != 0xFFFF else 1 for a, _, g in low]
    power = 1 << (n.bit_length() - 1)
    four = struct.pack(">HHHH", 2 * n, 2 * power, power.bit_length() - 1, 2 * (n - power))
    four += struct.pack(f">{n}H", *(b for _, b, _ in low)) + b"\0\0" + struct.pack(f">{n}H", *(a for a, _, _ in low)) + struct.pack(f">{n}H", *deltas) + b"\0\0" * n
    four = struct.pack(">HHH", 4, len(four) + 6, 0) + four
    twelve = struct.pack(">HHIII", 12, 0, 16 + 12 * len(runs), 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)
    return struct.pack(">HHHHIHHI", 0, 2, 3, 1, 20, 3, 10, 20 + len(four)) + four + twelve


def checksum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def subset(font: Font, gids: set[int], pairs: dict[int, int] | None = None) -> tuple[bytes, dict[int, int]]:
    """The program of the glyphs and their parts, and old number to new. pairs: code points and old numbers to map."""
    kept = closure(font, gids)
    new = {g: i for i, g in enumerate(kept)}
    glyphs, places, widths = [], [0], []
    last = (font.metrics - 1) * 4
    for g in kept:
        body = bytearray(font.glyph(g))
        for at, part in parts(bytes(body)):
            body[at : at + 2] = struct.pack(">H", new.get(part, 0))
        body += b"\0" * (-len(body) % 4)
        glyphs.append(bytes(body))
        places.append(places[-1] + len(body))
        hmtx = font.tables[b"hmtx"]
        side = font.metrics * 4 + 2 * (g - font.metrics)
        widths.append(hmtx[4 * g : 4 * g + 4] if g < font.metrics else hmtx[last : last + 2] + (hmtx[side : side + 2] or b"\0\0"))
    tables = {t: font.tables[t] for t in COPIED if t in font.tables}
    head, hhea, maxp = bytearray(font.tables[b"head"]), bytearray(font.tables[b"hhea"]), bytearray(font.tables[b"maxp"])
    head[8:12], head[50:52] = b"\0\0\0\0", struct.pack(">h", 1)
    hhea[34:36], maxp[4:6] = struct.pack(">H", len(kept)), struct.pack(">H", len(kept))
    tables |= {b"head": bytes(head), b"hhea": bytes(hhea), b"maxp": bytes(maxp), b"glyf": b"".join(glyphs), b"loca": struct.pack(f">{len(places)}I", *places), b"hmtx": b"".join(widths)}
    tables[b"post"] = struct.pack(">I", 0x30000) + font.tables.get(b"post", b"")[4:32].ljust(28, b"\0")
    if pairs:
        tables[b"cmap"] = character_map({c: new[g] for c, g in pairs.items()})
    n = len(tables)
    power = 1 << (n.bit_length() - 1)
    at, index, body = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        index += struct.pack(">4sIII", tag, checksum(tables[tag]), at + len(body), len(tables[tag]))
        body += tables[tag] + b"\0" * (-len(tables[tag]) % 4)
    out = bytearray(b"\0\1\0\0" + struct.pack(">HHHH", n, 16 * power, power.bit_length() - 1, 16 * (n - power)) + index + body)
    where = struct.unpack(">I", index[16 * sorted(tables).index(b"head") + 8 :][:4])[0]
    out[where + 8 : where + 12] = struct.pack(">I", (0xB1B0AFBA - checksum(bytes(out))) & 0xFFFFFFFF)
    return bytes(out), new

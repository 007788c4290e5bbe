"""PDF files written from parsed ones: all objects that the trailer reaches, with a fresh cross-reference table.

A file whose encryption the empty password opened is written without it; others are not written and keep their bytes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from ..sources.pdf import Name, Operator, Pdf, Raw, Ref, Stream, pages_of, references

ESCAPED_NAME = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")


@dataclass
class Changes:
    """What becomes of a document: streams replaced by number, references moved, dictionary entries set, and what goes."""

    streams: dict[int, Stream] = field(default_factory=dict)
    moved: dict[int, int] = field(default_factory=dict)
    entries: dict[int, dict] = field(default_factory=dict)
    strip_metadata: bool = False
    strip_private: bool = False


def dumped(x) -> bytes:
    """A value as it is written in a file."""
    if isinstance(x, Stream):
        return dumped({**x.head, "Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    if isinstance(x, dict):
        return b"<<" + b"".join(b" " + dumped(Name(k)) + b" " + dumped(v) for k, v in x.items()) + b" >>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(dumped, x)) + b"]"
    if isinstance(x, Name):
        return b"/" + ESCAPED_NAME.sub(lambda m: b"#%02X" % m[0][0], x.encode("latin-1"))
    if isinstance(x, Ref):
        return b"%d 0 R" % x.number
    if isinstance(x, Raw):
        return b"(" + x + b")"
    if isinstance(x, Operator):
        return bytes(x)
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, bool) or x is None:
        return {True: b"true", False: b"false", None: b"null"}[x]
    return (f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)).encode()


def moved(x, to: dict[int, int]):
    """The value with its references led to other numbers; 0 makes them null."""
    if isinstance(x, Ref):
        n = to.get(x.number, x.number)
        return Ref(n) if n else None
    if isinstance(x, Stream):
        return Stream(moved(x.head, to), x.raw)
    if isinstance(x, dict):
        return {k: moved(v, to) for k, v in x.items()}
    return [moved(v, to) for v in x] if isinstance(x, list) else x


def without(pdf: Pdf, changes: Changes) -> None:
    """Takes private data and metadata out of catalog, pages and trailer, as far as the changes ask for it."""
    catalog = pdf.head(pdf.trailer.get("Root"))
    pages = [pdf.objects[n] for n, _ in pages_of(pdf) if n in pdf.objects and isinstance(pdf.objects[n], dict)]
    if changes.strip_metadata:
        catalog.pop("Metadata", None)
        pdf.trailer.pop("Info", None)
    if changes.strip_private:
        for x in [catalog, *pages]:
            x.pop("PieceInfo", None)
        for x in pages:
            x.pop("Thumb", None)


def written(pdf: Pdf, changes: Changes | None = None) -> bytes:
    """The file with the changes made. Object and cross-reference streams of the original are dissolved."""
    changes = changes or Changes()
    if pdf.get(pdf.trailer.get("Encrypt")) is not None:
        raise ValueError("files that need a password are not written")
    without(pdf, changes)
    objects = pdf.objects | changes.streams
    for n, more in changes.entries.items():
        x = objects.get(n)
        head = x.head if isinstance(x, Stream) else x
        if isinstance(head, dict):
            head = {**head, **more}
            objects[n] = Stream(head, x.raw) if isinstance(x, Stream) else head
    objects = {n: moved(x, changes.moved) for n, x in objects.items()}
    trailer = moved({k: v for k, v in pdf.trailer.items() if k in ("Root", "Info", "ID")}, changes.moved)
    todo, seen = [n for _, n in references(trailer)], set()
    while todo:
        n = todo.pop()
        if n not in seen and n in objects:
            seen.add(n)
            todo += [k for _, k in references(objects[n])]
    number = {n: i for i, n in enumerate(sorted(seen), 1)}
    lost = {k: 0 for n in seen for _, k in references(objects[n]) if k not in seen} | {k: 0 for _, k in references(trailer) if k not in seen}
    out, places, at = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], [], 15
    for n in sorted(seen):
        places.append(at)
        out.append(b"%d 0 obj\n" % number[n] + dumped(moved(objects[n], number | lost)) + b"\nendobj\n")
        at += len(out[-1])
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    end = dumped(moved(trailer, number | lost) | {"Size": len(places) + 1})
    return b"".join(out) + table + b"trailer\n" + end + b"\nstartxref\n%d\n%%%%EOF\n" % at


def packed(data: bytes, **head) -> Stream:
    """A Flate stream."""
    return Stream({"Filter": Name("FlateDecode"), **head}, zlib.compress(data, 9))

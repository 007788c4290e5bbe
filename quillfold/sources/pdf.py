"""PDF files as tables: documents, objects, edges between objects, pages, images, where pages draw them and which resources
name them, fonts and the glyphs shown, and colour profiles.

Files come through Spark's `binaryFile` source, so any store Spark reads will do, and a file is parsed whole in one task.
Objects are found by walking the file from head to tail, not by its cross-reference table, so files with a broken table are
read too; of several definitions of one number the last counts. Object streams are opened. Whatever can't be read becomes an
`error`, of the document or of the object, and never ends the job.

A batch holds its files whole: for large files lower spark.sql.execution.arrow.maxRecordsPerBatch. Decoded streams are bounded
by `MOST_DECODED`. Encrypted files are marked; those that the empty password opens are decrypted. In others strings and
streams stay as they are, so the objects inside their object streams are missing and reported by an error.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..media import crypt, filters
from ..media.filters import MOST_DECODED

__all__ = ["MOST_DECODED", "parse", "files", "documents", "objects", "edges", "pages", "images", "image_draws", "image_references", "fonts", "glyphs", "profiles"]

GAP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
REFERENCE = re.compile(rb"([0-9]+)[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
HEADER = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\x0c\r ]+([0-9]{1,5})[\x00\t\n\x0c\r ]+obj|(?<![a-z])trailer")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Name(str):
    """A PDF name, without its slash."""


class Raw(bytes):
    """A string in parentheses, its escapes as they stand."""


class Operator(bytes):
    """A bare word: an operator of a content stream, or a keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = GAP.match(self.data, self.at).end()

    def value(self):
        """The next value or operator; EOFError at the end."""
        self.skip()
        d, at = self.data, self.at
        lead = d[at : at + 1]
        if not lead:
            raise EOFError("the data end in the middle")
        if lead == b"/":
            word = WORD.match(d, at + 1)
            self.at = word.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), word[0]).decode("latin-1"))
        if d[at : at + 2] == b"<<":
            self.at += 2
            flat = self.until(b">>")
            return {k: v for k, v in zip(flat[::2], flat[1::2], strict=False) if isinstance(k, Name)}
        if lead == b"<":
            end = d.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if lead == b"[":
            self.at += 1
            return self.until(b"]")
        if lead == b"(":
            return self.string()
        if lead in b")>]{}":
            self.at += 1
            return Operator(lead)
        if ref := REFERENCE.match(d, at):
            self.at = ref.end()
            return Ref(int(ref[1]))
        word = WORD.match(d, at)
        self.at = word.end()
        if NUMBER.match(word[0]):
            return float(word[0]) if b"." in word[0] else int(word[0])
        return {b"true": True, b"false": False, b"null": None}.get(word[0], Operator(word[0]))

    def until(self, close: bytes) -> list:
        out = []
        while True:
            self.skip()
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            out.append(self.value())

    def string(self) -> bytes:
        depth, start = 0, self.at
        for m in re.compile(rb"\\.|[()]", re.DOTALL).finditer(self.data, start):
            depth += (m[0] == b"(") - (m[0] == b")")
            if depth == 0:
                self.at = m.end()
                return Raw(self.data[start + 1 : m.start()])
        raise EOFError("a string does not end")


@dataclass
class Pdf:
    """A parsed file: objects by number, errors by number, and the trailer entries."""

    objects: dict[int, object] = field(default_factory=dict)
    gens: dict[int, int] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    encrypted: bool = False
    #: Why an encrypted file can't be read, if it can't.
    locked: str | None = None

    def get(self, x):
        """x, or what it refers to; a missing object is null, as is a circle of references."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        return None

    def head(self, x) -> dict:
        x = self.get(x)
        return x.head if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def filters(self, head: dict) -> list[str]:
        f = self.get(head.get("Filter"))
        return [str(self.get(x)) for x in (f if isinstance(f, list) else [] if f is None else [f])]

    def parms(self, head: dict) -> list[dict]:
        """The filters' parameters, one for each, their values resolved."""
        found, names = self.get(head.get("DecodeParms", head.get("DP"))), self.filters(head)
        each = found if isinstance(found, list) else [found]
        return [{str(k): self.get(v) for k, v in self.head(p).items()} for p in (each + [None] * len(names))[: len(names)]]

    def decoded(self, s: Stream) -> bytes:
        return filters.decoded(s.raw, self.filters(s.head), self.parms(s.head))[0]


def parse(data: bytes) -> Pdf:
    """The file's objects; ValueError if it is no PDF or has no catalog."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    pdf, at, packed = Pdf(), 0, {}
    places: dict[int, int] = {}
    while m := HEADER.search(data, at):
        lex = Lexer(data, m.end())
        try:
            value = lex.value()
            at = lex.at
            if m[1] is None:
                pdf.trailer |= value if isinstance(value, dict) else {}
                continue
            if isinstance(value, dict):
                value, at = with_stream(pdf, data, value, lex)
        except (EOFError, ValueError) as e:
            if m[1] is not None:
                pdf.errors[int(m[1])] = str(e)
            at = m.end()
            continue
        number = int(m[1])
        pdf.objects[number], pdf.gens[number], places[number] = value, int(m[2]), m.start()
        pdf.errors.pop(number, None)
        packed.pop(number, None)
        if isinstance(value, Stream):
            if value.head.get("Type") == "XRef":
                pdf.trailer |= {k: v for k, v in value.head.items() if k in ("Root", "Info", "Encrypt", "ID")}
            elif value.head.get("Type") == "ObjStm":
                packed[number] = m.start()
    unlock(pdf)
    for number, place in sorted(packed.items(), key=lambda x: x[1]):
        open_stream(pdf, number, pdf.objects[number], place, places)
    if not pdf.head(pdf.trailer.get("Root")):
        raise ValueError("no catalog")
    return pdf


def unlock(pdf: Pdf) -> None:
    """Decrypts an encrypted file's strings and streams, and takes its encryption away."""
    ref = pdf.trailer.get("Encrypt")
    entries = pdf.head(ref)
    if not entries:
        pdf.encrypted = pdf.get(ref) is not None
        return
    pdf.encrypted = True
    ids = pdf.get(pdf.trailer.get("ID"))
    first = plain(pdf.get(ids[0])) if isinstance(ids, list) and ids and isinstance(pdf.get(ids[0]), bytes) else b""
    known = {str(k): plain(v) if isinstance(v, bytes) else v for k, v in ((k, pdf.get(v)) for k, v in entries.items())}
    known["method"] = str(pdf.get(pdf.head(pdf.head(entries.get("CF")).get(str(pdf.get(entries.get("StmF", "Identity"))))).get("CFM", "Identity")))
    try:
        lock = crypt.Lock(known, first)
    except (ValueError, KeyError, TypeError) as e:
        pdf.locked = str(e) or "unknown encryption"
        return

    def opened(x, number: int, generation: int):
        if isinstance(x, Stream):
            kept = x.head.get("Type") == "XRef" or "Crypt" in pdf.filters(x.head)
            return Stream(opened(x.head, number, generation), x.raw if kept else lock.opened(x.raw, number, generation))
        if isinstance(x, dict):
            return {k: opened(v, number, generation) for k, v in x.items()}
        if isinstance(x, list):
            return [opened(v, number, generation) for v in x]
        return lock.opened(plain(x), number, generation) if isinstance(x, bytes) and not isinstance(x, Operator) else x

    own = ref.number if isinstance(ref, Ref) else None
    pdf.objects = {n: x if n == own else opened(x, n, pdf.gens[n]) for n, x in pdf.objects.items()}
    pdf.trailer.pop("Encrypt")


def with_stream(pdf: Pdf, data: bytes, head: dict, lex: Lexer) -> tuple[object, int]:
    """The dictionary, or the stream that follows it, and where it ends. A wrong or later defined length is replaced by the
    place of the next `endstream`."""
    lex.skip()
    if not data.startswith(b"stream", lex.at):
        return head, lex.at
    start = lex.at + 6
    start += 2 if data.startswith(b"\r\n", start) else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
    length = pdf.get(head.get("Length"))
    if isinstance(length, int) and length >= 0 and re.compile(rb"\s*endstream").match(data, start + length):
        return Stream(head, data[start : start + length]), start + length
    end = data.find(b"endstream", start)
    if end < 0:
        raise ValueError("a stream does not end")
    raw = data[start:end]
    return Stream(head, raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw), end


def open_stream(pdf: Pdf, number: int, s: Stream, place: int, places: dict[int, int]) -> None:
    """Takes in the objects of an object stream, but for those that are defined further on in the file."""
    try:
        body = pdf.decoded(s)
        lex = Lexer(body)
        pairs = [(lex.value(), lex.value()) for _ in range(int(pdf.get(s.head.get("N")) or 0))]
        first = int(pdf.get(s.head.get("First")) or 0)
        for inner, offset in pairs:
            if places.get(inner, -1) < place:
                pdf.objects[inner], pdf.gens[inner], places[inner] = Lexer(body, first + offset).value(), 0, place
                pdf.errors.pop(inner, None)
    except (EOFError, ValueError, TypeError, zlib.error) as e:
        pdf.errors[number] = str(e)


def references(value, key: str = "") -> Iterator[tuple[str, int]]:
    """(key path, object number) of every reference inside a value, in order."""
    if isinstance(value, Ref):
        yield key, value.number
    elif isinstance(value, Stream):
        yield from references(value.head, key)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from references(v, f"{key}/{k}" if key else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from references(v, key)


def pages_of(pdf: Pdf) -> Iterator[tuple[int | None, dict]]:
    """Object number and dictionary of the pages in order, with what they inherit; a node met again is passed over."""
    todo, seen = [(pdf.head(pdf.trailer.get("Root")).get("Pages"), {})], set()
    while todo:
        ref, above = todo.pop()
        number = ref.number if isinstance(ref, Ref) else None
        if number in seen:
            continue
        seen |= {number} - {None}
        node = pdf.head(ref)
        own = above | {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}
        kids = pdf.get(node.get("Kids"))
        if isinstance(kids, list) and node.get("Type") != "Page":
            todo += [(kid, own) for kid in reversed(kids)]
        elif node:
            yield number, node | own


def product(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def matrix(values) -> tuple:
    return tuple(map(float, values)) if isinstance(values, list) and len(values) == 6 and all(isinstance(x, int | float) for x in values) else IDENTITY


def contents(pdf: Pdf, page: dict) -> bytes:
    found = pdf.get(page.get("Contents"))
    return b"\n".join(pdf.decoded(s) for s in map(pdf.get, found if isinstance(found, list) else [found]) if isinstance(s, Stream))


ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
# What an escaped letter stands for in a string.
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def plain(x: bytes) -> bytes:
    """The bytes that a string stands for."""
    if not isinstance(x, Raw):
        return bytes(x)
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else ESCAPED.get(m[1], m[1]), x)


def appearances(pdf: Pdf, page: dict) -> Iterator[Stream]:
    """The normal, rollover and down appearances of a page's annotations, of each of their states."""
    found = pdf.get(page.get("Annots"))
    for annotation in found if isinstance(found, list) else []:
        look = pdf.head(pdf.head(annotation).get("AP"))
        for key in ("N", "R", "D"):
            x = pdf.get(look.get(key))
            for y in [x] if isinstance(x, Stream) else map(pdf.get, x.values()) if isinstance(x, dict) else []:
                if isinstance(y, Stream):
                    yield y


def named_images(pdf: Pdf) -> Iterator[tuple[int, int, str, int, bool]]:
    """(page index, number of the resources' holder, name, image number, of an annotation) of every image that the resources
    of pages, of forms within them, and of annotations' appearances name, in order of discovery. Resources met again, and
    circles of forms, are passed over; an image is named as often as different resources name it."""
    seen: set[int] = set()

    def walk(resources: dict, page: int, holder: int, note: bool) -> Iterator[tuple[int, int, str, int, bool]]:
        todo = [(resources, holder)]
        while todo:
            own, holder = todo.pop(0)
            if id(own) in seen:
                continue
            seen.add(id(own))
            for name, ref in pdf.head(own.get("XObject")).items():
                x = pdf.get(ref)
                if isinstance(x, Stream) and isinstance(ref, Ref):
                    if x.head.get("Subtype") == "Image":
                        yield page, holder, str(name), ref.number, note
                    elif x.head.get("Subtype") == "Form" and pdf.head(x.head.get("Resources")):
                        todo.append((pdf.head(x.head.get("Resources")), ref.number))

    for i, (number, page) in enumerate(pages_of(pdf)):
        yield from walk(pdf.head(page.get("Resources")), i, number or 0, False)
        for look in appearances(pdf, page):
            yield from walk(pdf.head(look.head.get("Resources")), i, number or 0, True)


def codes_of(font: dict, shown: bytes, pdf: Pdf) -> Iterator[int]:
    """The character codes of a shown string: two bytes each under the identity map of a composite font, else one."""
    if font.get("Subtype") != "Type0":
        yield from shown
        return
    if str(pdf.get(font.get("Encoding"))) not in ("Identity-H", "Identity-V"):
        raise ValueError("a composite font with a character map of its own")
    yield from (shown[k] << 8 | shown[k + 1] for k in range(0, len(shown) - 1, 2))


def shown_glyphs(pdf: Pdf) -> dict[int, dict[int, int]]:
    """By font number, the codes shown anywhere in the document and when each was last shown. Pages, forms, tiling patterns,
    annotations' appearances and glyphs of Type 3 fonts are followed. ValueError if any of it can't be read."""
    out: dict[int, dict[int, int]] = {}
    done: set[tuple[int, int]] = set()
    count = 0

    def show(font, shown: bytes) -> None:
        nonlocal count
        head = pdf.head(font)
        if not head:
            return
        if not isinstance(font, Ref):
            raise ValueError("a font that is no object")
        for code in codes_of(head, plain(shown), pdf):
            out.setdefault(font.number, {})[code] = (count := count + 1)
        if head.get("Subtype") == "Type3":
            for x in pdf.head(head.get("CharProcs")).values():
                if isinstance(pdf.get(x), Stream):
                    run(pdf.get(x), pdf.head(head.get("Resources")))

    def run(x: Stream | bytes, resources: dict) -> None:
        key = (id(x), id(resources))
        if isinstance(x, Stream):
            if key in done:
                return
            done.add(key)
        lex, operands, saved, font = Lexer(pdf.decoded(x) if isinstance(x, Stream) else x), [], [], None
        fonts, objects = pdf.head(resources.get("Font")), pdf.head(resources.get("XObject"))
        for pattern in map(pdf.get, pdf.head(resources.get("Pattern")).values()):
            if isinstance(pattern, Stream):
                run(pattern, pdf.head(pattern.head.get("Resources")))
        while True:
            try:
                token = lex.value()
            except EOFError:
                return
            if not isinstance(token, Operator):
                operands.append(token)
                continue
            if token == b"q":
                saved.append(font)
            elif token == b"Q" and saved:
                font = saved.pop()
            elif token == b"Tf" and len(operands) > 1:
                font = fonts.get(operands[-2])
            elif token == b"gs" and operands:
                own = pdf.get(pdf.head(pdf.head(resources.get("ExtGState")).get(operands[-1])).get("Font"))
                font = own[0] if isinstance(own, list) and own else font
            elif token in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
                show(font, operands[-1])
            elif token == b"TJ" and operands and isinstance(operands[-1], list):
                for part in operands[-1]:
                    if isinstance(part, bytes):
                        show(font, part)
            elif token == b"ID":
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(lex.data, lex.at)
                lex.at = end.end() if end else len(lex.data)
            elif token == b"Do" and operands and isinstance(operands[-1], Name):
                form = pdf.get(objects.get(operands[-1]))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Form":
                    run(form, pdf.head(form.head.get("Resources")) or resources)
            operands = []

    for _, page in pages_of(pdf):
        run(contents(pdf, page), pdf.head(page.get("Resources")))
        for look in appearances(pdf, page):
            run(look, pdf.head(look.head.get("Resources")))
    return out


def draws(pdf: Pdf, body: bytes, resources: dict, at: tuple = IDENTITY, within: frozenset = frozenset()) -> Iterator[tuple[int, tuple]]:
    """(image number, matrix) of every image painted; forms are followed unless they contain themselves, inline images pass."""
    lex, operands, saved = Lexer(body), [], []
    objects = pdf.head(resources.get("XObject"))
    while True:
        try:
            token = lex.value()
        except EOFError:
            return
        if not isinstance(token, Operator):
            operands.append(token)
            continue
        if token == b"q":
            saved.append(at)
        elif token == b"Q" and saved:
            at = saved.pop()
        elif token == b"cm":
            at = product(matrix(operands[-6:]), at)
        elif token == b"ID":
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(body, lex.at)
            lex.at = end.end() if end else len(body)
        elif token == b"Do" and operands and isinstance(operands[-1], Name):
            ref = objects.get(operands[-1])
            x = pdf.get(ref)
            if isinstance(ref, Ref) and isinstance(x, Stream):
                if x.head.get("Subtype") == "Image":
                    yield ref.number, at
                elif x.head.get("Subtype") == "Form" and ref.number not in within:
                    own = pdf.head(x.head.get("Resources")) or resources
                    yield from draws(pdf, pdf.decoded(x), own, product(matrix(pdf.get(x.head.get("Matrix"))), at), within | {ref.number})
        operands = []


# Rows of each table for one file. A document that can't be read has none, but for its own row.

DOCUMENTS = "path string, length long, pages int, objects int, encrypted boolean, error string"
OBJECTS = "path string, obj_num int, gen int, kind string, type string, subtype string, stream_len long, error string"
EDGES = "path string, src int, dst int, key string"
PAGES = "path string, page_idx int, obj_num int, media_w double, media_h double, rotate int"
IMAGES = "path string, image_id int, w int, h int, bpc int, color_space string, filters string, stencil boolean, soft_mask int, encoded_len long, content binary, components int, info string, mask_content binary"
REFERENCES = "path string, ref_idx int, page_idx int, holder int, name string, image_id int, annotation boolean"
FONTS = "path string, font_id int, type0_id int, kind string, name string, descriptor int, program string, program_id int, length1 long, stored_len long, symbolic boolean, embedded boolean"
GLYPHS = "path string, font_id int, code int, cid int, gid int, seq long, error string"
PROFILES = "path string, array_idx int, stream_id int, components int, content binary"
DRAWS = "path string, page_idx int, draw_seq int, image_id int, scale_x double, shear_y double, shear_x double, scale_y double, error string"
KINDS = {Stream: "stream", dict: "dict", list: "array", Name: "name", bytes: "string", Raw: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def text(x) -> str | None:
    return str(x) if isinstance(x, Name) else None


def whole(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 2**31 else None


def object_rows(pdf: Pdf) -> Iterator[tuple]:
    for n in sorted(pdf.objects.keys() | pdf.errors.keys()):
        x, head = pdf.objects.get(n), pdf.head(Ref(n))
        kind = KINDS.get(type(x), "other") if n in pdf.objects else None
        yield n, pdf.gens.get(n), kind, text(pdf.get(head.get("Type"))), text(pdf.get(head.get("Subtype"))), len(x.raw) if isinstance(x, Stream) else None, pdf.errors.get(n)


def edge_rows(pdf: Pdf) -> Iterator[tuple]:
    """The trailer is node 0."""
    for n, x in [(0, pdf.trailer), *sorted(pdf.objects.items())]:
        for key, to in references(x):
            yield n, to, key


def page_rows(pdf: Pdf) -> Iterator[tuple]:
    for i, (n, page) in enumerate(pages_of(pdf)):
        box = [pdf.get(x) for x in pdf.get(page.get("MediaBox")) or []]
        sized = len(box) == 4 and all(isinstance(x, int | float) for x in box)
        yield i, n, float(abs(box[2] - box[0])) if sized else None, float(abs(box[3] - box[1])) if sized else None, (whole(pdf.get(page.get("Rotate"))) or 0) % 360


SPACES = {"DeviceGray": "Gray", "G": "Gray", "CalGray": "Gray", "DeviceRGB": "RGB", "RGB": "RGB", "CalRGB": "RGB", "DeviceCMYK": "CMYK", "CMYK": "CMYK"}


def space_of(pdf: Pdf, value) -> tuple[str | None, str | None, bytes]:
    """Gray, RGB, CMYK, Indexed, or null for others; of an indexed space also its base and palette."""
    value = pdf.get(value)
    if isinstance(value, Name):
        return SPACES.get(value), None, b""
    kind = pdf.get(value[0]) if isinstance(value, list) and value else None
    if kind == "ICCBased" and len(value) > 1:
        return {1: "Gray", 3: "RGB", 4: "CMYK"}.get(pdf.get(pdf.head(value[1]).get("N"))), None, b""
    if kind in ("Indexed", "I") and len(value) > 3:
        table = pdf.get(value[3])
        return "Indexed", space_of(pdf, value[1])[0], pdf.decoded(table) if isinstance(table, Stream) else plain(table) if isinstance(table, bytes) else b""
    return SPACES.get(kind), None, b""


def described(pdf: Pdf, x: Stream) -> dict:
    """What a decoder needs to know of an image besides its bytes."""
    mask = pdf.get(x.head.get("ImageMask")) is True
    space, base, palette = ("Gray", None, b"") if mask else space_of(pdf, x.head.get("ColorSpace"))
    w, h, bits = (whole(pdf.get(x.head.get(k))) for k in ("Width", "Height", "BitsPerComponent"))
    decode = pdf.get(x.head.get("Decode"))
    simple = [{k: v for k, v in p.items() if isinstance(v, int | float | bool)} for p in pdf.parms(x.head)]
    return {"w": w, "h": h, "bpc": 1 if mask else bits or 8, "space": space, "base": base, "palette": palette.hex(), "filters": pdf.filters(x.head), "parms": simple,
            "decode": [float(v) for v in decode if isinstance(v, int | float)] if isinstance(decode, list) else []}


def image_rows(pdf: Pdf) -> Iterator[tuple]:
    for n, x in sorted(pdf.objects.items()):
        if isinstance(x, Stream) and pdf.get(x.head.get("Subtype")) == "Image":
            space = pdf.get(x.head.get("ColorSpace"))
            mask = x.head.get("SMask")
            soft = pdf.get(mask)
            try:
                info = described(pdf, x) | {"mask": described(pdf, soft) if isinstance(soft, Stream) else None}
            except (ValueError, TypeError, KeyError, zlib.error):
                info = {}
            yield (n, *(whole(pdf.get(x.head.get(k))) for k in ("Width", "Height", "BitsPerComponent")), text(pdf.get(space[0]) if isinstance(space, list) and space else space), ",".join(pdf.filters(x.head)),
                   pdf.get(x.head.get("ImageMask")) is True, mask.number if isinstance(mask, Ref) else None, len(x.raw), x.raw, {"Gray": 1, "RGB": 3, "CMYK": 4, "Indexed": 1}.get(info.get("space")),
                   json.dumps(info), soft.raw if isinstance(soft, Stream) else None)


def reference_rows(pdf: Pdf) -> Iterator[tuple]:
    for k, row in enumerate(named_images(pdf)):
        yield k, *row


def font_rows(pdf: Pdf) -> Iterator[tuple]:
    """Every font that has a descriptor of its own or in its descendant. A composite font goes by its descendant."""
    for n, x in sorted(pdf.objects.items()):
        if not isinstance(x, dict) or x.get("Type") != "Font" or x.get("Subtype") in ("CIDFontType0", "CIDFontType2"):
            continue
        child = None
        if x.get("Subtype") == "Type0":
            found = pdf.get(x.get("DescendantFonts"))
            child = found[0] if isinstance(found, list) and found else None
        own = pdf.head(child) if child is not None else x
        ref = own.get("FontDescriptor")
        head = pdf.head(ref)
        if not head:
            continue
        key, program = next(((k, p) for k, p in (("FontFile2", "TrueType"), ("FontFile3", "CFF"), ("FontFile", "Type1")) if isinstance(pdf.get(head.get(k)), Stream)), (None, None))
        file = pdf.get(head.get(key)) if key else None
        flags = pdf.get(head.get("Flags"))
        kind = "composite" if own.get("Subtype") == "CIDFontType2" else "simple" if x.get("Subtype") == "TrueType" else "other"
        yield (child.number if isinstance(child, Ref) else n, n if child is not None else None, kind, text(pdf.get(x.get("BaseFont"))), ref.number if isinstance(ref, Ref) else None, program,
               head[key].number if key and isinstance(head[key], Ref) else None, whole(pdf.get(file.head.get("Length1"))) if file else None, len(file.raw) if file else None,
               isinstance(flags, int) and bool(flags & 4), file is not None)


def glyph_rows(pdf: Pdf) -> Iterator[tuple]:
    """One row for each font and code shown; a document whose text can't all be read has one row with its error."""
    try:
        shown = shown_glyphs(pdf)
    except (ValueError, TypeError, RecursionError, zlib.error) as e:
        yield None, None, None, None, None, str(e)
        return
    for n, codes in sorted(shown.items()):
        font = pdf.head(Ref(n))
        if font.get("Subtype") == "Type0":
            found = pdf.get(font.get("DescendantFonts"))
            child = found[0] if isinstance(found, list) and found else None
            table = pdf.get(pdf.head(child).get("CIDToGIDMap"))
            try:
                places = pdf.decoded(table) if isinstance(table, Stream) else None
            except (ValueError, zlib.error):
                continue
            for code, seq in sorted(codes.items()):
                yield child.number if isinstance(child, Ref) else n, code, code, code if places is None else int.from_bytes(places[2 * code : 2 * code + 2], "big"), seq, None
        else:
            for code, seq in sorted(codes.items()):
                yield n, code, None, None, seq, None


def profile_rows(pdf: Pdf) -> Iterator[tuple]:
    """Every array [/ICCBased profile] that the catalog reaches, in order of discovery."""
    todo, seen, k = [pdf.trailer.get("Root")], set(), 0
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            if x.number in seen:
                continue
            seen.add(x.number)
            x = pdf.get(x)
        if isinstance(x, list):
            if len(x) > 1 and pdf.get(x[0]) == "ICCBased" and isinstance(x[1], Ref) and isinstance(pdf.get(x[1]), Stream):
                s = pdf.get(x[1])
                yield k, x[1].number, whole(pdf.get(s.head.get("N"))), s.raw
                k += 1
            todo += reversed(x)
        elif isinstance(x, Stream | dict):
            todo += reversed((x.head if isinstance(x, Stream) else x).values())


def draw_rows(pdf: Pdf) -> Iterator[tuple]:
    for i, (_, page) in enumerate(pages_of(pdf)):
        k = 0
        try:
            for k, (n, m) in enumerate(draws(pdf, contents(pdf, page), pdf.head(page.get("Resources"))), 1):
                yield i, k - 1, n, *m[:4], None
        except (ValueError, TypeError, RecursionError, zlib.error) as e:
            yield i, k, None, None, None, None, None, str(e)


def document_row(length: int, pdf: Pdf | None, error: str | None) -> Iterator[tuple]:
    if pdf is None:
        yield length, None, None, None, error
    else:
        yield length, sum(1 for _ in pages_of(pdf)), len(pdf.objects), pdf.encrypted, None


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def table(raw: DataFrame, schema: str, rows: Callable[[Pdf], Iterator[tuple]] | None) -> DataFrame:
    """One table of the files `raw(path, length, content)`; without `rows` it is the documents' own. Null content is an error."""
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: its rows leave before the next is parsed
                path, length, data = (batch.column(x)[k].as_py() for x in ("path", "length", "content"))
                pdf = error = None
                try:
                    pdf = parse(data or b"")
                except (ValueError, TypeError, RecursionError, zlib.error) as e:
                    error = str(e)
                out = list(document_row(length, pdf, error) if rows is None else rows(pdf) if pdf else [])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), *(pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(kind)[1:], strict=True))], schema=kind)

    return raw.select("path", "length", "content").mapInArrow(run, schema)


#: The tables by name, with their rows.
TABLES = {
    "objects": (OBJECTS, object_rows), "edges": (EDGES, edge_rows), "pages": (PAGES, page_rows), "images": (IMAGES, image_rows), "draws": (DRAWS, draw_rows), "references": (REFERENCES, reference_rows),
    "fonts": (FONTS, font_rows), "glyphs": (GLYPHS, glyph_rows), "profiles": (PROFILES, profile_rows),
}


def gathered(raw: DataFrame, *names: str) -> DataFrame:
    """path and, for each name, an array of the table's rows: the files are parsed once for all of them. one() takes a table
    out of it; a file that can't be read has nulls."""
    inner = {x: TABLES[x][0].partition(", ")[2] for x in names}
    schema = "path string, " + ", ".join(f"{x} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in own.split(', '))}>>" for x, own in inner.items())
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                try:
                    pdf = parse(data or b"")
                except (ValueError, TypeError, RecursionError, zlib.error):
                    pdf = None
                out = [pa.array([path], pa.string())]
                for x, f in zip(names, list(kind)[1:], strict=True):
                    keys = [c.split()[0] for c in inner[x].split(", ")]
                    out.append(pa.array([None if pdf is None else [dict(zip(keys, row, strict=True)) for row in TABLES[x][1](pdf)]], f.type))
                yield pa.RecordBatch.from_arrays(out, schema=kind)

    return raw.select("path", "content").mapInArrow(run, schema)


def one(tables: DataFrame, name: str) -> DataFrame:
    """A table of gathered()."""
    return tables.select("path", F.inline(name))


def documents(raw: DataFrame) -> DataFrame:
    return table(raw, DOCUMENTS, None)


def objects(raw: DataFrame) -> DataFrame:
    return table(raw, OBJECTS, object_rows)


def edges(raw: DataFrame) -> DataFrame:
    return table(raw, EDGES, edge_rows)


def pages(raw: DataFrame) -> DataFrame:
    return table(raw, PAGES, page_rows)


def images(raw: DataFrame) -> DataFrame:
    return table(raw, IMAGES, image_rows)


def image_draws(raw: DataFrame) -> DataFrame:
    return table(raw, DRAWS, draw_rows)


def image_references(raw: DataFrame) -> DataFrame:
    return table(raw, REFERENCES, reference_rows)


def fonts(raw: DataFrame) -> DataFrame:
    return table(raw, FONTS, font_rows)


def glyphs(raw: DataFrame) -> DataFrame:
    return table(raw, GLYPHS, glyph_rows)


def profiles(raw: DataFrame) -> DataFrame:
    return table(raw, PROFILES, profile_rows)


def without_private(edge: DataFrame, obj: DataFrame, metadata: bool = True) -> DataFrame:
    """The edges left once private data are stripped: /PieceInfo of catalog and pages, /Thumb of pages and, with `metadata`,
    /Metadata of the catalog and /Info of the trailer."""
    of = obj.select("path", F.col("obj_num").alias("src"), "type")
    top = F.substring_index("key", "/", 1)
    owner = F.coalesce(F.col("type"), F.lit(""))
    gone = (owner.isin("Catalog", "Page") & (top == "PieceInfo")) | ((owner == "Page") & (top == "Thumb"))
    if metadata:
        gone = gone | ((owner == "Catalog") & (top == "Metadata")) | ((F.col("src") == 0) & (top == "Info"))
    return edge.join(of, ["path", "src"], "left").where(~gone).select("path", "src", "dst", "key")

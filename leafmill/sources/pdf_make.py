"""Making small PDF files, for examples and tests."""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fax
from leafmill.sources.pdf_model import _PAD as PAD
from leafmill.sources.pdf_model import Name, Ref, Stream, rc4, written

LINES = 50


def assembled(objects: dict[int, object], root: int = 1, **trailer: object) -> bytes:
    """A file of numbered objects with a trailer, without a cross-reference table that means anything."""
    out = bytearray(b"%PDF-1.4\n")
    for n, o in objects.items():
        out += b"%d 0 obj\n" % n + written(o) + b"\nendobj\n"
    d = {b"Root": Ref(root), b"Size": len(objects) + 1} | {k.encode(): v for k, v in trailer.items()}
    return bytes(out) + b"trailer\n" + written(d) + b"\nstartxref\n0\n%%EOF"


def text_pdf(text: str) -> bytes:
    """A file that shows a text, LINES lines a page, one byte a character ('?' for those outside Latin-1)."""
    lines = text.split("\n") if text else []
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]
    first = 4
    objects: dict[int, object] = {
        1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2)},
        2: {b"Type": Name(b"Pages"), b"Count": len(pages), b"Kids": [Ref(first + 2 * i) for i in range(len(pages))], b"Resources": {b"Font": {b"F1": Ref(3)}}},
        3: {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Helvetica")},
    }
    for i, page in enumerate(pages):
        shown = b"".join(b"0 -14 Td " + written(x.encode("latin-1", "replace")) + b" Tj\n" for x in page)
        objects[first + 2 * i] = {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(first + 2 * i + 1), b"MediaBox": [0, 0, 595, 842]}
        objects[first + 2 * i + 1] = Stream({}, b"BT /F1 10 Tf 40 800 Td\n" + shown + b"ET")
    return assembled(objects)


def from_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, content: a file for each text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_pdf(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id string, content binary")


# ---- data in filters, images, protected files


def run_lengths(data: bytes) -> bytes:
    """Run-length data of literals alone."""
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def lzw(data: bytes) -> bytes:
    """LZW data of single bytes; the table is cleared before codes grow."""
    out, step = bytearray(), 1600  # eight runs of 201 codes end with a whole byte
    for at in range(0, len(data) or 1, step):
        codes = []
        for i in range(at, min(at + step, len(data)), 200):
            codes += [256, *data[i : i + 200]]
        if at + step >= len(data):
            codes += [256, 257]
        bits = "".join(f"{c:09b}" for c in codes)
        bits += "0" * (-len(bits) % 8)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big")
    return bytes(out)


def png_rows(data: bytes, columns: int) -> tuple[bytes, dict]:
    """Rows of bytes with the five PNG predictors in turn, deflated, and the parameters that undo them."""
    out, before = bytearray(), bytes(columns)
    for k in range(0, len(data), columns):
        row = data[k : k + columns].ljust(columns, b"\0")
        kind = (k // columns) % 5
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        before = row
    return zlib.compress(bytes(out)), {b"Predictor": 15, b"Columns": columns}


def filtered(data: bytes, kind: int) -> Stream:
    """Data in one of several chains of filters."""
    name = lambda *x: [Name(n) for n in x]
    if kind == 0:
        return Stream({b"Filter": Name(b"FlateDecode")}, zlib.compress(data))
    if kind == 1:
        return Stream({b"Filter": Name(b"ASCIIHexDecode")}, binascii.hexlify(data) + b">")
    if kind == 2:
        return Stream({b"Filter": name(b"ASCII85Decode", b"FlateDecode")}, base64.a85encode(zlib.compress(data)) + b"~>")
    if kind == 3:
        return Stream({b"Filter": Name(b"RunLengthDecode")}, run_lengths(data))
    if kind == 4:
        return Stream({b"Filter": name(b"LZW")}, lzw(data))
    packed, parms = png_rows(data, 32)
    return Stream({b"Filter": Name(b"FlateDecode"), b"DecodeParms": parms}, packed)


FILTERS = 6


def fax_lines(plane: np.ndarray, marks: bool = False, aligned: bool = False) -> bytes:
    """One-dimensional fax data, each row with a mark before it, or from a whole byte on."""
    out = ""
    for row in plane:
        out += "0" * (-len(out) % 8 if aligned else 0) + (fax.END_OF_LINE if marks else "")
        ends = [*fax.changes(row), len(row)]
        black, at = False, 0
        for end in ends:
            out += fax._run_code(end - at, black)
            black, at = not black, end
    out += "0" * (-len(out) % 8)
    return int(out or "0", 2).to_bytes(len(out) // 8, "big")


def image(width: int, height: int, data: bytes, filters: list[bytes], space: object, **more: object) -> Stream:
    d = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": width, b"Height": height, b"ColorSpace": space, b"BitsPerComponent": 8, b"Filter": [Name(f) for f in filters] if len(filters) != 1 else Name(filters[0])}
    return Stream(d | {k.encode(): v for k, v in more.items()}, data)


def page_of(images: list[Stream], text: bytes = b"x", **more: object) -> dict[int, object]:
    """Objects of a file with one page that shows a text and images (objects 10, 11, ...)."""
    names = {b"Im%d" % i: Ref(10 + i) for i in range(len(images))}
    shown = b" ".join(b"/Im%d Do" % i for i in range(len(images)))
    objects: dict[int, object] = {
        1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2)}, 2: {b"Type": Name(b"Pages"), b"Count": 1, b"Kids": [Ref(3)]},
        3: {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(4), b"Resources": {b"Font": {b"F1": Ref(5)}, b"XObject": names}}, 5: {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1")},
        4: Stream({}, b"BT /F1 9 Tf " + written(text) + b" Tj ET " + shown),
    }
    objects |= {10 + i: s for i, s in enumerate(images)}
    return objects | {int(k[1:]): v for k, v in more.items()}


def locked(objects: dict[int, object], password: bytes, stream: int) -> bytes:
    """A file that a password opens (40-bit RC4), with one encrypted stream."""
    ident, owner = b"0123456789abcdef", b"o" * 32
    key = hashlib.md5((password + PAD)[:32] + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()[:5]
    own = hashlib.md5(key + stream.to_bytes(4, "little")[:3] + b"\0\0").digest()[:10]
    s = objects[stream]
    lock = {b"Filter": Name(b"Standard"), b"V": 1, b"R": 2, b"O": owner, b"P": -4, b"U": rc4(key, PAD)}
    top = max(objects) + 1
    return assembled(objects | {stream: Stream(s.dict, rc4(own, s.data)), top: lock}, Encrypt=Ref(top), ID=[ident, ident])


# ---- fonts


def truetype(n: int = 5) -> bytes:
    """A font of n glyphs; the last is composed of the second."""
    simple = struct.pack(">hhhhh", 1, 0, 0, 9, 9) + bytes(range(22))
    glyphs = [simple] * (n - 1) + [struct.pack(">hhhhh", -1, 0, 0, 9, 9) + struct.pack(">HHBB", 0, 1, 0, 0) + b"\0\0"]
    glyf = b"".join(g + b"\0" * (-len(g) % 4) for g in glyphs)
    places, at = [0], 0
    for g in glyphs:
        at += len(g) + -len(g) % 4
        places.append(at)
    tables = {b"glyf": glyf, b"head": bytes(50) + b"\0\1" + bytes(2), b"loca": struct.pack(f">{n + 1}I", *places), b"maxp": b"\0\1\0\0" + struct.pack(">H", n)}
    out, body = b"\0\1\0\0" + struct.pack(">4H", 4, 64, 2, 0), b""
    for k in sorted(tables):
        out += k + struct.pack(">3I", 0, 12 + 64 + len(body), len(tables[k]))
        body += tables[k] + b"\0" * (-len(tables[k]) % 4)
    return out + body


def cff(n: int = 5) -> bytes:
    """A CID-keyed program of n glyphs, CIDs 0, 10, 11, ..."""

    def index(*items: bytes) -> bytes:
        if not items:
            return b"\0\0"
        offsets, at = [1], 1
        for i in items:
            at += len(i)
            offsets.append(at)
        return len(items).to_bytes(2, "big") + b"\2" + b"".join(o.to_bytes(2, "big") for o in offsets) + b"".join(items)

    number = lambda x: b"\x1d" + x.to_bytes(4, "big")
    head = b"\1\0\4\2" + index(b"F")
    size = len(index(number(0) * 3 + b"\x0c\x1e" + number(0) + b"\x0f" + number(0) + b"\x11"))
    charset = len(head) + size + 2 + 2
    strings = charset + 4
    top = number(0) * 3 + b"\x0c\x1e" + number(charset) + b"\x0f" + number(strings) + b"\x11"
    return head + index(top) + index() + index() + b"\1" + (10).to_bytes(2, "big") + bytes([n - 2]) + index(*[bytes([100 + g]) * 40 + b"\x0e" for g in range(n)])


def font_file(data: bytes, subtype: bytes, key: bytes, shown: bytes, more: dict | None = None) -> bytes:
    """A file with one page that shows a text of an embedded composite font."""
    return assembled(
        {
            1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2)}, 2: {b"Type": Name(b"Pages"), b"Kids": [Ref(3)], b"Count": 1},
            3: {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(4), b"Resources": {b"Font": {b"F1": Ref(5)}}, **(more or {})}, 4: Stream({}, b"BT /F1 9 Tf " + written(shown) + b" Tj ET"),
            5: {b"Type": Name(b"Font"), b"Subtype": Name(b"Type0"), b"Encoding": Name(b"Identity-H"), b"DescendantFonts": [Ref(6)]},
            6: {b"Type": Name(b"Font"), b"Subtype": Name(subtype), b"FontDescriptor": Ref(7)}, 7: {b"Type": Name(b"FontDescriptor"), key: Ref(8)}, 8: Stream({}, data),
        }
    )

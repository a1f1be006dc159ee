"""Font programs: which glyphs they hold, and leaving out those that aren't used.

Glyph numbers stay as they are, so nothing that refers to them changes: an unused TrueType
outline becomes empty, an unused CFF charstring ends at once.
"""

from __future__ import annotations

import struct


class FontError(ValueError):
    """A font program that can't be read safely."""


def _u16(d: bytes, at: int) -> int:
    if at < 0 or at + 2 > len(d):
        raise FontError("cut off")
    return int.from_bytes(d[at : at + 2], "big")


def _u32(d: bytes, at: int) -> int:
    return _u16(d, at) << 16 | _u16(d, at + 2)


# ---- TrueType


def tables_of(data: bytes) -> dict[bytes, tuple[int, int]]:
    """(offset, length) of each table of an sfnt file."""
    out = {}
    for i in range(_u16(data, 4)):
        at = 12 + 16 * i
        begin, size = _u32(data, at + 8), _u32(data, at + 12)
        if begin + size > len(data):
            raise FontError("table out of the file")
        out[data[at : at + 4]] = (begin, size)
    return out


def _outlines(data: bytes) -> tuple[list[int], bytes, int]:
    t = tables_of(data)
    if not {b"head", b"loca", b"glyf", b"maxp"} <= set(t):
        raise FontError("no outlines")
    wide, n = _u16(data, t[b"head"][0] + 50), _u16(data, t[b"maxp"][0] + 4)
    at, glyf = t[b"loca"][0], data[t[b"glyf"][0] : t[b"glyf"][0] + t[b"glyf"][1]]
    places = [_u32(data, at + 4 * i) if wide else 2 * _u16(data, at + 2 * i) for i in range(n + 1)]
    if places != sorted(places) or places[-1] > len(glyf):
        raise FontError("glyph places")
    return places, glyf, wide


def with_parts(places: list[int], glyf: bytes, used: set[int]) -> set[int]:
    """Glyphs with those that they are composed of; always .notdef."""
    out, todo = set(), [0, *used]
    while todo:
        g = todo.pop()
        if g in out or not 0 <= g < len(places) - 1:
            continue
        out.add(g)
        d = glyf[places[g] : places[g + 1]]
        if len(d) < 10 or d[0] < 0x80:
            continue
        at = 10
        while True:
            flags = _u16(d, at)
            todo.append(_u16(d, at + 2))
            at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 0x40 else 8 if flags & 0x80 else 0)
            if not flags & 0x20:
                break
    return out


def subset_truetype(data: bytes, used: set[int]) -> bytes:
    """The font with only the used glyphs' outlines."""
    places, glyf, wide = _outlines(data)
    keep = with_parts(places, glyf, used)
    body, loca = bytearray(), []
    for g in range(len(places) - 1):
        loca.append(len(body))
        if g in keep:
            body += glyf[places[g] : places[g + 1]]
            body += b"\0" * (-len(body) % 4)
    loca.append(len(body))
    packed = struct.pack(f">{len(loca)}I", *loca) if wide else struct.pack(f">{len(loca)}H", *[x // 2 for x in loca])
    parts = {k: data[a : a + n] for k, (a, n) in tables_of(data).items() if k not in (b"DSIG",)} | {b"glyf": bytes(body), b"loca": packed}
    n = len(parts)
    power = 1 << (n.bit_length() - 1)
    head = data[:4] + struct.pack(">4H", n, 16 * power, power.bit_length() - 1, 16 * (n - power))
    at, directory, out = 12 + 16 * n, b"", b""
    for k in sorted(parts):
        d = parts[k] + b"\0" * (-len(parts[k]) % 4)
        total = sum(struct.unpack(f">{len(d) // 4}I", d)) & 0xFFFFFFFF
        directory += k + struct.pack(">3I", total, at + len(out), len(parts[k]))
        out += d
    return head + directory + out


# ---- CFF


def cff_of(data: bytes) -> tuple[int, int]:
    """(begin, end) of the CFF table in an OpenType file, or of the whole bare program."""
    if data[:4] == b"OTTO":
        t = tables_of(data)
        if b"CFF " not in t:
            raise FontError("no CFF table")
        return t[b"CFF "][0], sum(t[b"CFF "])
    return 0, len(data)


def _index(d: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """Ranges of an INDEX's items, and where it ends."""
    n = _u16(d, at)
    if not n:
        return [], at + 2
    size = d[at + 2] if at + 2 < len(d) else 0
    if not 1 <= size <= 4:
        raise FontError("offset size")
    base = at + 3 + (n + 1) * size - 1
    if base > len(d):
        raise FontError("cut off")
    offsets = [int.from_bytes(d[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    if offsets[0] != 1 or offsets != sorted(offsets) or base + offsets[-1] > len(d):
        raise FontError("offsets")
    return [(base + a, base + b) for a, b in zip(offsets, offsets[1:])], base + offsets[-1]


def _dict(d: bytes) -> dict[int, list[int]]:
    """Operators of a DICT with their whole-number operands; two-byte ones as 1200 + number. Reals are left out."""
    out: dict[int, list[int]] = {}
    operands: list[int] = []
    i = 0
    while i < len(d):
        b = d[i]
        if b <= 21:
            op, i = (1200 + d[i + 1], i + 2) if b == 12 and i + 1 < len(d) else (b, i + 1)
            out[op], operands = operands, []
        elif b == 28:
            operands.append(int.from_bytes(d[i + 1 : i + 3], "big", signed=True))
            i += 3
        elif b == 29:
            operands.append(int.from_bytes(d[i + 1 : i + 5], "big", signed=True))
            i += 5
        elif b == 30:
            i += 1
            while i < len(d) and d[i] & 15 != 15 and d[i] >> 4 != 15:
                i += 1
            i += 1
        elif 32 <= b <= 246:
            operands.append(b - 139)
            i += 1
        elif 247 <= b <= 254:
            low = d[i + 1] if i + 1 < len(d) else 0
            operands.append((b - 247) * 256 + low + 108 if b < 251 else -(b - 251) * 256 - low - 108)
            i += 2
        else:
            raise FontError("DICT")
    return out


class Cff:
    """A bare CFF program: glyphs (ranges of charstrings), cid_keyed, and cids by glyph."""

    def __init__(self, data: bytes):
        if len(data) < 4 or data[0] != 1:
            raise FontError("version")
        self.data = data
        _, at = _index(data, data[2])
        top, _ = _index(data, at)
        if len(top) != 1:
            raise FontError("one font expected")
        self.top = _dict(data[top[0][0] : top[0][1]])
        place = (self.top.get(17) or [0])[-1]
        if not 0 < place < len(data):
            raise FontError("charstrings")
        self.glyphs, _ = _index(data, place)
        self.cid_keyed = 1230 in self.top

    def cids(self) -> list[int]:
        """The CID of each glyph. FontError if one stands twice."""
        n, at = len(self.glyphs), (self.top.get(15) or [0])[-1]
        out = [0]
        if at <= 2:
            raise FontError("predefined charset")
        kind, at = self.data[at], at + 1
        while len(out) < n:
            first = _u16(self.data, at)
            if kind == 0:
                out.append(first)
                at += 2
            elif kind in (1, 2):
                more = self.data[at + 2] if kind == 1 else _u16(self.data, at + 2)
                out += range(first, min(first + more + 1, first + n))
                at += 3 if kind == 1 else 4
            else:
                raise FontError("charset")
        out = out[:n]
        if len(set(out)) != n:
            raise FontError("a CID twice")
        return out


def subset_cff(data: bytes, used: set[int]) -> bytes:
    """The program (bare or in OpenType) in which glyphs that aren't used end at once."""
    begin, end = cff_of(data)
    font = Cff(data[begin:end])
    out = bytearray(data)
    for g, (a, b) in enumerate(font.glyphs):
        if g and g not in used:
            out[begin + a : begin + b] = b"\x0e" * (b - a)
    return bytes(out)

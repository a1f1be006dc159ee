"""JPEG 2000: codestreams and files to planes.

Packets of every progression order, code blocks by the arithmetic decoder, both wavelets,
component transforms and subsampled components. What is rare in documents is refused: regions
of interest, packed headers, changes of the progression, and code block styles other than
resets and segmentation marks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from leafmill.functions.jbig2 import Decoder

MOST_PIXELS = 100_000_000
#: Lifting factors of the irreversible wavelet and its scale.
ALPHA, BETA, GAMMA, DELTA, SCALE = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001
#: Colour spaces of files.
SRGB, GRAY, SYCC = 16, 17, 18


class JpxError(ValueError):
    pass


def _up(a: int, b: int) -> int:
    return -(-a // b)


def _int(d: bytes, at: int, size: int) -> int:
    if at + size > len(d):
        raise JpxError("cut off")
    return int.from_bytes(d[at : at + size], "big")


def codestream(data: bytes) -> tuple[bytes, int | None]:
    """The codestream of a file, or data that is one, and the colour space that the file names."""
    if data[:4] == b"\xff\x4f\xff\x51":
        return data, None
    space, found, todo = None, None, [(0, len(data))]
    while todo:
        at, end = todo.pop(0)
        while at + 8 <= end:
            size, kind, head = _int(data, at, 4), data[at + 4 : at + 8], 8
            if size == 1:
                size, head = _int(data, at + 8, 8), 16
            size = size or end - at
            if size < head or at + size > end:
                size = end - at
            if kind == b"jp2h":
                todo.append((at + head, at + size))
            elif kind == b"colr" and data[at + head : at + head + 1] == b"\1" and space is None:
                space = _int(data, at + head + 3, 4)
            elif kind == b"jp2c" and found is None:
                found = data[at + head : at + size]
            at += size
    if not found:
        raise JpxError("no codestream")
    return found, space


@dataclass
class Coding:
    """How a component's code blocks are made."""

    levels: int
    block: tuple[int, int]
    style: int
    reversible: bool
    precincts: list[tuple[int, int]]
    marks: int = 0  # 2: a mark before each packet, 4: one behind its header
    order: int = 0
    layers: int = 1
    transform: bool = False


@dataclass
class Band:
    kind: int  # 0 LL, 1 HL, 2 LH, 3 HH
    box: tuple[int, int, int, int]
    bits: int
    step: float
    values: np.ndarray | None = None


@dataclass
class Block:
    box: tuple[int, int, int, int]
    band: Band
    passes: int = 0
    zeros: int = 0
    length_bits: int = 3
    data: bytearray = field(default_factory=bytearray)


class Tree:
    """A tag tree: the least of values over ever larger squares, told bit by bit."""

    def __init__(self, w: int, h: int):
        self.levels = []
        while True:
            self.levels.append((w, [0] * (w * h), [False] * (w * h)))
            if w <= 1 and h <= 1:
                break
            w, h = _up(w, 2), _up(h, 2)

    def reaches(self, bits: Bits, x: int, y: int, limit: int) -> bool:
        """Whether the value at a place is below limit, as far as it has been told or has to be."""
        low = 0
        for k in range(len(self.levels) - 1, -1, -1):
            w, values, known = self.levels[k]
            i = (y >> k) * w + (x >> k)
            values[i] = max(values[i], low)
            while values[i] < limit and not known[i]:
                if bits.bit():
                    known[i] = True
                else:
                    values[i] += 1
            low = values[i]
        return known[i] and low < limit

    def value(self, bits: Bits, x: int, y: int) -> int:
        n = 1
        while not self.reaches(bits, x, y, n):
            n += 1
            if n > 80:
                raise JpxError("tag tree")
        return n - 1


class Bits:
    """Bits of a packet's header; after a byte of ones the next has seven."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.now = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            before = self.now
            if self.at >= len(self.data):
                raise JpxError("cut off")
            self.now = self.data[self.at]
            self.at += 1
            self.left = 7 if before == 0xFF else 8
        self.left -= 1
        return self.now >> self.left & 1

    def number(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def end(self) -> int:
        """Where the header ends: a last byte of ones has one more behind it."""
        return self.at + (self.now == 0xFF)


def _passes(bits: Bits) -> int:
    if not bits.bit():
        return 1
    if not bits.bit():
        return 2
    if (n := bits.number(2)) < 3:
        return 3 + n
    if (n := bits.number(5)) < 31:
        return 6 + n
    return 37 + bits.number(7)


# ---- code blocks

_ZERO, _SIGN, _REFINE, _RUN, _PLAIN = 0, 9, 14, 17, 18


def _context(kind: int, h: int, v: int, d: int) -> int:
    """The context of a place by how many of its neighbours beside, above and below, and across are significant."""
    if kind == 3:
        if d >= 3:
            return 8
        if d == 2:
            return 7 if h + v else 6
        return (3 if d else 0) + min(h + v, 2)
    if kind == 1:
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    if v:
        return 2 + v
    return min(d, 2)


_CONTEXTS = [[[[_context(k, h, v, d) for d in range(5)] for v in range(3)] for h in range(3)] for k in range(4)]
#: By the signs beside and above or below: the context, and whether the bit is turned round.
_SIGNS = {(h, v): (_SIGN + abs(3 * h + v if h else v) if (h, v) != (0, 0) else _SIGN, int(h < 0 or h == 0 and v < 0)) for h in (-1, 0, 1) for v in (-1, 0, 1)}


def block_values(data: bytes, w: int, h: int, kind: int, planes: int, passes: int, style: int = 0) -> tuple[np.ndarray, int]:
    """The values of a code block with so many bit planes, and the lowest plane that was read."""
    wide = w + 2
    seen = [0] * (wide * (h + 2))  # 1: significant
    sign = [0] * len(seen)
    size = [0] * len(seen)
    twice = [0] * len(seen)
    table = _CONTEXTS[kind]
    bit = Decoder(bytes(data)).bit
    fresh = [0] * 19
    fresh[_ZERO], fresh[_RUN], fresh[_PLAIN] = 8, 6, 92
    contexts = list(fresh)

    def context(i: int) -> int:
        return table[seen[i - 1] + seen[i + 1]][seen[i - wide] + seen[i + wide]][seen[i - wide - 1] + seen[i - wide + 1] + seen[i + wide - 1] + seen[i + wide + 1]]

    def becomes_significant(i: int) -> None:
        side = max(-1, min(1, sign[i - 1] + sign[i + 1]))
        over = max(-1, min(1, sign[i - wide] + sign[i + wide]))
        number, turned = _SIGNS[side, over]
        sign[i] = -1 if bit(contexts, number) ^ turned else 1
        seen[i] = 1
        size[i] = 1 << plane

    plane, step = planes - 1, 2
    for _ in range(passes):
        if plane < 0:
            raise JpxError("too many passes")
        if step == 0:
            done = bytearray(len(seen))
        elif step == 2 and plane == planes - 1:
            done = bytearray(len(seen))
        for top in range(0, h, 4):
            rows = range(top, min(top + 4, h))
            for x in range(1, w + 1):
                if step == 0:
                    for y in rows:
                        i = (y + 1) * wide + x
                        if not seen[i] and (c := context(i)):
                            done[i] = 1
                            if bit(contexts, c):
                                becomes_significant(i)
                elif step == 1:
                    for y in rows:
                        i = (y + 1) * wide + x
                        if seen[i] and not done[i]:
                            c = 16 if twice[i] else 15 if context(i) else 14
                            twice[i] = 1
                            if bit(contexts, c):
                                size[i] |= 1 << plane
                else:
                    first = (top + 1) * wide + x
                    y = top
                    if len(rows) == 4 and not any(seen[i] or done[i] or context(i) for i in range(first, first + 4 * wide, wide)):
                        if not bit(contexts, _RUN):
                            continue
                        y += bit(contexts, _PLAIN) << 1 | bit(contexts, _PLAIN)
                        becomes_significant((y + 1) * wide + x)
                        y += 1
                    for y in range(y, rows.stop):
                        i = (y + 1) * wide + x
                        if not seen[i] and not done[i] and bit(contexts, context(i)):
                            becomes_significant(i)
        if step == 2:
            if style & 32 and [bit(contexts, _PLAIN) for _ in range(4)] != [1, 0, 1, 0]:
                raise JpxError("segmentation mark")
            plane -= 1
            step = 0
        else:
            step += 1
        if style & 2:
            contexts = list(fresh)
    lowest = plane + 1 if step == 0 else plane
    values = (np.array(size) * np.array(sign)).reshape(h + 2, wide)[1:-1, 1:-1]
    return values, lowest


# ---- wavelets


def _along(low: np.ndarray, high: np.ndarray, begin: int, reversible: bool) -> np.ndarray:
    """One step of synthesis along the first axis; places begin at an absolute one."""
    n = len(low) + len(high)
    if not n:
        return low
    if n == 1:
        return low if len(low) else (high // 2 if reversible else high / 2)
    odd = begin & 1
    y = np.empty((n, *low.shape[1:]), low.dtype)
    y[odd::2], y[1 - odd :: 2] = low, high
    y = np.pad(y, [(4 + odd, 4 + (n + odd) % 2)] + [(0, 0)] * (y.ndim - 1), mode="symmetric" if n < 2 else "reflect") if n > 5 else _mirrored(y, 4 + odd, 4 + (n + odd) % 2)
    even, odds = y[0::2].copy(), y[1::2].copy()  # even places are low ones: the padding keeps parity
    before = lambda x: np.concatenate([x[:1], x[:-1]])
    after = lambda x: np.concatenate([x[1:], x[-1:]])
    if reversible:
        even -= (before(odds) + odds + 2) >> 2
        odds += (even + after(even)) >> 1
    else:
        even *= SCALE
        odds /= SCALE
        even -= DELTA * (before(odds) + odds)
        odds -= GAMMA * (even + after(even))
        even -= BETA * (before(odds) + odds)
        odds -= ALPHA * (even + after(even))
    y[0::2], y[1::2] = even, odds
    return y[4 + odd : 4 + odd + n]


def _mirrored(y: np.ndarray, before: int, after: int) -> np.ndarray:
    """y with its mirror images on both sides, however short it is."""
    n = len(y)
    at = np.abs(np.arange(-before, n + after)) % (2 * n - 2)
    return y[np.where(at < n, at, 2 * n - 2 - at)]


def _synthesis(ll: np.ndarray, hl: np.ndarray, lh: np.ndarray, hh: np.ndarray, x: int, y: int, reversible: bool) -> np.ndarray:
    rows_low = _along(ll.T, hl.T, x, reversible).T
    rows_high = _along(lh.T, hh.T, x, reversible).T
    return _along(rows_low, rows_high, y, reversible)


# ---- tiles


class Image:
    """A codestream that is read tile by tile."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:4] != b"\xff\x4f\xff\x51":
            raise JpxError("no codestream")
        s = data[4:]
        self.x1, self.y1, self.x0, self.y0, self.tw, self.th, self.tx, self.ty = (_int(s, 4 + 4 * k, 4) for k in range(8))
        n = _int(s, 36, 2)
        parts = [(s[38 + 3 * k], s[39 + 3 * k], s[40 + 3 * k]) for k in range(n)] if len(s) >= 38 + 3 * n else []
        if not 1 <= n <= 4 or len(parts) != n or any(d & 0x80 or (d & 0x7F) > 15 or not dx or not dy for d, dx, dy in parts):
            raise JpxError("components")
        self.depth, self.sub = [d + 1 for d, _, _ in parts], [(dx, dy) for _, dx, dy in parts]
        w, h = self.x1 - self.x0, self.y1 - self.y0
        if w < 1 or h < 1 or w * h > MOST_PIXELS or not self.tw or not self.th or self.tx > self.x0 or self.ty > self.y0 or self.tx + self.tw <= self.x0 or self.ty + self.th <= self.y0:
            raise JpxError("size")
        if _up(w, self.tw) * _up(h, self.th) > 65_535:
            raise JpxError("tiles")
        self.planes = [np.zeros((_up(self.y1, dy) - _up(self.y0, dy), _up(self.x1, dx) - _up(self.x0, dx)), np.int32) for dx, dy in self.sub]
        self._read()

    def _read(self) -> None:
        d, at, n = self.data, 4 + _int(self.data, 4, 2), len(self.depth)
        main: dict = {"cod": None, "coc": {}, "qcd": None, "qcc": {}}
        tiles: dict[int, dict] = {}
        while at + 2 <= len(d):
            mark = _int(d, at, 2)
            if mark == 0xFFD9:
                break
            size = _int(d, at + 2, 2)
            if mark != 0xFF90:
                self._segment(main, mark, d[at + 4 : at + 2 + size], n)
                at += 2 + size
                continue
            tile, length = _int(d, at + 4, 2), _int(d, at + 6, 4)
            end = min(at + length, len(d)) if length else len(d) - 2 * (d[-2:] == b"\xff\xd9")
            own = tiles.setdefault(tile, {"cod": main["cod"], "coc": dict(main["coc"]), "qcd": main["qcd"], "qcc": dict(main["qcc"]), "body": bytearray()})
            inner = at + 12
            while inner + 2 <= end and (mark := _int(d, inner, 2)) != 0xFF93:
                size = _int(d, inner + 2, 2)
                self._segment(own, mark, d[inner + 4 : inner + 2 + size], n, own=True)
                inner += 2 + size
            own["body"] += d[inner + 2 : end]
            if end <= at:
                break
            at = end
        for number, own in sorted(tiles.items()):
            self._tile(number, own)

    def _segment(self, to: dict, mark: int, body: bytes, n: int, own: bool = False) -> None:
        if mark == 0xFF52:
            to["cod"] = self._coding(body[5:], body[0], _int(body, 1, 1), _int(body, 2, 2), body[4:5] != b"\0")
            if own:
                to["coc"] = {}
        elif mark == 0xFF53:
            base = to["cod"]
            to["coc"][body[0]] = (body[2:], body[1], base)
        elif mark == 0xFF5C:
            to["qcd"] = body
            if own:
                to["qcc"] = {}
        elif mark == 0xFF5D:
            to["qcc"][body[0]] = body[1:]
        elif mark in (0xFF5E, 0xFF5F, 0xFF60, 0xFF61):
            raise JpxError("not supported")

    def _coding(self, b: bytes, flags: int, order: int, layers: int, transform: bool) -> Coding:
        if len(b) < 5 or b[0] > 32 or b[1] + b[2] > 8 or b[3] & ~(2 | 32) or b[4] > 1 or order > 4 or not layers:
            raise JpxError("coding style")
        precincts = [(x & 15, x >> 4) for x in b[5 : 6 + b[0]]] if flags & 1 else [(15, 15)] * (b[0] + 1)
        if len(precincts) != b[0] + 1:
            raise JpxError("precincts")
        return Coding(b[0], (b[1] + 2, b[2] + 2), b[3], b[4] == 1, precincts, flags & 6, order, layers, transform)

    def _tile(self, number: int, own: dict) -> None:
        across = _up(self.x1 - self.tx, self.tw)
        p, q = number % across, number // across
        x0, y0 = max(self.tx + p * self.tw, self.x0), max(self.ty + q * self.th, self.y0)
        x1, y1 = min(self.tx + (p + 1) * self.tw, self.x1), min(self.ty + (q + 1) * self.th, self.y1)
        if own["cod"] is None or own["qcd"] is None or x0 >= x1 or y0 >= y1:
            raise JpxError("tile")
        main: Coding = own["cod"]
        parts, packets = [], []
        for c, (dx, dy) in enumerate(self.sub):
            code = main
            if c in own["coc"]:
                body, flags, _ = own["coc"][c]
                code = self._coding(body, flags & 1 | main.marks, main.order, main.layers, main.transform)
            box = _up(x0, dx), _up(y0, dy), _up(x1, dx), _up(y1, dy)
            levels = []
            for r in range(code.levels + 1):
                levels.append(self._level(c, r, code, box, own["qcc"].get(c, own["qcd"]), packets, (x0, y0), (dx, dy)))
            parts.append((code, box, levels))
        by = {0: lambda k: (k[5], k[0], k[3], k[4]), 1: lambda k: (k[0], k[5], k[3], k[4]), 2: lambda k: (k[0], k[1], k[2], k[3], k[4], k[5]), 3: lambda k: (k[1], k[2], k[3], k[0], k[4], k[5]), 4: lambda k: (k[3], k[1], k[2], k[0], k[4], k[5])}[main.order]
        asked = [((r, y, x, c, i, layer), precinct) for (r, y, x, c, i), precinct in packets for layer in range(main.layers)]
        body, at = bytes(own["body"]), 0
        for key, precinct in sorted(asked, key=lambda k: by(k[0])):
            if at >= len(body):
                break  # cut off: what is there counts
            at = self._packet(body, at, precinct, key[5], main.marks)
        planes = [self._component(*part) for part in parts]
        if main.transform and len(planes) >= 3:
            a, b, c = planes[:3]
            if not a.shape == b.shape == c.shape:
                raise JpxError("component transform")
            if parts[0][0].reversible:
                green = a - ((b + c) >> 2)
                planes[:3] = [c + green, green, b + green]
            else:
                planes[:3] = [a + 1.402 * c, a - 0.344136 * b - 0.714136 * c, a + 1.772 * b]
        for c, ((dx, dy), plane) in enumerate(zip(self.sub, planes)):
            top, left = _up(y0, dy) - _up(self.y0, dy), _up(x0, dx) - _up(self.x0, dx)
            value = np.rint(plane).astype(np.int64) + (1 << self.depth[c] - 1)
            self.planes[c][top : top + plane.shape[0], left : left + plane.shape[1]] = np.clip(value, 0, (1 << self.depth[c]) - 1)

    def _level(self, c: int, r: int, code: Coding, box: tuple, quant: bytes, packets: list, tile: tuple[int, int], sub: tuple[int, int]) -> list[Band]:
        """The bands of a resolution level; its precincts are added to packets."""
        n = code.levels - r
        x0, y0, x1, y1 = (_up(v, 1 << n) for v in box)
        style, guard = quant[0] & 31, quant[0] >> 5
        bands = []
        for kind in (0,) if r == 0 else (1, 2, 3):
            deep = n if r == 0 else n + 1
            ox, oy = (kind & 1) << (deep - 1) if deep else 0, (kind >> 1) << (deep - 1) if deep else 0
            sides = tuple(_up(v - o, 1 << deep) for v, o in zip(box, (ox, oy, ox, oy)))
            i = 0 if r == 0 else 3 * (r - 1) + kind
            if style == 0:
                expo, step = _int(quant, 1 + i, 1) >> 3, 1.0
            else:
                raw = _int(quant, 1 if style == 1 else 1 + 2 * i, 2)
                expo = (raw >> 11) - (max(0, r - 1) if style == 1 else 0)
                gain = (0, 1, 1, 2)[kind]
                step = 2.0 ** (self.depth[c] + gain - expo) * (1 + (raw & 2047) / 2048)
            band = Band(kind, sides, guard + expo - 1, step)
            band.values = np.zeros((max(0, sides[3] - sides[1]), max(0, sides[2] - sides[0])), np.int64 if code.reversible else float)
            bands.append(band)
        px, py = code.precincts[r]
        half = int(r > 0)
        if half and (not px or not py):
            raise JpxError("precincts")
        bw, bh = min(code.block[0], px - half), min(code.block[1], py - half)
        wide = _up(x1, 1 << px) - (x0 >> px) if x1 > x0 else 0
        high = _up(y1, 1 << py) - (y0 >> py) if y1 > y0 else 0
        for i in range(wide * high):
            j, k = i % wide + (x0 >> px), i // wide + (y0 >> py)
            precinct = []
            for band in bands:
                a0, b0, a1, b1 = band.box
                a0, a1 = max(a0, j << px - half), min(a1, j + 1 << px - half)
                b0, b1 = max(b0, k << py - half), min(b1, k + 1 << py - half)
                if a1 <= a0 or b1 <= b0:
                    continue
                left, top = a0 >> bw, b0 >> bh
                w, h = _up(a1, 1 << bw) - left, _up(b1, 1 << bh) - top
                blocks = [
                    Block((max(a0, u << bw), max(b0, v << bh), min(a1, u + 1 << bw), min(b1, v + 1 << bh)), band)
                    for v in range(top, top + h) for u in range(left, left + w)
                ]
                precinct.append((blocks, w, Tree(w, h), Tree(w, h), code))
            at_x, at_y = max(tile[0], (j << px + n) * sub[0]), max(tile[1], (k << py + n) * sub[1])
            packets.append(((r, at_y, at_x, c, i), precinct))
        return bands

    def _packet(self, d: bytes, at: int, precinct: list, layer: int, marks: int) -> int:
        if marks & 2 and d[at : at + 2] == b"\xff\x91":
            at += 6
        bits = Bits(d, at)
        told = []
        if bits.bit():
            for blocks, w, inclusion, zeros, _ in precinct:
                for i, b in enumerate(blocks):
                    x, y = i % w, i // w
                    if b.passes:
                        if not bits.bit():
                            continue
                    elif not inclusion.reaches(bits, x, y, layer + 1):
                        continue
                    else:
                        b.zeros = zeros.value(bits, x, y)
                    n = _passes(bits)
                    while bits.bit():
                        b.length_bits += 1
                    told.append((b, n, bits.number(b.length_bits + n.bit_length() - 1)))
                    b.passes += n
        at = bits.end()
        if marks & 4 and d[at : at + 2] == b"\xff\x92":
            at += 2
        for b, _, size in told:
            b.data += d[at : at + size]
            at += size
        for blocks, *_, code in precinct:
            if layer == code.layers - 1:
                for b in blocks:
                    self._fill(b, code)
        return at

    def _fill(self, b: Block, code: Coding) -> None:
        if not b.passes:
            return
        x0, y0, x1, y1 = b.box
        planes = b.band.bits - b.zeros
        if planes > 40:
            raise JpxError("bit planes")
        values, lowest = block_values(b.data, x1 - x0, y1 - y0, b.band.kind, planes, b.passes, code.style)
        if not code.reversible:
            values = (values + np.sign(values) * (0.5 * (1 << lowest))) * b.band.step
        left, top = x0 - b.band.box[0], y0 - b.band.box[1]
        b.band.values[top : top + values.shape[0], left : left + values.shape[1]] = values
        b.passes = 0

    def _component(self, code: Coding, box: tuple, levels: list[list[Band]]) -> np.ndarray:
        out = levels[0][0].values
        for r in range(1, code.levels + 1):
            n = code.levels - r
            hl, lh, hh = (b.values for b in levels[r])
            out = _synthesis(out, hl, lh, hh, _up(box[0], 1 << n), _up(box[1], 1 << n), code.reversible)
        return out


def component(plane: np.ndarray, depth: int, width: int, height: int) -> np.ndarray:
    """A component in 8 bits on the image's grid; subsampled ones repeat their samples."""
    p = plane >> depth - 8 if depth > 8 else plane * 255 // ((1 << depth) - 1)
    rows, columns = np.arange(height) * p.shape[0] // height, np.arange(width) * p.shape[1] // width
    return p[rows[:, None], columns].astype(np.uint8)


def sycc(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-range BT.601 to RGB."""
    y, b, r = y.astype(float), cb.astype(float) - 128, cr.astype(float) - 128
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return np.floor(np.clip(rgb, 0, 255) + 0.5).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The image as a plane of gray, RGB or four inks. JpxError if it can't be decoded."""
    try:
        stream, space = codestream(data)
        image = Image(stream)
    except (IndexError, OverflowError, MemoryError) as e:
        raise JpxError(type(e).__name__) from e
    w, h = image.x1 - image.x0, image.y1 - image.y0
    parts = [component(p, d, w, h) for p, d in zip(image.planes, image.depth)]
    if len(parts) == 1:
        return parts[0]
    if len(parts) == 2:
        raise JpxError("components")
    if len(parts) == 3 and (space == SYCC or space is None and image.sub[0] == (1, 1) and image.sub[1] != (1, 1)):
        return sycc(*parts)
    return np.stack(parts, axis=-1)

"""JBIG2 as it stands in PDF files: generic regions, arithmetic or fax coded, symbols and text,
patterns and halftones, refinements.

Huffman coded symbols and text, and predictions of refinements, raise ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from leafmill.functions import fax

#: States of the arithmetic coder: share of the less probable symbol, next state after
#: the more and the less probable one, and whether the latter swaps them.
STATES = """5601 1 1 1  3401 2 6 0  1801 3 9 0  0AC1 4 12 0  0521 5 29 0  0221 38 33 0  5601 7 6 1  5401 8 14 0  4801 9 14 0  3801 10 14 0
3001 11 17 0  2401 12 18 0  1C01 13 20 0  1601 29 21 0  5601 15 14 1  5401 16 14 0  5101 17 15 0  4801 18 16 0  3801 19 17 0  3401 20 18 0
3001 21 19 0  2801 22 19 0  2401 23 20 0  2201 24 21 0  1C01 25 22 0  1801 26 23 0  1601 27 24 0  1401 28 25 0  1201 29 26 0  1101 30 27 0
0AC1 31 28 0  09C1 32 29 0  08A1 33 30 0  0521 34 31 0  0441 35 32 0  02A1 36 33 0  0221 37 34 0  0141 38 35 0  0111 39 36 0  0085 40 37 0
0049 41 38 0  0025 42 39 0  0015 43 40 0  0009 44 41 0  0005 45 42 0  0001 45 43 0  5601 46 46 0""".split()
_QE = [int(x, 16) for x in STATES[0::4]]
_NEXT, _LESS, _SWAP = ([int(x) for x in STATES[k::4]] for k in (1, 2, 3))
#: Of each template how far each row above and the own row reach, as (row, from, to),
#: and the context that tells whether a row repeats the one above.
TEMPLATES = (
    (((-2, -1, 1), (-1, -2, 2), (0, -4, -1)), 0x9B25), (((-2, -1, 2), (-1, -2, 2), (0, -3, -1)), 0x0795),
    (((-2, -1, 1), (-1, -2, 1), (0, -2, -1)), 0x00E5), (((-1, -3, 1), (0, -4, -1)), 0x0195),
)
MOST_PIXELS = 100_000_000


class Decoder:
    """The arithmetic decoder; contexts are (state, more probable symbol) by number."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.c, self.count, self.a = self._byte(0) << 16, 0, 0x8000
        self._more()
        self.c <<= 7
        self.count -= 7

    def _byte(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def _more(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.count = 8
            else:
                self.at += 1
                self.c += self._byte(self.at) << 9
                self.count = 7
        else:
            self.at += 1
            self.c += self._byte(self.at) << 8
            self.count = 8

    def bit(self, contexts: list[int], number: int) -> int:
        """The next bit in a context, which holds 2 * state + more probable symbol."""
        state, likely = contexts[number] >> 1, contexts[number] & 1
        q = _QE[state]
        self.a -= q
        if self.c >> 16 < q:
            less = self.a >= q
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return likely
            less = self.a < q
        out = 1 - likely if less else likely
        if less:
            likely ^= _SWAP[state]
            state = _LESS[state]
        else:
            state = _NEXT[state]
        contexts[number] = state << 1 | likely
        while True:
            if not self.count:
                self._more()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.count -= 1
            if self.a & 0x8000:
                return out


def generic(
    decoder: Decoder, width: int, height: int, template: int, repeats: bool, moved: list[tuple[int, int]], contexts: list[int] | None = None
) -> np.ndarray:
    """A generic region. moved: places (x, y) of the template's movable pixels; contexts: those to go on with."""
    rows, mark = TEMPLATES[template]
    places = sorted([(y, x) for y, a, b in rows for x in range(a, b + 1)] + [(y, x) for x, y in moved])
    contexts = [0] * (1 << len(places)) if contexts is None else contexts
    edge = 130
    plane = np.zeros((height + edge, width + 2 * edge), np.uint8)
    lines = [bytearray(width + 2 * edge) for _ in range(edge)]
    same = 0
    for y in range(height):
        if repeats:
            same ^= decoder.bit(contexts, mark)
            if same:
                lines.append(bytearray(lines[-1]))
                plane[y + edge] = np.frombuffer(bytes(lines[-1]), np.uint8)
                continue
        own = bytearray(width + 2 * edge)
        lines.append(own)
        look = [(lines[dy - 1], dx + edge) for dy, dx in places]
        for x in range(width):
            number = 0
            for line, at in look:
                number = number << 1 | line[x + at]
            own[x + edge] = decoder.bit(contexts, number)
        plane[y + edge] = np.frombuffer(bytes(own), np.uint8)
        if len(lines) > 2 * edge:
            del lines[:edge]
    return plane[edge:, edge : edge + width].astype(bool)


#: Places (x, y) that a refinement sees: of the new bitmap and of the old one, without the movable ones.
_REFINED = (
    (((0, -1), (1, -1), (-1, 0)), ((0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))),
    (((-1, -1), (0, -1), (1, -1), (-1, 0)), ((0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1))),
)


def refined(
    decoder: Decoder, old: np.ndarray, width: int, height: int, shift: tuple[int, int], template: int, moved: list[tuple[int, int]], contexts: list[int]
) -> np.ndarray:
    """A bitmap that refines an old one, which stands at a shift."""
    own, others = _REFINED[template]
    if template == 0:
        own, others = (*own, moved[0]), (*others, moved[1])
    edge = 130
    new = np.zeros((height + 2 * edge, width + 2 * edge), np.uint8)
    before = np.zeros((height + 2 * edge, width + 2 * edge), np.uint8)
    for y in range(old.shape[0]):
        at = y + shift[1] + edge
        if 0 <= at < len(before):
            begin = shift[0] + edge
            a, b = max(0, -begin), min(old.shape[1], before.shape[1] - begin)
            if a < b:
                before[at, begin + a : begin + b] = old[y, a:b]
    lines, seen = [bytearray(r) for r in new], [bytes(r) for r in before]
    for y in range(edge, edge + height):
        look = [(lines[y + dy], dx) for dx, dy in own] + [(seen[y + dy], dx) for dx, dy in others]
        now = lines[y]
        for x in range(edge, edge + width):
            number = 0
            for line, dx in look:
                number = number << 1 | line[x + dx]
            now[x] = decoder.bit(contexts, number)
    return np.array([np.frombuffer(bytes(lines[y]), np.uint8)[edge : edge + width] for y in range(edge, edge + height)], bool).reshape(height, width)


class Numbers:
    """Whole numbers and symbol ids; each kind of them has contexts of its own."""

    #: Bits of a range's offset, and where the range begins.
    RANGES = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))

    def __init__(self, decoder: Decoder):
        self.decoder = decoder
        self.contexts: dict[str, list[int]] = {}

    def get(self, kind: str) -> int | None:
        """The next number of a kind, None for the mark that ends a run."""
        contexts, before = self.contexts.setdefault(kind, [0] * 512), 1

        def bit() -> int:
            nonlocal before
            b = self.decoder.bit(contexts, before)
            before = before << 1 | b if before < 256 else (before << 1 | b) & 511 | 256
            return b

        negative, k = bit(), 0
        while k < 5 and bit():
            k += 1
        value = 0
        for _ in range(self.RANGES[k][0]):
            value = value << 1 | bit()
        value += self.RANGES[k][1]
        return (None if not value else -value) if negative else value

    def need(self, kind: str) -> int:
        value = self.get(kind)
        if value is None:
            raise ValueError("number expected")
        return value

    def ident(self, bits: int) -> int:
        contexts, before = self.contexts.setdefault("id", [0] * (2 << bits)), 1
        for _ in range(bits):
            before = before << 1 | self.decoder.bit(contexts, before)
        return before - (1 << bits)


def _placed(page: np.ndarray, part: np.ndarray, x: int, y: int, how: int) -> None:
    """Combine a part with the page where it stands on it."""
    a, b = max(0, -x), max(0, -y)
    w, h = min(part.shape[1], page.shape[1] - x), min(part.shape[0], page.shape[0] - y)
    if a >= w or b >= h:
        return
    here, part = page[y + b : y + h, x + a : x + w], part[b:h, a:w]
    here[:] = (here | part, here & part, here ^ part, ~(here ^ part), part)[min(how, 4)]


@dataclass
class Text:
    """How symbols are written into a region."""

    width: int
    height: int
    instances: int
    strips: int = 1
    log_strips: int = 0
    corner: int = 1  # bottom left, top left, bottom right, top right
    transposed: bool = False
    how: int = 0
    black: bool = False
    offset: int = 0
    refines: bool = False
    template: int = 0
    moved: tuple = ((-1, -1), (-1, -1))


def text(numbers: Numbers, t: Text, symbols: list[np.ndarray], bits: int, refinements: list[int]) -> np.ndarray:
    """A region of symbols, strip by strip."""
    page = np.full((t.height, t.width), t.black)
    across, first, done = -numbers.need("dt") * t.strips, 0, 0
    while done < t.instances:
        across += numbers.need("dt") * t.strips
        first += numbers.need("fs")
        along = first
        while True:
            at = across + (numbers.need("it") if t.strips > 1 else 0)
            i = numbers.ident(bits)
            if i >= len(symbols):
                raise ValueError("symbol")
            s = symbols[i]
            if t.refines and numbers.need("ri"):
                dw, dh, dx, dy = (numbers.need(k) for k in ("rdw", "rdh", "rdx", "rdy"))
                w, h = s.shape[1] + dw, s.shape[0] + dh
                if w < 0 or h < 0 or w * h > MOST_PIXELS:
                    raise ValueError("refinement")
                s = refined(numbers.decoder, s, w, h, ((dw >> 1) + dx, (dh >> 1) + dy), t.template, list(t.moved), refinements)
            h, w = s.shape
            if not t.transposed and t.corner in (2, 3):
                along += w - 1
            elif t.transposed and t.corner in (0, 2):
                along += h - 1
            x, y = (at, along) if t.transposed else (along, at)
            _placed(page, s, x - (w - 1 if t.corner in (2, 3) else 0), y - (h - 1 if t.corner in (0, 2) else 0), t.how)
            if not t.transposed and t.corner in (0, 1):
                along += w - 1
            elif t.transposed and t.corner in (1, 3):
                along += h - 1
            done += 1
            step = numbers.get("ds")
            if step is None:
                break
            if done >= t.instances:
                raise ValueError("too many symbols")
            along += step + t.offset
    return page


def _moved(d: bytes, at: int, n: int) -> list[tuple[int, int]]:
    signed = lambda v: v - 256 if v > 127 else v
    return [(signed(_number(d, at + 2 * k, 1)), signed(_number(d, at + 2 * k + 1, 1))) for k in range(n)]


def _above(moved: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if any(dy > 0 or dy == 0 and dx >= 0 for dx, dy in moved):
        raise ValueError("template")
    return moved


def dictionary(d: bytes, known: list[np.ndarray]) -> list[np.ndarray]:
    """The symbols that a dictionary hands on, from known ones and its own."""
    flags = _number(d, 0, 2)
    if flags & 1 or flags & 0x100:
        raise ValueError("Huffman coded or continued symbols")
    combines, template, fine, at = bool(flags & 2), flags >> 10 & 3, flags >> 12 & 1, 2
    n = 4 if template == 0 else 1
    moved, at = _above(_moved(d, at, n)), at + 2 * n
    shifts = [(-1, -1), (-1, -1)]
    if combines and not fine:
        shifts, at = _moved(d, at, 2), at + 4
    _above(shifts[:1])
    out, fresh = _number(d, at), _number(d, at + 4)
    if fresh > 1 << 20 or out > fresh + len(known):
        raise ValueError("symbols")
    decoder = Decoder(d[at + 8 :])
    numbers, symbols = Numbers(decoder), list(known)
    bits = max(0, (len(known) + fresh - 1).bit_length())
    contexts, refinements = [0] * (1 << (16, 13, 10, 10)[template]), [0] * (1 << 13)
    height = pixels = 0
    while len(symbols) < len(known) + fresh:
        height += numbers.need("dh")
        width = 0
        while (step := numbers.get("dw")) is not None:
            width += step
            pixels += max(0, width) * max(0, height)
            if len(symbols) >= len(known) + fresh or width < 0 or height < 0 or pixels > MOST_PIXELS:
                raise ValueError("symbols")
            if not combines:
                symbols.append(generic(decoder, width, height, template, False, moved, contexts))
            elif (count := numbers.need("ai")) != 1:
                t = Text(width, height, count, refines=True, template=fine, moved=tuple(shifts))
                symbols.append(text(numbers, t, symbols, bits, refinements))
            else:
                i, dx, dy = numbers.ident(bits), numbers.need("rdx"), numbers.need("rdy")
                if i >= len(symbols):
                    raise ValueError("symbol")
                symbols.append(refined(decoder, symbols[i], width, height, (dx, dy), fine, shifts, refinements))
    kept: list[np.ndarray] = []
    place, keeps = 0, False
    while place < len(symbols):
        run = numbers.need("ex")
        if run < 0 or place + run > len(symbols):
            raise ValueError("export")
        kept += symbols[place : place + run] if keeps else []
        place, keeps = place + run, not keeps
    if len(kept) != out:
        raise ValueError("export")
    return kept


def patterns(d: bytes) -> list[np.ndarray]:
    """The patterns of a halftone, from the darkest number on."""
    flags, w, h, most = _number(d, 0, 1), _number(d, 1, 1), _number(d, 2, 1), _number(d, 3)
    template = flags >> 1 & 3
    if not w or not h or (most + 1) * w * h > MOST_PIXELS:
        raise ValueError("patterns")
    if flags & 1:
        plane = fax.decode_g4(d[7:], (most + 1) * w, h)
        if plane is None:
            raise ValueError("fax data")
    else:
        moved = [(-w, 0), (-3, -1), (2, -2), (-2, -2)][: 4 if template == 0 else 1]
        plane = generic(Decoder(d[7:]), (most + 1) * w, h, template, False, moved)
    return [plane[:, k * w : (k + 1) * w] for k in range(most + 1)]


def halftone(d: bytes, width: int, height: int, known: list[np.ndarray]) -> np.ndarray:
    """A halftone region: gray values on a grid, each a pattern."""
    flags, gw, gh = _number(d, 0, 1), _number(d, 1), _number(d, 5)
    gx, gy = (int.from_bytes(d[k : k + 4], "big", signed=True) for k in (9, 13))
    rx, ry = _number(d, 17, 2), _number(d, 19, 2)
    template, how = flags >> 1 & 3, flags >> 4 & 7
    if flags & 9 or not known or gw * gh > MOST_PIXELS:
        raise ValueError("halftone")
    bits = (len(known) - 1).bit_length()
    moved = [(3 if template <= 1 else 2, -1), (-3, -1), (2, -2), (-2, -2)][: 4 if template == 0 else 1]
    decoder, contexts = Decoder(d[21:]), [0] * (1 << (16, 13, 10, 10)[template])
    gray, last = np.zeros((gh, gw), int), np.zeros((gh, gw), bool)
    for _ in range(bits):
        last = generic(decoder, gw, gh, template, False, moved, contexts) ^ last
        gray = gray << 1 | last
    page = np.full((height, width), bool(flags & 0x80))
    for m in range(gh):
        for n in range(gw):
            _placed(page, known[min(int(gray[m, n]), len(known) - 1)], (gx + m * ry + n * rx) >> 8, (gy + m * rx - n * ry) >> 8, how)
    return page


def _number(d: bytes, at: int, size: int = 4) -> int:
    if at + size > len(d):
        raise ValueError("cut off")
    return int.from_bytes(d[at : at + size], "big")


def _segments(data: bytes):
    """(number, type, numbers referred to, data) of each segment."""
    at = 0
    while at + 11 <= len(data):
        ident, flags = _number(data, at), _number(data, at + 4, 1)
        at += 5
        count = _number(data, at, 1) >> 5
        if count == 7:
            count = _number(data, at) & 0x1FFFFFFF
            at += 4 + (count + 8) // 8
        else:
            at += 1
        wide = 1 if ident <= 256 else 2 if ident <= 65_536 else 4
        if count > len(data):
            raise ValueError("cut off")
        told = [_number(data, at + wide * k, wide) for k in range(count)]
        at += count * wide + (4 if flags & 0x40 else 1)
        size = _number(data, at)
        at += 4
        size = len(data) - at if size == 0xFFFFFFFF else size
        if at + size > len(data):
            raise ValueError("cut off")
        yield ident, flags & 63, told, data[at : at + size]
        at += size


def _region(kind: int, d: bytes, w: int, h: int, symbols: list[np.ndarray], under: np.ndarray) -> np.ndarray:
    """A region's bitmap; under: what it may refine."""
    flags = _number(d, 17, 1)
    if kind in (36, 38, 39):
        template, at = flags >> 1 & 3, 18
        if flags & 1:
            part = fax.decode_g4(d[at:], w, h)
            if part is None:
                raise ValueError("fax data")
            return part
        n = 4 if template == 0 else 1
        return generic(Decoder(d[at + 2 * n :]), w, h, template, bool(flags & 8), _above(_moved(d, at, n)))
    if kind in (40, 42, 43):
        template = flags & 1
        if flags & 2:
            raise ValueError("predicted refinement")
        moved = [] if template else _moved(d, 18, 2)
        _above(moved[:1])
        return refined(Decoder(d[18 if template else 22 :]), under, w, h, (0, 0), template, moved, [0] * (1 << 13))
    if kind in (20, 22, 23):
        return halftone(d[17:], w, h, symbols)
    flags, at = _number(d, 17, 2), 19
    if flags & 1:
        raise ValueError("Huffman coded text")
    moved = ((-1, -1), (-1, -1))
    if flags & 2 and not flags & 0x8000:
        moved, at = tuple(_moved(d, at, 2)), at + 4
        _above(list(moved[:1]))
    offset = flags >> 10 & 31
    t = Text(
        w, h, _number(d, at), 1 << (flags >> 2 & 3), flags >> 2 & 3, flags >> 4 & 3, bool(flags & 64), flags >> 7 & 3, bool(flags & 512), offset - 32 if offset > 15 else offset,
        bool(flags & 2), flags >> 15, moved,
    )
    return text(Numbers(Decoder(d[at + 4 :])), t, symbols, max(0, (len(symbols) - 1).bit_length()), [0] * (1 << 13))


def decode(data: bytes, width: int, height: int, shared: bytes = b"") -> np.ndarray:
    """The page (black is True) of a stream with its shared segments. ValueError if anything isn't supported."""
    page = None
    sets: dict[int, list[np.ndarray]] = {}
    parts: dict[int, np.ndarray] = {}
    for number, kind, told, d in [*_segments(shared), *_segments(data)]:
        known = [s for k in told for s in sets.get(k, ())]
        if kind == 48:
            w, h, flags = _number(d, 0), _number(d, 4), _number(d, 16, 1)
            h = height if h == 0xFFFFFFFF else h
            if (w, h) != (width, height) or w * h > MOST_PIXELS:
                raise ValueError("size differs")
            page = np.full((h, w), bool(flags & 4))
        elif kind == 0:
            sets[number] = dictionary(d, known)
        elif kind == 16:
            sets[number] = patterns(d)
        elif kind in (4, 6, 7, 20, 22, 23, 36, 38, 39, 40, 42, 43) and page is not None:
            w, h, x, y, how = *(_number(d, 4 * k) for k in range(4)), _number(d, 16, 1) & 7
            if w * h > MOST_PIXELS or x + w > width or y + h > height:
                raise ValueError("region out of the page")
            under = next((parts[k] for k in told if k in parts), page[y : y + h, x : x + w])
            part = _region(kind, d, w, h, known, under)
            if kind in (4, 20, 36, 40):  # not shown by itself
                parts[number] = part
            else:
                _placed(page, part, x, y, how)
        elif kind not in (49, 50, 51, 52, 62):
            raise ValueError(f"segment {kind}")
    if page is None:
        raise ValueError("no page")
    return page

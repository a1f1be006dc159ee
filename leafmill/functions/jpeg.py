"""JPEG in numpy: planes to baseline files, baseline and progressive files to planes."""

from __future__ import annotations

import numpy as np

#: The standard quantisation tables, by rows.
LUMA_Q = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA_Q = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
_Q = [np.array(t.split(), int).reshape(8, 8) for t in (LUMA_Q, CHROMA_Q)]
_ORDER = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_ZIGZAG = np.array([8 * y + x for y, x in _ORDER])
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def tables(quality: int) -> list[np.ndarray]:
    """Quantisation tables for a quality from 1 to 100."""
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return [np.clip((t * scale + 50) // 100, 1, 255) for t in _Q]


def _huffman(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """Lengths' counts and symbols of an optimal code of at most 16 bits, no code being all ones."""
    import heapq

    weight = dict(counts)
    weight[256] = 0  # takes the code of all ones
    heap = [(n, s, [s]) for s, n in weight.items()]
    heapq.heapify(heap)
    depth = dict.fromkeys(weight, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    if len(weight) == 1:
        depth[256] = 1
    number = [0] * 64
    for d in depth.values():
        number[d] += 1
    for i in range(63, 16, -1):  # too long codes go up the tree in pairs
        while number[i]:
            j = i - 2
            while not number[j]:
                j -= 1
            number[i] -= 2
            number[i - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    last = max(i for i in range(17) if number[i])
    number[last] -= 1
    symbols = sorted((s for s in depth if s != 256), key=lambda s: (depth[s], s))
    return number[1:17], symbols


def _code(number: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(number, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _coefficients(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quantised coefficients by block, in zigzag order."""
    h, w = plane.shape
    p = np.pad(plane.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    f = _DCT @ blocks @ _DCT.T
    return np.rint(f / q).astype(int).reshape(-1, 64)[:, _ZIGZAG]


def _bits_of(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(1 << np.arange(16), np.abs(x), side="right")


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks in coding order: the table (0 for first coefficients), the symbol, the extra bits, their number."""
    first = np.diff(blocks[:, 0], prepend=0)
    row, at = np.nonzero(blocks[:, 1:])
    value = blocks[row, at + 1]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    run = at - np.where(fresh, -1, np.concatenate([[-1], at[:-1]])) - 1
    long = np.repeat(np.arange(len(run)), run // 16)  # runs of sixteen zeros
    last = np.full(len(blocks), -1)
    last[row] = at
    ends = np.flatnonzero(last < 62)
    wide, size = 200, _bits_of(value)
    none = lambda x: np.zeros(len(x), int)
    parts = [
        (np.arange(len(blocks)) * wide, none(first), _bits_of(first), first), (row[long] * wide + 2 * at[long] + 1, none(long) + 1, none(long) + 0xF0, none(long)),
        (row * wide + 2 * at + 2, none(row) + 1, run % 16 << 4 | size, value), (ends * wide + wide - 1, none(ends) + 1, none(ends), none(ends)),
    ]
    key, table, symbol, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    table, symbol, value = table[order], symbol[order], value[order]
    size = np.where(symbol == 0xF0, 0, symbol & 15) * (table == 1) + symbol * (table == 0)
    return table, symbol, np.where(value >= 0, value, value + (1 << size) - 1), size


def _packed(table: np.ndarray, symbol: np.ndarray, extra: np.ndarray, size: np.ndarray, codes: list[dict[int, tuple[int, int]]]) -> bytes:
    """Codes and extra bits one after another, filled up with ones; a zero follows a byte of ones."""
    known = np.zeros((2, 256, 2), np.int64)
    for k, found in enumerate(codes):
        for s, pair in found.items():
            known[k, s] = pair
    code, length = known[table, symbol].T
    value, length = code << size | extra, length + size
    end = np.cumsum(length)
    bits = np.ones(-(-int(end[-1]) // 8) * 8 if len(end) else 0, np.uint8)
    for k in range(int(length.max()) if len(length) else 0):
        some = length > k
        bits[end[some] - 1 - k] = value[some] >> k & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def to_ycc(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]


def encode(plane: np.ndarray, quality: int) -> bytes:
    """A gray (h, w) or RGB (h, w, 3) plane of bytes as a baseline JPEG with its own Huffman tables.

    Components come one scan each, so that their blocks need no interleaving.
    """
    q = tables(quality)
    planes = [plane] if plane.ndim == 2 else to_ycc(plane)
    h, w = plane.shape[:2]
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    for k in range(min(2, len(planes))):
        out.append(_segment(0xDB, bytes([k]) + bytes(q[k].reshape(-1)[_ZIGZAG].tolist())))
    frame = b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)])
    out.append(_segment(0xC0, frame + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes)))))
    for k, p in enumerate(planes):
        table, symbol, extra, size = _symbols(_coefficients(p, q[min(k, 1)]))
        codes = []
        for kind in (0, 1):
            kinds, counts = np.unique(symbol[table == kind], return_counts=True)
            number, symbols = _huffman(dict(zip(kinds.tolist(), counts.tolist())))
            codes.append(_code(number, symbols))
            out.append(_segment(0xC4, bytes([kind << 4]) + bytes(number) + bytes(symbols)))
        out.append(_segment(0xDA, bytes([1, k + 1, 0x00, 0, 63, 0])))
        out.append(_packed(table, symbol, extra, size, codes))
    return b"".join(out) + b"\xff\xd9"


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first frame header within 64 KiB; None if there is none or a side is 0."""
    if data[:2] != b"\xff\xd8":
        return None
    at, end = 2, min(len(data), 65_536)
    while at + 4 < end:
        if data[at] != 0xFF:
            at += 1
            continue
        m = data[at + 1]
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xCC):
            h, w = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
            return (w, h) if at + 9 < len(data) and w and h else None
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


class _Source:
    """Bits of entropy-coded data."""

    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.have = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.have < n:
            c = self.data[self.at] if self.at < len(self.data) else 255
            self.at += 1
            self.bits, self.have = self.bits << 8 | c, self.have + 8
        self.have -= n
        v = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("damaged JPEG")

    def number(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def decode(data: bytes, most_pixels: int = 100_000_000) -> np.ndarray:
    """A JPEG as a gray (h, w), RGB (h, w, 3) or four-component (h, w, 4) plane.

    ValueError for what isn't Huffman coded with 8 bits, is damaged or too large.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, frame, progressive, restart, adobe = 2, {}, {}, None, False, 0, None
    coefficients: dict[int, np.ndarray] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        m = data[at + 1]
        if m == 0xFF or m == 0 or 0xD0 <= m <= 0xD7:
            at += 1 if m == 0xFF else 2
            continue
        if m == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if m == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                raw = body[i + 1 : i + 1 + 64 * (1 + wide)]
                values = np.frombuffer(raw, ">u2" if wide else "u1").astype(int)
                quant[k] = np.zeros(64, int)
                quant[k][_ZIGZAG] = values
                i += 1 + 64 * (1 + wide)
        elif m == 0xC4:
            i = 0
            while i < len(body):
                number = list(body[i + 1 : i + 17])
                symbols = list(body[i + 17 : i + 17 + sum(number)])
                huff[body[i]] = {(n, c): s for s, (c, n) in _code(number, symbols).items()}
                i += 17 + sum(number)
        elif m == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m in (0xC0, 0xC1, 0xC2):
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not h or not w or h * w > most_pixels:
                raise ValueError("unsupported JPEG")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            frame, progressive = (h, w, parts, hm, vm), m == 0xC2
            for ident, hs, vs, _ in parts:
                coefficients[ident] = np.zeros((-(-h // (8 * vm)) * vs, -(-w // (8 * hm)) * hs, 64), int)
        elif 0xC3 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
            raise ValueError("unsupported JPEG")
        elif m == 0xDA and frame:
            end = at
            chunks, begin = [], at
            while end + 1 < len(data):
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if 0xD0 <= data[end + 1] <= 0xD7:
                    chunks.append(data[begin:end])
                    begin = end = end + 2
                elif data[end + 1] == 0:
                    end += 2
                else:
                    break
            chunks.append(data[begin:end])
            at = end
            try:
                _scan(frame, body, chunks, coefficients, huff, restart, progressive)
            except (KeyError, IndexError) as e:
                raise ValueError("damaged JPEG") from e
    if not frame:
        raise ValueError("no frame")
    h, w, parts, hm, vm = frame
    planes = []
    for ident, hs, vs, q in parts:
        c = coefficients[ident] * quant[q]
        pixels = _DCT.T @ c.reshape(-1, 8, 8) @ _DCT + 128
        rows, cols = c.shape[:2]
        plane = pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(np.repeat(np.repeat(plane, vm // vs, axis=0), hm // hs, axis=1)[:h, :w])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)
    if len(planes) == 3 and adobe != 0 or len(planes) == 4 and adobe == 2:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    out = np.clip(np.rint(np.stack(planes, axis=-1)), 0, 255).astype(np.uint8)
    return 255 - out if len(planes) == 4 and adobe is not None else out


def _scan(frame: tuple, body: bytes, chunks: list[bytes], coefficients: dict, huff: dict, restart: int, progressive: bool) -> None:
    h, w, parts, hm, vm = frame
    own = {p[0]: p for p in parts}
    listed = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
    first, last, fine = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]]
    units = []  # of each minimum coded unit: component, row, column, tables
    if len(listed) == 1:
        ident, t = listed[0]
        hs, vs = own[ident][1:3]
        rows, cols = -(-(-(-h * vs // vm)) // 8), -(-(-(-w * hs // hm)) // 8)
        units = [[(ident, y, x, t)] for y in range(rows) for x in range(cols)]
    else:
        for y in range(-(-h // (8 * vm))):
            for x in range(-(-w // (8 * hm))):
                units.append([(i, y * own[i][2] + v, x * own[i][1] + u, t) for i, t in listed for v in range(own[i][2]) for u in range(own[i][1])])
    step = restart or len(units)
    for n, chunk in enumerate(chunks):
        coder = _Coder(chunk, huff, first, last, fine >> 4, fine & 15, progressive)
        for unit in units[n * step : (n + 1) * step]:
            for ident, y, x, t in unit:
                coder.block(coefficients[ident][y, x], ident, t)


class _Coder:
    """Reads blocks of one scan between two restarts."""

    def __init__(self, chunk: bytes, huff: dict, first: int, last: int, high: int, low: int, progressive: bool):
        self.source, self.huff, self.before, self.skip = _Source(chunk.replace(b"\xff\0", b"\xff")), huff, {}, 0
        self.first, self.last, self.high, self.low = (first, min(last, 63), high, low) if progressive else (0, 63, 0, 0)
        self.split = progressive

    def block(self, block: np.ndarray, ident: int, t: int) -> None:
        s = self.source
        if self.first == 0:
            if self.high:
                block[0] |= s.take(1) << self.low
            else:
                self.before[ident] = self.before.get(ident, 0) + s.number(s.symbol(self.huff[t >> 4]))
                block[0] = self.before[ident] << self.low
            if self.split:
                return
        if self.high:
            self._refined(block, self.huff[0x10 | t & 15])
        else:
            self._direct(block, self.huff[0x10 | t & 15])

    def _direct(self, block: np.ndarray, table: dict) -> None:
        """Coefficients as they come first."""
        s, k = self.source, max(self.first, 1)
        if self.skip:
            self.skip -= 1
            return
        while k <= self.last:
            code = s.symbol(table)
            run, size = code >> 4, code & 15
            if size:
                k += run
                if k > 63:
                    raise ValueError("damaged JPEG")
                block[_ZIGZAG[k]] = s.number(size) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                if run:  # this block and some after it end here
                    self.skip = (1 << run) + s.take(run) - 1
                return

    def _refined(self, block: np.ndarray, table: dict) -> None:
        """One more bit of coefficients that are known, and new ones of that bit."""
        s, k, bit = self.source, self.first, 1 << self.low

        def correct(place: int) -> None:
            if s.take(1) and not abs(int(block[place])) & bit:
                block[place] += bit if block[place] > 0 else -bit

        if not self.skip:
            while k <= self.last:
                code = s.symbol(table)
                run, size = code >> 4, code & 15
                value = 0
                if size:
                    value = bit if s.take(1) else -bit
                elif run < 15:
                    self.skip = (1 << run) + (s.take(run) if run else 0)
                    break
                while k <= self.last:
                    place = _ZIGZAG[k]
                    if block[place]:
                        correct(place)
                    elif run:
                        run -= 1
                    else:
                        if value:
                            block[place] = value
                        k += 1
                        break
                    k += 1
        if self.skip:
            for j in range(k, self.last + 1):
                if block[_ZIGZAG[j]]:
                    correct(_ZIGZAG[j])
            self.skip -= 1

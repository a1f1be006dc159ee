"""A small JPEG 2000 encoder for tests: lossless, one tile, any number of code blocks and levels."""

import numpy as np

from leafmill.functions import jpx
from leafmill.functions.jbig2 import _LESS, _NEXT, _QE, _SWAP


class Coder:
    """The arithmetic encoder."""

    def __init__(self):
        self.out, self.a, self.c, self.count = [0], 0x8000, 0, 12

    def put(self, contexts, number, bit):
        state, likely = contexts[number] >> 1, contexts[number] & 1
        q = _QE[state]
        self.a -= q
        if bit == likely:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            contexts[number] = _NEXT[state] << 1 | likely
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            contexts[number] = _LESS[state] << 1 | (likely ^ _SWAP[state])
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.count -= 1
            if not self.count:
                self._byte()

    def _byte(self):
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= 0xFFFFF
            self.count = 7
        elif self.c < 0x8000000:
            self.out.append(self.c >> 19)
            self.c &= 0x7FFFF
            self.count = 8
        else:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                self.out.append(self.c >> 20)
                self.c &= 0xFFFFF
                self.count = 7
            else:
                self.out.append(self.c >> 19 & 0xFF)
                self.c &= 0x7FFFF
                self.count = 8

    def end(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self._byte()
        return bytes(self.out[1:] if self.out[-1] != 0xFF else self.out[1:-1])


def block(values, kind):
    """(data, bit planes, passes) of a code block."""
    h, w = values.shape
    planes = int(np.abs(values).max()).bit_length()
    if not planes:
        return b"", 0, 0
    size, neg = np.zeros((h + 2, w + 2), int), np.zeros((h + 2, w + 2), int)
    size[1:-1, 1:-1], neg[1:-1, 1:-1] = np.abs(values), values < 0
    seen, twice = np.zeros_like(size), np.zeros_like(size)
    contexts = [0] * 19
    contexts[0], contexts[17], contexts[18] = 8, 6, 92
    coder = Coder()
    put = lambda n, b: coder.put(contexts, n, int(b))

    def context(y, x):
        s = seen[y - 1 : y + 2, x - 1 : x + 2]
        return jpx._context(kind, s[1, 0] + s[1, 2], s[0, 1] + s[2, 1], s[0, 0] + s[0, 2] + s[2, 0] + s[2, 2])

    def signed(y, x):
        one = lambda v, u: seen[v, u] * (1 - 2 * neg[v, u])
        n, turned = jpx._SIGNS[int(np.clip(one(y, x - 1) + one(y, x + 1), -1, 1)), int(np.clip(one(y - 1, x) + one(y + 1, x), -1, 1))]
        put(n, neg[y, x] ^ turned)
        seen[y, x] = 1

    passes = 0
    for p in range(planes - 1, -1, -1):
        done = np.zeros_like(seen)
        for step in (2,) if p == planes - 1 else (0, 1, 2):
            passes += 1
            for top in range(1, h + 1, 4):
                for x in range(1, w + 1):
                    rows, y0 = range(top, min(top + 4, h + 1)), top
                    if step == 2 and len(rows) == 4 and not any(seen[y, x] or done[y, x] or context(y, x) for y in rows):
                        on = [y for y in rows if size[y, x] >> p & 1]
                        put(17, bool(on))
                        if not on:
                            continue
                        put(18, on[0] - top >> 1)
                        put(18, on[0] - top & 1)
                        signed(on[0], x)
                        y0 = on[0] + 1
                    for y in range(y0, rows.stop):
                        bit = size[y, x] >> p & 1
                        if step == 1:
                            if seen[y, x] and not done[y, x]:
                                put(16 if twice[y, x] else 15 if context(y, x) else 14, bit)
                                twice[y, x] = 1
                        elif not seen[y, x] and not done[y, x] and (step == 2 or context(y, x)):
                            done[y, x] = step == 0
                            put(context(y, x), bit)
                            if bit:
                                signed(y, x)
    return coder.end(), planes, passes


class Header:
    def __init__(self):
        self.bits = []

    def tree(self, values, w, told, x, y, limit):
        """Tag tree bits for a place up to a limit; told keeps (value told so far, whether it is known) of nodes."""
        h = len(values) // w
        levels = [np.array(values).reshape(h, w)]
        while levels[-1].size > 1:
            v = levels[-1]
            levels.append(np.array([[v[2 * j : 2 * j + 2, 2 * i : 2 * i + 2].min() for i in range(-(-v.shape[1] // 2))] for j in range(-(-v.shape[0] // 2))]))
        low = 0
        for k in range(len(levels) - 1, -1, -1):
            at, known = told.get((k, y >> k, x >> k), (0, False))
            at = max(at, low)
            while at < limit and not known:
                known = levels[k][y >> k, x >> k] <= at
                self.bits.append(int(known))
                at += not known
            told[k, y >> k, x >> k] = at, known
            low = at

    def number(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        out, left = bytearray(), list(self.bits)
        while left:
            n = 7 if out and out[-1] == 0xFF else 8
            now, left = left[:n], left[n:]
            out.append(int("".join(map(str, now + [0] * (n - len(now)))), 2))
        return bytes(out) + (b"\0" if out and out[-1] == 0xFF else b"")


def forward(x, begin):
    """One reversible step along the first axis: low and high parts."""
    n = len(x)
    if n == 0:
        return x, x
    if n == 1:
        return (x, x[:0]) if begin % 2 == 0 else (x[:0], x * 2)
    at = lambda i: x[(lambda j: j if j < n else 2 * n - 2 - j)(abs(i - begin) % (2 * n - 2))]
    high = {i: at(i) - ((at(i - 1) + at(i + 1)) >> 1) for i in range(begin - 2, begin + n + 2) if i % 2}
    low = [at(i) + ((high[i - 1] + high[i + 1] + 2) >> 2) for i in range(begin, begin + n) if i % 2 == 0]
    odd = [high[i] for i in range(begin, begin + n) if i % 2]
    empty = x[:0]
    return (np.stack(low) if low else empty), (np.stack(odd) if odd else empty)


def encode(planes, origin=(0, 0), levels=2, order=0, blocks=2, precinct=None, transform=False, sub=None, marks=0, layers=1):
    """A codestream of 8-bit planes at an origin; code blocks of 4 << blocks sides."""
    sub = sub or [(1, 1)] * len(planes)
    x0, y0 = origin
    x1 = max(x0 + p.shape[1] * dx for p, (dx, dy) in zip(planes[:1], sub))
    y1 = max(y0 + p.shape[0] * dy for p, (dx, dy) in zip(planes[:1], sub))
    work = [p.astype(int) - 128 for p in planes]
    if transform:
        r, g, b = work[:3]
        work[:3] = [(r + 2 * g + b) >> 2, b - g, r - g]
    image = object.__new__(jpx.Image)
    image.depth, image.sub = [8] * len(planes), sub
    raw = bytes([levels, blocks, blocks, 0, 1]) + (bytes([precinct[0] | precinct[1] << 4] * (levels + 1)) if precinct else b"")
    code = image._coding(raw, int(bool(precinct)), order, layers, transform)
    quant = bytes([0x40] + [11 << 3] * (3 * levels + 1))
    packets = []
    for c, (w, (dx, dy)) in enumerate(zip(work, sub)):
        box = -(-x0 // dx), -(-y0 // dy), -(-x1 // dx), -(-y1 // dy)
        bands = {}
        for r in range(levels, 0, -1):
            bx, by = -(-box[0] // (1 << levels - r)), -(-box[1] // (1 << levels - r))
            low, high = forward(w, by)
            ll, hl = (v.T for v in forward(low.T, bx)) if low.size else (low, low)
            lh, hh = (v.T for v in forward(high.T, bx)) if high.size else (high, high)
            bands[r], w = (hl, lh, hh), ll
        bands[0] = (w,)
        for r in range(levels + 1):
            for band, values in zip(image._level(c, r, code, box, quant, packets, (x0, y0), (dx, dy)), bands[r]):
                if band.values.size:
                    band.values[:] = values
    by = {0: lambda k: (k[5], k[0], k[3], k[4]), 1: lambda k: (k[0], k[5], k[3], k[4]), 2: lambda k: k, 3: lambda k: (k[1], k[2], k[3], k[0], k[4], k[5]), 4: lambda k: (k[3], k[1], k[2], k[0], k[4], k[5])}[order]
    body = bytearray()
    made, trees = {}, {}
    asked = [((*k, layer), p) for k, p in packets for layer in range(layers)]
    for nth, (key, precinct_) in enumerate(sorted(asked, key=lambda x: by(x[0]))):
        if marks & 2:
            body += b"\xff\x91\0\4" + (nth % 65_536).to_bytes(2, "big")
        h, data = Header(), b""
        h.bits.append(1)
        for group, (blocks_, w, *_) in enumerate(precinct_):
            for b in blocks_:
                if id(b) not in made:
                    u, v = b.box[0] - b.band.box[0], b.box[1] - b.band.box[1]
                    made[id(b)] = block(b.band.values[v : v + b.box[3] - b.box[1], u : u + b.box[2] - b.box[0]], b.band.kind)
            # blocks with an odd number come a layer later
            first = [(0 if i % 2 == 0 else layers - 1) if made[id(b)][2] else layers + 9 for i, b in enumerate(blocks_)]
            zeros = [b.band.bits - made[id(b)][1] for b in blocks_]
            inclusion, missing = trees.setdefault((key[:5], group), ({}, {}))
            for i, b in enumerate(blocks_):
                if first[i] < key[5]:
                    h.bits.append(0)
                    continue
                h.tree(first, w, inclusion, i % w, i // w, key[5] + 1)
                if first[i] > key[5]:
                    continue
                one, _, n = made[id(b)]
                for k in range(1, zeros[i] + 2):
                    h.tree(zeros, w, missing, i % w, i // w, k)
                if n == 1:
                    h.bits.append(0)
                elif n == 2:
                    h.bits += [1, 0]
                elif n <= 5:
                    h.bits += [1, 1]
                    h.number(n - 3, 2)
                elif n <= 36:
                    h.bits += [1] * 4
                    h.number(n - 6, 5)
                else:
                    h.bits += [1] * 9
                    h.number(n - 37, 7)
                need = max(0, len(one).bit_length() - (3 + n.bit_length() - 1))
                h.bits += [1] * need + [0]
                h.number(len(one), 3 + need + n.bit_length() - 1)
                data += one
        body += h.data() + (b"\xff\x92" if marks & 4 else b"") + data
    size = [x1, y1, x0, y0, x1, y1, 0, 0]
    siz = b"\0\0" + b"".join(v.to_bytes(4, "big") for v in size) + len(planes).to_bytes(2, "big") + b"".join(bytes([7, dx, dy]) for dx, dy in sub)
    cod = bytes([int(bool(precinct)) | marks, order]) + layers.to_bytes(2, "big") + bytes([int(transform)]) + raw
    segment = lambda m, b: m + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\x4f" + segment(b"\xff\x51", siz) + segment(b"\xff\x52", cod) + segment(b"\xff\x5c", quant)
    return head + b"\xff\x90\0\x0a\0\0" + (len(body) + 14).to_bytes(4, "big") + b"\0\1\xff\x93" + bytes(body) + b"\xff\xd9"


def boxed(stream, space):
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 ") + box(b"jp2h", box(b"colr", b"\1\0\0" + space.to_bytes(4, "big"))) + box(b"jp2c", stream)

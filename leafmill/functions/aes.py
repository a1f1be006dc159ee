"""AES in cipher block chaining. Decrypting takes all blocks of a text at once, over numpy."""

from __future__ import annotations

import hashlib

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The substitution box, its inverse, and products with 0 to 15 in the field of 256 elements."""
    double = [(x << 1 ^ (0x11B if x & 0x80 else 0)) & 0xFF for x in range(256)]

    def product(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a, b = double[a], b >> 1
        return out

    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x = product(x, 3)
    place = {v: i for i, v in enumerate(power)}
    box = []
    for v in range(256):
        inv = power[-place[v] % 255] if v else 0
        bits = inv
        for k in range(1, 5):
            bits ^= (inv << k | inv >> (8 - k)) & 0xFF
        box.append(bits ^ 0x63)
    s = np.array(box, np.uint8)
    inverse = np.zeros(256, np.uint8)
    inverse[s] = np.arange(256)
    return s, inverse, [np.array([product(v, m) for v in range(256)], np.uint8) for m in range(16)]


_BOX, _UNBOX, _TIMES = _tables()
_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_UNSHIFT = np.argsort(_SHIFT)


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(_BOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= constant
            constant = int(_TIMES[2][constant])
        elif n > 6 and i % n == 4:
            w = [int(_BOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, by: tuple[int, int, int, int]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    out = np.zeros_like(c)
    for row in range(4):
        for k in range(4):
            out[:, :, row] ^= _TIMES[by[(k - row) % 4]][c[:, :, k]]
    return out.reshape(-1, 16)


def decrypt_blocks(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(_UNBOX[s[:, _UNSHIFT]] ^ k, (14, 11, 13, 9))
    return _UNBOX[s[:, _UNSHIFT]] ^ keys[0]


def decrypt_cbc(key: bytes, start: bytes, data: bytes, padded: bool = True) -> bytes:
    """What data says, without its padding if it has any. An incomplete last block is left out."""
    n = len(data) // 16 * 16
    if not n:
        return b""
    blocks = np.frombuffer(data[:n], np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(start, np.uint8).reshape(1, 16), blocks[:-1]])
    out = (decrypt_blocks(blocks, _round_keys(key)) ^ before).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


#: A column's share of a round, for each byte at its place: substitution and mixing in one word.
_COLUMN = [[int.from_bytes(bytes(int(_TIMES[m][s]) for m in (2, 1, 1, 3)), "big") for s in _BOX]]
for _ in range(3):
    _COLUMN.append([w >> 8 | (w & 0xFF) << 24 for w in _COLUMN[-1]])
_PLAIN_BOX = _BOX.tolist()


def encrypt_cbc(key: bytes, start: bytes, data: bytes) -> bytes:
    """data, a whole number of blocks, encrypted without padding. Each block waits for the one
    before, so this goes block by block on whole words."""
    keys = [[int.from_bytes(bytes(k[4 * c : 4 * c + 4]), "big") for c in range(4)] for k in _round_keys(key)]
    t0, t1, t2, t3 = _COLUMN
    box, last, out = _PLAIN_BOX, int.from_bytes(start, "big"), []
    for i in range(0, len(data), 16):
        x = int.from_bytes(data[i : i + 16], "big") ^ last
        k = keys[0]
        a, b, c, d = x >> 96 ^ k[0], x >> 64 & 0xFFFFFFFF ^ k[1], x >> 32 & 0xFFFFFFFF ^ k[2], x & 0xFFFFFFFF ^ k[3]
        for k in keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        k, last = keys[-1], 0
        for n, (p, q, r, s) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
            last = last << 32 | (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k[n]
        out.append(last.to_bytes(16, "big"))
    return b"".join(out)


def hardened(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The password hash of revision 6: at least 64 rounds, each choosing its own digest."""
    k, n = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = encrypt_cbc(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]

"""ICC profiles of CMYK devices: inks to colours by the profile's own table, as sRGB.

The table for the relative colorimetric intent is used (or the perceptual one): curves, a grid of
colours that is interpolated in four dimensions, curves again. Colours are brought to sRGB with
black point compensation.
"""

from __future__ import annotations

from itertools import product

import numpy as np

LEAST, MOST = 128, 4 << 20
#: The white of profiles (D50), sRGB's matrix for it, and the bounds of Lab's curve.
D50 = np.array([0.9642, 1.0, 0.8249])
XYZ_TO_RGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])
EPSILON, KAPPA = 216 / 24389, 24389 / 27


class IccError(ValueError):
    pass


def _u16(d: bytes, at: int, n: int) -> np.ndarray:
    if at < 0 or at + 2 * n > len(d):
        raise IccError("cut off")
    return np.frombuffer(d, ">u2", n, at).astype(float)


def _u8(d: bytes, at: int, n: int) -> np.ndarray:
    if at < 0 or at + n > len(d):
        raise IccError("cut off")
    return np.frombuffer(d, np.uint8, n, at).astype(float)


def _int(d: bytes, at: int, size: int = 4) -> int:
    if at + size > len(d):
        raise IccError("cut off")
    return int.from_bytes(d[at : at + size], "big")


def tags(profile: bytes) -> dict[bytes, bytes]:
    """A profile's tags. IccError if it isn't one."""
    if not LEAST <= len(profile) <= MOST or profile[36:40] != b"acsp":
        raise IccError("no profile")
    out = {}
    for i in range(min(_int(profile, 128), 200)):
        at = 132 + 12 * i
        begin, size = _int(profile, at + 4), _int(profile, at + 8)
        out[profile[at : at + 4]] = profile[begin : begin + size]
    return out


class Transform:
    """From four inks to sRGB."""

    def __init__(self, profile: bytes):
        found = tags(profile)
        if profile[16:20] != b"CMYK" or profile[20:24] not in (b"Lab ", b"XYZ "):
            raise IccError("not a CMYK profile")
        table = found.get(b"A2B1") or found.get(b"A2B0")
        if not table:
            raise IccError("no table")
        self.lab = profile[20:24] == b"Lab "
        kind = table[:4]
        if kind not in (b"mft1", b"mft2"):
            raise IccError("kind of table")
        if (table[8], table[9]) != (4, 3) or not 2 <= table[10] <= 64:
            raise IccError("shape of table")
        self.grid, self.wide = table[10], kind == b"mft2"
        if self.wide:
            n_in, n_out, at, read, size, most = _int(table, 48, 2), _int(table, 50, 2), 52, _u16, 2, 65_535.0
        else:
            n_in, n_out, at, read, size, most = 256, 256, 48, _u8, 1, 255.0
        if not 2 <= n_in <= 4096 or not 2 <= n_out <= 4096:
            raise IccError("curves")
        self.inputs = read(table, at, 4 * n_in).reshape(4, n_in) / most
        at += 4 * n_in * size
        cells = self.grid**4 * 3
        self.colours = (read(table, at, cells) / most).reshape(*[self.grid] * 4, 3)
        at += cells * size
        self.outputs = read(table, at, 3 * n_out).reshape(3, n_out) / most
        # the darkest colour there is becomes black
        self.black = float(min(self._xyz(np.array([[1.0, 1.0, 1.0, 1.0]]))[0, 1], self._xyz(np.array([[0.0, 0.0, 0.0, 1.0]]))[0, 1], 0.5))

    def _curve(self, tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.linspace(0, 1, tables.shape[1])
        return np.stack([np.interp(x[:, k], at, tables[k]) for k in range(len(tables))], axis=1)

    def _xyz(self, inks: np.ndarray) -> np.ndarray:
        """Inks from 0 to 1 as XYZ."""
        place = np.clip(self._curve(self.inputs, inks), 0, 1) * (self.grid - 1)
        low = np.minimum(place.astype(int), self.grid - 2)
        part = place - low
        out = np.zeros((len(inks), 3))
        for corner in product((0, 1), repeat=4):
            weight = np.prod([part[:, k] if on else 1 - part[:, k] for k, on in enumerate(corner)], axis=0)
            out += weight[:, None] * self.colours[tuple(low[:, k] + on for k, on in enumerate(corner))]
        out = self._curve(self.outputs, out)
        if not self.lab:
            return out * (1 + 32767 / 32768)
        # 8 bits: L from 0 to 100, a and b from -128 to 127; 16 bits: 65280 stands for 100 and 255 - 128
        scale = 65_535 / 65_280 if self.wide else 1.0
        light, a, b = out[:, 0] * 100 * scale, out[:, 1] * 255 * scale - 128, out[:, 2] * 255 * scale - 128
        y = (light + 16) / 116
        f = np.stack([y + a / 500, y, y - b / 200], axis=1)
        return np.where(f**3 > EPSILON, f**3, (116 * f - 16) / KAPPA) * D50

    def rgb(self, plane: np.ndarray) -> np.ndarray:
        """A plane of four inks (bytes, 255 is full) as one of sRGB. Equal inks are looked up once."""
        flat = np.ascontiguousarray(plane.reshape(-1, 4))
        kinds, at = np.unique(flat.view(np.uint32).reshape(-1), return_inverse=True)
        xyz = np.concatenate([self._xyz(kinds[i : i + 65_536].view(np.uint8).reshape(-1, 4) / 255) for i in range(0, len(kinds), 65_536)])
        xyz = np.maximum((xyz / D50 - self.black) / (1 - self.black), 0) * D50
        linear = np.clip(xyz @ XYZ_TO_RGB.T, 0, 1)
        value = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
        return np.rint(value * 255).astype(np.uint8)[at].reshape(*plane.shape[:-1], 3)

"""Kernels on image planes: colour, samples, size, detail."""

from __future__ import annotations

import numpy as np

#: The corner terms of the CMYK to RGB matrix, for each pattern of inks (c, m, y, k).
CMYK_TERMS = (
    ((0, 0, 0, 0), (1.0, 1.0, 1.0)), ((0, 0, 0, 1), (0.1373, 0.1216, 0.1255)), ((0, 0, 1, 0), (1.0, 0.9490, 0.0)), ((0, 0, 1, 1), (0.1098, 0.1020, 0.0)),
    ((0, 1, 0, 0), (0.9255, 0.0, 0.5490)), ((0, 1, 0, 1), (0.1412, 0.0, 0.0)), ((0, 1, 1, 0), (0.9294, 0.1098, 0.1412)), ((0, 1, 1, 1), (0.1333, 0.0, 0.0)),
    ((1, 0, 0, 0), (0.0, 0.6784, 0.9373)), ((1, 0, 0, 1), (0.0, 0.0588, 0.1412)), ((1, 0, 1, 0), (0.0, 0.6510, 0.3137)), ((1, 0, 1, 1), (0.0, 0.0745, 0.0)),
    ((1, 1, 0, 0), (0.1804, 0.1922, 0.5725)), ((1, 1, 0, 1), (0.0, 0.0, 0.0078)), ((1, 1, 1, 0), (0.2118, 0.2119, 0.2235)), ((1, 1, 1, 1), (0.0, 0.0, 0.0)),
)
#: The band of extremes and the share of midtones of a near-bilevel plane; the stride of the detail score.
EXTREME, MIDTONES, STRIDE = 24, 0.05, 4
TOLERANCE = 1.08


def luma(plane: np.ndarray) -> np.ndarray:
    if plane.ndim == 2:
        return plane
    r, g, b = (plane[..., k].astype(np.uint32) for k in range(3))
    return ((2126 * r + 7152 * g + 722 * b) // 10_000).astype(np.uint8)


def detail(plane: np.ndarray) -> float:
    """The mean step to the right and lower neighbour, at every fourth pixel; 0 for less than 2 by 2."""
    p = luma(plane).astype(int)
    if min(p.shape) < 2:
        return 0.0
    here = p[:-1:STRIDE, :-1:STRIDE]
    right, below = p[:-1:STRIDE, 1::STRIDE][:, : here.shape[1]], p[1::STRIDE, :-1:STRIDE][: here.shape[0]]
    return float((np.abs(here - right) + np.abs(here - below)).sum() / (2 * here.size))


def near_bilevel(plane: np.ndarray) -> bool:
    p = luma(plane)
    return int(((p > EXTREME) & (p < 255 - EXTREME)).sum()) <= p.size * MIDTONES


def colourless(plane: np.ndarray) -> bool:
    return plane.ndim == 2 or bool((plane[..., 0] == plane[..., 1]).all() and (plane[..., 1] == plane[..., 2]).all())


def naive_cmyk(p: np.ndarray) -> np.ndarray:
    white = 255 - p[..., 3:].astype(np.uint32)
    return (((255 - p[..., :3].astype(np.uint32)) * white + 127) // 255).astype(np.uint8)


def calibrated_cmyk(p: np.ndarray) -> np.ndarray:
    """CMYK to RGB by the matrix of corner terms; bytes are cut off, not rounded."""
    ink = p.astype(float) / 255
    out = np.zeros((*p.shape[:-1], 3))
    for pattern, colour in CMYK_TERMS:
        x = np.ones(p.shape[:-1])
        for k, on in enumerate(pattern):
            x = x * (ink[..., k] if on else 1 - ink[..., k])
        out += x[..., None] * np.array(colour)
    return (np.clip(out, 0, 1) * 255).astype(np.uint8)


def from_ycc(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, b, r = y.astype(float), cb.astype(float) - 128, cr.astype(float) - 128
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return np.floor(np.clip(rgb, 0, 255) + 0.5).astype(np.uint8)


def ycck_to_cmyk(p: np.ndarray) -> np.ndarray:
    return np.concatenate([255 - from_ycc(p[..., 0], p[..., 1], p[..., 2]), p[..., 3:]], axis=-1)


def unpack(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, whose rows begin at whole bytes; width counts samples."""
    size = (width * bits + 7) // 8
    raw = np.frombuffer(data[: size * height].ljust(size * height, b"\0"), np.uint8).reshape(height, size)
    if bits == 8:
        return raw[:, :width]
    split = np.unpackbits(raw, axis=1).reshape(height, -1, bits)
    return (split @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]


def looked_up(index: np.ndarray, palette: bytes, channels: int) -> np.ndarray:
    """Indexes as colours; ValueError if one is out of the palette."""
    table = np.frombuffer(palette, np.uint8)[: len(palette) // channels * channels].reshape(-1, channels)
    if index.size and int(index.max()) >= len(table):
        raise ValueError("index out of the palette")
    return table[index]


def _weights(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights of each target place: Catmull-Rom, widened when shrinking."""
    scale = source / target
    support = 2 * max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    first = np.floor(centre - support).astype(int)
    at = first[:, None] + np.arange(int(np.ceil(2 * support)) + 2)
    x = np.abs(at - centre[:, None]) / max(scale, 1.0)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    w = np.where((at >= 0) & (at < source), w, 0)
    return np.clip(at, 0, source - 1), w / w.sum(axis=1, keepdims=True)


def resized(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    p = plane.astype(float)
    at, w = _weights(p.shape[0], height)
    p = np.stack([np.tensordot(w[i], p[at[i]], axes=(0, 0)) for i in range(height)])
    at, w = _weights(p.shape[1], width)
    p = np.stack([np.tensordot(p[:, at[i]], w[i], axes=(1, 0)) for i in range(width)], axis=1)
    return np.clip(np.rint(p), 0, 255).astype(np.uint8)


def target_size(width: int, height: int, cap: int) -> tuple[int, int]:
    """The size within a cap of the longest side; as it is if that is at most 8 % above."""
    longest = max(width, height)
    if longest <= int(cap * TOLERANCE):
        return width, height
    return max(1, round(width * cap / longest)), max(1, round(height * cap / longest))


def psnr(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of two planes' luma, in dB; None if sizes differ."""
    if a.shape[:2] != b.shape[:2]:
        return None
    error = float(((luma(a).astype(float) - luma(b).astype(float)) ** 2).mean())
    return float("inf") if error == 0 else 10 * float(np.log10(255**2 / error))

"""Rolling hashes of byte windows, for many documents at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of two independent hashes.
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in _BASES)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Random numbers for each byte, so that no two bytes differ by a small amount.
_BYTES = tuple(mixed(np.arange(1, 257, dtype=U) * b) for b in _BASES)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


class Rolling:
    """Hashes of any windows of a byte array, in constant time each."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[0][raw] * _powers(_BASES[0], len(raw))[:-1], dtype=U)])
        self.inverse = _powers(_INVERSES[0], len(raw))

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window of that size at each place where one fits."""
        if len(self.sums) <= size:
            return np.zeros(0, U)
        return mixed((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(U))


class Moving:
    """The hash of a window of each row, which moves over the columns. lane: which of the two hashes."""

    def __init__(self, columns: np.ndarray, size: int, lane: int):
        self.columns, self.size, self.at = columns, size, 0
        self.bytes, self.inverse = _BYTES[lane], _INVERSES[lane]
        powers = _powers(_BASES[lane], size)
        self.top = powers[size - 1]
        self.sum = np.zeros(columns.shape[1], U)
        for k in range(size):
            self.sum += self.bytes[columns[k]] * powers[k]

    def move(self) -> None:
        self.sum = (self.sum - self.bytes[self.columns[self.at]]) * self.inverse + self.bytes[self.columns[self.at + self.size]] * self.top
        self.at += 1

    def hashes(self) -> np.ndarray:
        return mixed(self.sum)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each width neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some width neighbours. What decides is only the
    neighbours' content: windows that are equal have the same anchors."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = sliding(grams, width, np.minimum)
    # the greatest of the minima of all stretches around a place is its own hash if it is one of them
    pad = np.concatenate([np.zeros(width - 1, U), low, np.zeros(width - 1, U)])
    return np.flatnonzero(sliding(pad, width, np.maximum) == grams)

"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Round j inserts the suffix of length j of each document that has one, that is one symbol per
document. The transform and the lengths of common prefixes lie in a file per first symbol;
a round reads the files of the last one from front to back and writes new ones, so memory
holds only the documents and a few numbers per symbol.

The rounds are as many as the longest document has bytes, and each goes over the whole
transform, so the work is the collection's size times its longest document. That is what
keeps it from corpora with long documents; repeats.py says what runs there instead.
"""

from __future__ import annotations

import os
import struct
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

#: A record: symbol before the suffix (0 for none, else byte + 1), document, place, common prefix, new.
_RECORD = struct.Struct("<HIIIB")


class _Files:
    """One file of records per first symbol, of one round."""

    def __init__(self, folder: str, round_: int):
        self.folder, self.round, self.out = folder, round_, {}

    def path(self, symbol: int) -> str:
        return os.path.join(self.folder, f"{self.round}-{symbol}")

    def write(self, symbol: int, record: tuple) -> None:
        if symbol not in self.out:
            self.out[symbol] = open(self.path(symbol), "wb")  # noqa: SIM115
        self.out[symbol].write(_RECORD.pack(*record))

    def close(self) -> None:
        for f in self.out.values():
            f.close()

    def read(self, symbol: int) -> Iterator[tuple]:
        if symbol in self.out:
            with open(self.path(symbol), "rb") as f:
                while data := f.read(_RECORD.size * 4096):
                    yield from _RECORD.iter_unpack(data)

    def drop(self) -> None:
        for s in self.out:
            os.remove(self.path(s))


def build(texts: list[bytes], folder: str) -> _Files:
    """The last round's files: all suffixes in order, documents' ends by their number."""
    now = _Files(folder, 0)
    for d, t in enumerate(texts):
        now.write(0, (t[-1] + 1 if t else 0, d, len(t), 0, 1))
    now.close()
    for round_ in range(1, max(map(len, texts), default=0) + 1):
        new = _Files(folder, round_)
        old = {s: now.read(s) for s in now.out}  # what a symbol's file holds already, met in order
        for record in now.read(0):
            new.write(0, (*record[:4], 0))
        last: dict[int, int] = {}
        places: list[int] = []  # of the least common prefixes from some place on, rising
        lows: list[int] = []
        at = 0
        for s in sorted(now.out):
            for symbol, d, place, common, fresh in now.read(s):
                while lows and lows[-1] >= common:
                    lows.pop()
                    places.pop()
                lows.append(common)
                places.append(at)
                if symbol:
                    # the suffix one longer stands in the symbol's file, next after those met before
                    low = 0
                    if symbol in last:
                        i = bisect_right(places, last[symbol])
                        low = 1 + lows[i]
                    last[symbol] = at
                    if fresh:
                        p = place - 1
                        new.write(symbol, (texts[d][p - 1] + 1 if p else 0, d, p, low, 1))
                    else:
                        new.write(symbol, (*next(old[symbol])[:3], low, 0))
                at += 1
        new.close()
        now.drop()
        now = new
    return now


def transform(texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(symbol before, document, place, common prefix with the one before) of all suffixes in order."""
    with tempfile.TemporaryDirectory() as folder:
        files = build(texts, folder)
        return [r[:4] for s in sorted(files.out) for r in files.read(s)]


def repeated(texts: list[bytes], length: int) -> list[list[list[int]]]:
    """For each document the [begin, end) ranges covered by length bytes that also start elsewhere."""
    starts: list[set[int]] = [set() for _ in texts]
    before: tuple[int, int] | None = None
    with tempfile.TemporaryDirectory() as folder:
        files = build(texts, folder)
        for s in sorted(files.out):
            for _, d, place, common, _ in files.read(s):
                if common >= length and before:
                    starts[d].add(place)
                    starts[before[0]].add(before[1])
                before = (d, place)
    out = []
    for found in starts:
        runs: list[list[int]] = []
        for a in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = a + length
            else:
                runs.append([a, a + length])
        out.append(runs)
    return out

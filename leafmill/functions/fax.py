"""Fax coding of bilevel planes: Group 4 both ways, Group 3 one-dimensional reading."""

from __future__ import annotations

import numpy as np

#: Run-length codes, for lengths 0 to 63, then multiples of 64, as bit strings.
WHITE_RUNS = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"""
WHITE_MULTIPLES = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK_RUNS = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"""
BLACK_MULTIPLES = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010
0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111
0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
LONG_MULTIPLES = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110
000000010111 000000011100 000000011101 000000011110 000000011111"""
#: Two-dimensional modes.
MODES = {"0001": "P", "001": "H", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
_MODE_CODE = {v: k for k, v in MODES.items()}
END_OF_LINE = "000000000001"


def _codes(runs: str, multiples: str) -> dict[int, str]:
    out = dict(enumerate(runs.split()))
    out |= {64 * (i + 1): c for i, c in enumerate(multiples.split())}
    return out | {1792 + 64 * i: c for i, c in enumerate(LONG_MULTIPLES.split())}


WHITE, BLACK = _codes(WHITE_RUNS, WHITE_MULTIPLES), _codes(BLACK_RUNS, BLACK_MULTIPLES)
_LENGTH = ({c: n for n, c in WHITE.items()}, {c: n for n, c in BLACK.items()})


def _run_code(length: int, black: bool) -> str:
    codes, out = BLACK if black else WHITE, ""
    while length >= 2560:
        out += codes[2560]
        length -= 2560
    if length >= 64:
        out += codes[length // 64 * 64]
    return out + codes[length % 64]


def changes(row: np.ndarray) -> list[int]:
    """Places where a row's colour changes, white (False) being what it is before its begin."""
    return np.flatnonzero(np.diff(np.append(False, row).astype(np.int8))).tolist()


def _reference(before: list[int], a0: int, black: bool, width: int) -> tuple[int, int]:
    """b1 and b2: the first change of the row above right of a0 to the opposite colour, and the next."""
    for i, x in enumerate(before):
        if x > a0 and (i % 2 == 1) == black:
            return x, before[i + 1] if i + 1 < len(before) else width
    return width, width


def encode_g4(plane: np.ndarray) -> bytes:
    """A boolean plane (black is True) in Group 4."""
    height, width = plane.shape
    bits: list[str] = []
    before: list[int] = []
    for y in range(height):
        now = changes(plane[y])
        a0, black = -1, False
        while a0 < width:
            start = max(a0, 0)
            a1 = next((x for i, x in enumerate(now) if x >= start and x > a0 and (i % 2 == 1) == black), width)
            b1, b2 = _reference(before, a0, black, width)
            if b2 < a1:
                bits.append(_MODE_CODE["P"])
                a0 = b2
            elif abs(a1 - b1) <= 3:
                bits.append(_MODE_CODE[a1 - b1])
                a0, black = a1, not black
            else:
                a2 = next((x for x in now if x > a1), width)
                bits.append(_MODE_CODE["H"] + _run_code(a1 - start, black) + _run_code(a2 - a1, not black))
                a0 = a2
        before = now
    bits.append(END_OF_LINE * 2)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


class _Bits:
    def __init__(self, data: bytes):
        self.text = bin(int.from_bytes(b"\1" + data, "big"))[3:]
        self.at = 0

    def one_of(self, table: dict[str, object], longest: int = 13):
        for n in range(1, longest + 1):
            key = self.text[self.at : self.at + n]
            if len(key) < n:
                return None
            if key in table:
                self.at += n
                return table[key]
        return None

    def run(self, black: bool) -> int | None:
        total = 0
        while True:
            n = self.one_of(_LENGTH[black])
            if n is None:
                return None
            total += n
            if n < 64:
                return total


def _row(now: list[int], width: int) -> np.ndarray:
    row = np.zeros(width, bool)
    for a, b in zip(now[::2], [*now[1::2], width] if len(now) % 2 else now[1::2]):
        row[a:b] = True
    return row


def decode_g4(data: bytes, width: int, height: int) -> np.ndarray | None:
    """The plane of Group 4 data; rows after damage are white. None if not even one row is whole."""
    bits, plane, before = _Bits(data), np.zeros((height, width), bool), []
    for y in range(height):
        now: list[int] = []
        a0, black = -1, False
        while a0 < width:
            mode = bits.one_of(MODES, 7)
            if mode is None:
                return plane if y else None
            b1, b2 = _reference(before, a0, black, width)
            if mode == "P":
                a0 = b2
            elif mode == "H":
                first, second = bits.run(black), bits.run(not black)
                if first is None or second is None:
                    return plane if y else None
                a1 = min(max(a0, 0) + first, width)
                a2 = min(a1 + second, width)
                now += [a1, a2]
                a0 = a2
            else:
                a1 = min(max(b1 + mode, max(a0, 0)), width)
                now.append(a1)
                a0, black = a1, not black
        before = [x for x in now if x < width]
        plane[y] = _row(before, width)
    return plane


def decode_g3(data: bytes, width: int, height: int, end_of_line: bool = False, aligned: bool = False) -> np.ndarray | None:
    """The plane of one-dimensional Group 3 data."""
    bits, plane = _Bits(data), np.zeros((height, width), bool)
    for y in range(height):
        if end_of_line:
            mark = bits.text.find(END_OF_LINE, bits.at)
            if mark >= 0 and not bits.text[bits.at : mark].strip("0"):
                bits.at = mark + 12
        elif aligned:
            bits.at += -bits.at % 8
        x, black = 0, False
        while x < width:
            n = bits.run(black)
            if n is None:
                return plane if y else None
            plane[y, x : min(x + n, width)] = black
            x, black = x + n, not black
    return plane

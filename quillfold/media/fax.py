"""Two-dimensional run coding of black and white rows (ITU-T T.6), as PDF's CCITT filter with K below 0 has it."""

from __future__ import annotations

import numpy as np

# The run codes of ITU-T T.4, for 0 to 63, then for 64, 128 and so on to 1728, and those both colours share
# from 1792 to 2560; then the codes of the modes.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111
0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010
00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010
00110011 00110100 11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101
011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001
010011010 011000 010011011""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111
0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010
000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011
000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100
000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111
000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110
000001100111 0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100
0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101
0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100
0000001100101""".split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001"


def lengths(codes: list[str]) -> dict[str, int]:
    return {code: k if k < 64 else 64 * (k - 63) for k, code in enumerate(codes)} | {code: 1792 + 64 * k for k, code in enumerate(LONG)}


RUNS = (lengths(WHITE), lengths(BLACK))
MODES = {PASS: "pass", HORIZONTAL: "horizontal"} | {code: d for d, code in VERTICAL.items()}


def changes(row: np.ndarray) -> list[int]:
    """Where a row of 0 (white) and 1 (black) changes colour, beginning from white."""
    return np.flatnonzero(np.diff(row, prepend=0)).tolist()


def run(n: int, black: int) -> str:
    codes, out = BLACK if black else WHITE, ""
    while n >= 2560:
        out, n = out + LONG[-1], n - 2560
    if n >= 1792:
        out, n = out + LONG[(n - 1792) // 64], n % 64
    elif n >= 64:
        out, n = out + codes[63 + n // 64], n % 64
    return out + codes[n]


def reference(above: list[int], a0: int, black: int, width: int) -> tuple[int, int]:
    """b1 and b2: the first change of the row above that is right of a0 and of the colour opposite to this one, and the next."""
    k = next((k for k, x in enumerate(above) if x > a0 and k % 2 == black), len(above))
    return above[k] if k < len(above) else width, above[k + 1] if k + 1 < len(above) else width


def encode(rows: np.ndarray) -> bytes:
    """Rows of 0 (white) and 1 (black), an end mark behind them."""
    width, above, out = rows.shape[1], [], []
    for row in rows:
        here = changes(row)
        a0, black = -1, 0
        while a0 < width:
            a1 = next((x for x in here if x > a0 and (a0 >= 0 or x >= 0)), width) if a0 >= 0 else (here[0] if here else width)
            if a0 < 0 and black == 0 and here and here[0] == 0:
                a1 = 0
            b1, b2 = reference(above, a0, black, width)
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, black = a1, 1 - black
            else:
                a2 = next((x for x in here if x > a1), width)
                out.append(HORIZONTAL + run(a1 - max(a0, 0), black) + run(a2 - a1, 1 - black))
                a0 = a2
            if a0 >= width:
                break
        above = here
    bits = "".join(out) + END + END
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def decode(data: bytes, width: int, height: int = 0) -> np.ndarray:
    """Rows of 0 (white) and 1 (black); as many as there are, or `height`. ValueError where the codes make no sense."""
    bits = bin(int.from_bytes(b"\1" + data, "big"))[3:]
    at, rows, above = 0, [], []

    def code(table: dict):
        nonlocal at
        for n in range(1, 14):
            if (found := table.get(bits[at : at + n])) is not None:
                at += n
                return found
        raise ValueError("no such code")

    def length(black: int) -> int:
        total = 0
        while True:
            n = code(RUNS[black])
            total += n
            if n < 64:
                return total

    while not height or len(rows) < height:
        if bits[at : at + 12] == END or at >= len(bits):
            break
        here, a0, black = [], -1, 0
        while a0 < width:
            mode = code(MODES)
            b1, b2 = reference(above, a0, black, width)
            if mode == "pass":
                a0 = b2
                continue
            if mode == "horizontal":
                a1 = max(a0, 0) + length(black)
                a2 = a1 + length(1 - black)
                here += [a1, a2]
                a0 = a2
            else:
                a0 = b1 + mode
                here.append(a0)
                black = 1 - black
            if here and (here[-1] > width or len(here) > 1 and here[-1] < here[-2]):
                raise ValueError("a run leaves its row")
        marks = np.zeros(width + 1, np.int8)
        np.add.at(marks, np.minimum(here, width), 1)
        rows.append(marks[:width].cumsum() % 2)
        above = [x for x in changes(rows[-1])]
    return np.array(rows, np.uint8).reshape(len(rows), width)

"""Elias-Fano sequences and packed integers over memory-mapped words, read many places at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Values that are packed at a time. A multiple of 64: each stretch begins with a word.
STRETCH = 1 << 16
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: SELECT[r, b]: the place of the set bit of rank r in byte b.
SELECT = np.array([[next((k for k in range(8) if b >> k & 1 and bin(b & ((1 << k) - 1)).count("1") == r), 0) for b in range(256)] for r in range(8)], np.uint8)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """values, each below 2**bits, one after another in 64-bit words, with a word to spare."""
    out = np.zeros(len(values) * bits // 64 + 2, U)
    for a in range(0, len(values), STRETCH):
        v = values[a : a + STRETCH].astype(U)
        at = np.arange(a, a + len(v), dtype=U) * U(bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(out, word, v << shift)
        over = shift + U(bits) > U(64)
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def unpacked(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.int64)
    p = at.astype(U) * U(bits)
    word, shift = (p >> U(6)).astype(np.int64), p & U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return ((low | high) & U((1 << bits) - 1)).astype(np.int64)


def monotone(values: np.ndarray) -> dict[str, np.ndarray]:
    """Elias-Fano parts of a non-decreasing sequence: low bits packed, high bits in unary, and a rank for each word."""
    n, most = len(values), int(values[-1]) if len(values) else 0
    bits = max(0, (most // max(1, n)).bit_length() - 1)
    high = np.zeros(((most >> bits) + n - 1) // 64 + 1 if n else 1, U)
    for a in range(0, n, STRETCH):
        ones = values[a : a + STRETCH].astype(U) >> U(bits)
        ones += np.arange(a, a + len(ones), dtype=U)
        np.bitwise_or.at(high, (ones >> U(6)).astype(np.int64), U(1) << (ones & U(63)))
    count = POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.uint32)
    rank = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.uint32)
    return {"bits": np.array([bits], U), "low": packed(values & ((1 << bits) - 1), bits) if bits else np.zeros(1, U), "high": high, "rank": rank}


def placed(parts: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the high bits, and the bits in them, that stand for the given places: a select."""
    word = np.searchsorted(parts["rank"], at, side="right") - 1
    left = (at - parts["rank"][word]).astype(np.uint8)
    bytes_ = parts["high"][word].view(np.uint8).reshape(-1, 8)
    counts = np.bitwise_count(bytes_).cumsum(1, dtype=np.uint8)
    k = (counts <= left[:, None]).sum(1)
    rows = np.arange(len(at))
    left -= np.where(k > 0, counts[rows, np.maximum(k - 1, 0)], np.uint8(0))
    return word, k * 8 + SELECT[left, bytes_[rows, k]]


def element(parts: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The sequence's elements at the given places: a select on the high bits, joined to the low ones."""
    word, bit = placed(parts, at)
    bits = int(parts["bits"][0])
    return ((word * 64 + bit - at) << bits) | unpacked(parts["low"], bits, at)


def neighbours(parts: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements at the given places and those behind them, of places before the last: after one select, the next bit."""
    word, bit = placed(parts, at)
    bits, high = int(parts["bits"][0]), parts["high"]
    rest = high[word] & ~((U(2) << bit.astype(U)) - U(1))
    behind = word.copy()
    empty = np.flatnonzero(rest == 0)
    while len(empty):
        behind[empty] += 1
        rest[empty] = high[behind[empty]]
        empty = empty[rest[empty] == 0]
    next_ = np.bitwise_count((rest & (~rest + U(1))) - U(1))
    first = ((word * 64 + bit - at) << bits) | unpacked(parts["low"], bits, at)
    return first, ((behind * 64 + next_ - at - 1) << bits) | unpacked(parts["low"], bits, at + 1)


def save(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays with a small index in front, each at a multiple of 8."""
    names = sorted(arrays)
    head, body, at = [], [], 0
    for name in names:
        a = np.ascontiguousarray(arrays[name])
        pad = -a.nbytes % 8
        head.append(f"{name},{a.dtype.str},{len(a)},{at}")
        body += [a.tobytes(), b"\0" * pad]
        at += a.nbytes + pad
    index = ";".join(head).encode()
    index += b" " * (-len(index) % 8)
    return len(index).to_bytes(8, "little") + index + b"".join(body)


def load(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Views into the mapped bytes of save()."""
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for entry in raw[8 : 8 + n].tobytes().decode().strip().split(";"):
        name, kind, size, at = entry.split(",")
        a = 8 + n + int(at)
        out[name] = raw[a : a + int(size) * np.dtype(kind).itemsize].view(kind)
    return out

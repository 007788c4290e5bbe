"""Files that are encrypted for their permissions only: opened with the empty password, by RC4 or AES.

Of the standard handler, revisions 2 to 6 are known. The tables of AES are made from its field arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed value: the bytes that fill up a password.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, x in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[k] = x ^ s[(a + b) & 255]
    return bytes(out)


def times(a: int, b: int) -> int:
    """The product in AES's field."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution of bytes, from inverses in the field, and its inverse."""
    power, box, x = [], [0x63] * 256, 1
    for _ in range(255):
        power.append(x)
        x = times(x, 3)
    for k, x in enumerate(power):
        v = power[-k % 255]
        box[x] = v ^ rotated(v, 1) ^ rotated(v, 2) ^ rotated(v, 3) ^ rotated(v, 4) ^ 0x63
    forward = np.array(box, np.uint8)
    back = np.zeros(256, np.uint8)
    back[forward] = np.arange(256)
    return forward, back


def rotated(v: int, r: int) -> int:
    return (v << r | v >> (8 - r)) & 255


BOX, BACK = boxes()
PRODUCT = {f: np.array([times(x, f) for x in range(256)], np.uint8) for f in (9, 11, 13, 14)}
#: Where each byte of a block comes from when rows are shifted back.
SHIFTED = np.array([(4 * (c - r) + r) % 16 for c in range(4) for r in range(4)])


def round_keys(key: bytes) -> list[np.ndarray]:
    n = len(key) // 4
    words, factor = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
    while len(words) < 4 * (n + 7):
        w = list(words[-1])
        if len(words) % n == 0:
            w = [int(BOX[x]) for x in w[1:] + w[:1]]
            w[0] ^= factor
            factor = times(factor, 2)
        elif n > 6 and len(words) % n == 4:
            w = [int(BOX[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-n], w, strict=True)])
    flat = np.array(words, np.uint8).reshape(-1, 16)
    return list(flat)


def aes(key: bytes, data: bytes, start: bytes) -> bytes:
    """Chained blocks back to plain ones, all blocks at once."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    keys = round_keys(key)
    x = blocks ^ keys[-1]
    for k in reversed(keys[:-1]):
        x = BACK[x[:, SHIFTED]] ^ k
        if k is not keys[0]:
            c = x.reshape(-1, 4, 4)
            x = np.stack([PRODUCT[14][c[..., r]] ^ PRODUCT[11][c[..., (r + 1) % 4]] ^ PRODUCT[13][c[..., (r + 2) % 4]] ^ PRODUCT[9][c[..., (r + 3) % 4]] for r in range(4)], 2).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (x ^ before).tobytes()


#: A byte's substitution, spread over a column as the mixing of columns has it.
MIXED = [(times(x, 2), x, x, times(x, 3)) for x in BOX.tolist()]
FORWARD = [4 * ((c + r) % 4) + r for c in range(4) for r in range(4)]


def chained(key: bytes, data: bytes, start: bytes) -> bytes:
    """Plain blocks to chained ones, one after another."""
    keys, box = [k.tolist() for k in round_keys(key)], BOX.tolist()
    out, x = bytearray(), list(start)
    for at in range(0, len(data) // 16 * 16, 16):
        x = [a ^ b ^ k for a, b, k in zip(x, data[at : at + 16], keys[0], strict=True)]
        for own in keys[1:-1]:
            x = [x[k] for k in FORWARD]
            mixed = []
            for c in (0, 4, 8, 12):
                a, b, d, e = MIXED[x[c]], MIXED[x[c + 1]], MIXED[x[c + 2]], MIXED[x[c + 3]]
                mixed += [a[r] ^ b[r - 1] ^ d[r - 2] ^ e[r - 3] for r in range(4)]
            x = [a ^ k for a, k in zip(mixed, own, strict=True)]
        x = [box[x[k]] ^ own for k, own in zip(FORWARD, keys[-1], strict=True)]
        out += bytes(x)
    return bytes(out)


def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The slow digest of revision 6."""
    k, n, last = hashlib.sha256(password + salt + user).digest(), 0, 0
    while n < 64 or last > n - 32:
        sent = chained(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(sent[:16]) % 3](sent).digest()
        n, last = n + 1, sent[-1]
    return k[:32]


def unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


class Lock:
    """The key of a file, from its encryption dictionary and first id; ValueError if the empty password does not open it."""

    def __init__(self, entries: dict, file_id: bytes):
        version, self.revision = int(entries.get("V", 0)), int(entries.get("R", 0))
        if entries.get("Filter") != "Standard" or not 2 <= self.revision <= 6:
            raise ValueError("unknown encryption")
        method = entries.get("method", "V2")
        self.kind = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256", "Identity": "none", "None": "none"}.get(method) if version >= 4 else "rc4"
        if self.kind is None:
            raise ValueError("unknown encryption")
        size = 5 if version == 1 else int(entries.get("Length", 128 if version >= 4 else 40)) // 8
        owner, user = bytes(entries["O"]), bytes(entries["U"])
        if self.revision >= 5:
            digest = (lambda salt: hashlib.sha256(salt).digest()) if self.revision == 5 else (lambda salt: hardened(b"", salt))
            if digest(user[32:40]) != user[:32]:
                raise ValueError("a password is needed")
            self.key = aes(digest(user[40:48]), bytes(entries["UE"])[:32], bytes(16))
            return
        parts = PAD + owner[:32] + (int(entries["P"]) & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if self.revision >= 4 and entries.get("EncryptMetadata") is False:
            parts += b"\xff\xff\xff\xff"
        key = hashlib.md5(parts).digest()
        if self.revision >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if self.revision == 2:
            right = rc4(self.key, PAD) == user[:32]
        else:
            mark = hashlib.md5(PAD + file_id).digest()
            for k in range(20):
                mark = rc4(bytes(x ^ k for x in self.key), mark)
            right = mark == user[:16]
        if not right:
            raise ValueError("a password is needed")

    def opened(self, data: bytes, number: int, generation: int) -> bytes:
        """The plain bytes of a string or stream of an object."""
        if self.kind == "none":
            return data
        if self.kind == "aes256":
            return unpadded(aes(self.key, data[16:], data[:16])) if len(data) >= 32 else b""
        own = self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.kind == "aes" else b"")
        own = hashlib.md5(own).digest()[: min(16, len(self.key) + 5)]
        if self.kind == "rc4":
            return rc4(own, data)
        return unpadded(aes(own, data[16:], data[:16])) if len(data) >= 32 else b""

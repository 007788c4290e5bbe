"""Encrypted files that the empty password opens."""

import hashlib
import shutil
import subprocess

import numpy as np
import pytest

from quillfold.media import crypt
from quillfold.sinks import pdf as sink
from quillfold.sources import pdf
from tests.made import made, stream


def test_known_answers():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes(bytes(range(16)), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a"), bytes(16)) == plain
    assert crypt.aes(bytes(range(32)), bytes.fromhex("8ea2b7ca516745bfeafc49904b496089"), bytes(16)) == plain
    assert crypt.BOX[0x53] == 0xED and crypt.BACK[0xED] == 0x53


@pytest.mark.skipif(not shutil.which("openssl"), reason="no openssl")
def test_chained_blocks():
    data = np.random.default_rng(1).bytes(160)
    key, start = bytes(range(16)), bytes(range(100, 116))
    sent = subprocess.run(["openssl", "enc", "-aes-128-cbc", "-K", key.hex(), "-iv", start.hex()], input=data, capture_output=True, check=True).stdout
    assert crypt.unpadded(crypt.aes(key, sent, start)) == data
    for size, name in ((16, "128"), (32, "256")):
        key = bytes(range(7, 7 + size))
        want = subprocess.run(["openssl", "enc", f"-aes-{name}-cbc", "-nopad", "-K", key.hex(), "-iv", start.hex()], input=data, capture_output=True, check=True).stdout
        assert crypt.chained(key, data, start) == want and crypt.aes(key, want, start) == data


@pytest.mark.parametrize("revision", [5, 6])
def test_keys_of_256_bits(revision):
    key, salts = bytes(range(32)), (b"12345678", b"abcdefgh")
    digest = (lambda p, s: hashlib.sha256(p + s).digest()) if revision == 5 else crypt.hardened

    def entries(password):
        return {"Filter": "Standard", "V": 5, "R": revision, "method": "AESV3", "O": bytes(48), "U": digest(password, salts[0]) + salts[0] + salts[1], "UE": crypt.chained(digest(password, salts[1]), key, bytes(16)), "P": -4}

    lock = crypt.Lock(entries(b""), b"")
    text = b"sixteen bytes..." + bytes([16]) * 16
    assert lock.key == key and lock.opened(bytes(16) + crypt.chained(key, text, bytes(16)), 7, 0) == text[:16]
    with pytest.raises(ValueError, match="password"):
        crypt.Lock(entries(b"word"), b"")


def locked(revision: int, password: bytes = b"") -> bytes:
    """A file of two pages encrypted by RC4."""
    file_id, size = b"0123456789abcdef", 5 if revision == 2 else 16
    owner, flags = bytes(range(32)), -44
    first = (password + crypt.PAD)[:32]
    key = hashlib.md5(first + owner + (flags & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    user = crypt.rc4(key, crypt.PAD)
    if revision > 2:
        user = hashlib.md5(crypt.PAD + file_id).digest()
        for k in range(20):
            user = crypt.rc4(bytes(x ^ k for x in key), user)
        user += bytes(16)

    def own(n: int, data: bytes) -> bytes:
        return crypt.rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[: min(16, size + 5)], data)

    inner = b"4 0 5 20 << /Type /Page /A 1 >><< /Type /Page /B 2 >>"
    first_at = inner.index(b"<<")
    inner = inner.replace(b"5 20", b"5 %d" % (inner.index(b"<<", first_at + 1) - first_at))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Title <" + own(1, b"secret title").hex().encode() + b"> >>", 2: b"<< /Type /Pages /Kids [4 0 R 5 0 R] /Count 2 >>",
        3: stream(f"/Type /ObjStm /N 2 /First {inner.index(b'<<')}", own(3, inner)),
        9: f"<< /Filter /Standard /V {1 if revision == 2 else 2} /R {revision} /Length {size * 8} /P {flags} /O <{owner.hex()}> /U <{user.hex()}> >>".encode(),
    }
    return made(objects, f"/Root 1 0 R /Encrypt 9 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


@pytest.mark.parametrize("revision", [2, 3])
def test_permission_encryption_goes(spark, revision):
    parsed = pdf.parse(locked(revision))
    assert parsed.encrypted and parsed.locked is None and len(list(pdf.pages_of(parsed))) == 2
    again = pdf.parse(sink.written(parsed))
    assert not again.encrypted and again.head(again.trailer["Root"])["Title"] == b"secret title" and len(list(pdf.pages_of(again))) == 2


def test_files_with_a_password_stay():
    parsed = pdf.parse(locked(3, b"word"))
    assert parsed.encrypted and parsed.locked == "a password is needed"
    with pytest.raises(ValueError, match="password"):
        sink.written(parsed)

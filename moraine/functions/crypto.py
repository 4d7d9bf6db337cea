"""The optional encrypted profile: Curve25519 agreement, ChaCha20 and sealed blobs.

A blob is the ephemeral public key (32 bytes), the nonce (8 bytes, little-endian) and the ciphertext;
its id is the SHA3-224 of all that. Keys are drawn for each partition and attempt, never shared, so
no (key, nonce) pair is used twice; ids therefore differ from run to run.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np

PRIME = 2**255 - 19
BASE = (9).to_bytes(32, "little")


def x25519(scalar: bytes, point: bytes) -> bytes:
    """Scalar multiplication on Curve25519 (RFC 7748), by a Montgomery ladder over integers."""
    k = int.from_bytes(scalar, "little") & ~7 & (1 << 255) - 1 | 1 << 254
    u = int.from_bytes(point, "little") & (1 << 255) - 1
    low, high = (1, 0), (u, 1)  # multiples of the point as x : z, one apart
    for bit in range(254, -1, -1):
        if k >> bit & 1:
            low, high = high, low
        (a, b), (c, d) = low, high
        p, q = (a + b) ** 2 % PRIME, (a - b) ** 2 % PRIME
        r, s = (a - b) * (c + d) % PRIME, (a + b) * (c - d) % PRIME
        gap = p - q
        low = p * q % PRIME, gap * (p + 121665 * gap) % PRIME
        high = (r + s) ** 2 % PRIME, u * (r - s) ** 2 % PRIME
        if k >> bit & 1:
            low, high = high, low
    return (low[0] * pow(low[1], PRIME - 2, PRIME) % PRIME).to_bytes(32, "little")


def _left(v: np.ndarray, n: int) -> np.ndarray:
    return v << np.uint32(n) | v >> np.uint32(32 - n)


def chacha20(key: bytes, nonce: bytes, n: int, counter: int = 0) -> bytes:
    """n bytes of key stream: 20 rounds, 64-bit counter, 64-bit nonce; all blocks at once in numpy."""
    blocks = -(-n // 64)
    start = np.empty((16, blocks), np.uint32)
    start[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    start[4:12] = np.frombuffer(key, "<u4")[:, None]
    count = np.arange(counter, counter + blocks, dtype=np.uint64)
    start[12], start[13] = count & np.uint64(0xFFFFFFFF), count >> np.uint64(32)
    start[14:] = np.frombuffer(nonce, "<u4")[:, None]
    # Four columns are mixed at a time; turning rows 1 to 3 makes the diagonals columns.
    state = start.reshape(4, 4, blocks).copy()
    for half in range(20):
        a, b, c, d = state
        for left, right in ((16, 12), (8, 7)):
            a += b
            d = _left(d ^ a, left)
            c += d
            b = _left(b ^ c, right)
        way = 1 if half % 2 else -1
        state = np.stack([a, np.roll(b, way, 0), np.roll(c, 2 * way, 0), np.roll(d, 3 * way, 0)])
    return (state.reshape(16, blocks) + start).T.astype("<u4").tobytes()[:n]


def _stream(shared: bytes, nonce: bytes, data: bytes) -> bytes:
    stream = chacha20(hashlib.sha3_256(shared).digest(), nonce, len(data))
    return np.bitwise_xor(np.frombuffer(data, np.uint8), np.frombuffer(stream, np.uint8)).tobytes()


class Sealer:
    """Seals blobs for one recipient under a fresh ephemeral key; make one for each task attempt."""

    def __init__(self, recipient: bytes, secret: bytes | None = None):
        secret = secret or os.urandom(32)
        self.public, self.shared, self.sequence = x25519(secret, BASE), x25519(secret, recipient), 0

    def seal(self, data: bytes) -> tuple[bytes, bytes]:
        """(id, blob)"""
        self.sequence += 1
        nonce = self.sequence.to_bytes(8, "little")
        blob = self.public + nonce + _stream(self.shared, nonce, data)
        return hashlib.sha3_224(blob).digest(), blob


class Opener:
    """Opens blobs with a secret key; the agreement with each ephemeral key is made once."""

    def __init__(self, secret: bytes):
        self.secret, self.shared = secret, {}

    def open(self, blob: bytes, name: bytes | None = None) -> bytes:
        if name is not None and hashlib.sha3_224(blob).digest() != name:
            raise ValueError("the blob does not have its id")
        public = blob[:32]
        if public not in self.shared:
            self.shared[public] = x25519(self.secret, public)
        return _stream(self.shared[public], blob[32:40], blob[40:])


def generate_key() -> bytes:
    return os.urandom(32)


def public_key(secret: bytes) -> bytes:
    return x25519(secret, BASE)

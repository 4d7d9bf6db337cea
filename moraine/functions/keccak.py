"""The Keccak sponge at any rate and output length; hashlib has only the standard ones.

Bloom filters of the compatible format take 8k bytes at a rate of 200 - 16k.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1


def _constants() -> list[int]:
    """Round constants from the linear feedback register of FIPS 202."""
    out, lfsr = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if lfsr & 1:
                word |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        out.append(word)
    return out


def _offsets() -> dict[tuple[int, int], int]:
    """Rotation of each lane: triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, OFFSETS = _constants(), _offsets()


def _turn(v: int, n: int) -> int:
    return (v << n | v >> (64 - n)) & MASK if n else v


def permute(lanes: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    five = range(5)
    for constant in CONSTANTS:
        column = [lanes[x, 0] ^ lanes[x, 1] ^ lanes[x, 2] ^ lanes[x, 3] ^ lanes[x, 4] for x in five]
        mix = [column[x - 1] ^ _turn(column[(x + 1) % 5], 1) for x in five]
        moved = {(y, (2 * x + 3 * y) % 5): _turn(lanes[x, y] ^ mix[x], OFFSETS[x, y]) for x in five for y in five}
        lanes = {(x, y): moved[x, y] ^ (~moved[(x + 1) % 5, y] & MASK & moved[(x + 2) % 5, y]) for x in five for y in five}
        lanes[0, 0] ^= constant
    return lanes


def keccak(data: bytes, size: int, rate: int | None = None) -> bytes:
    """`size` bytes of SHA-3 output, at most one rate; the usual rate is 200 - 2 size."""
    rate = rate or 200 - 2 * size
    fill = rate - len(data) % rate
    padded = bytearray(data + b"\x06" + bytes(fill - 1))
    padded[-1] |= 0x80
    lanes = {(x, y): 0 for x in range(5) for y in range(5)}
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            lanes[k % 5, k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        lanes = permute(lanes)
    return b"".join(lanes[k % 5, k // 5].to_bytes(8, "little") for k in range(25))[:size]


def _turned(v: np.ndarray, n: int) -> np.ndarray:
    return v << np.uint64(n) | v >> np.uint64(64 - n) if n else v


def keccak_many(items: list[bytes], size: int, rate: int | None = None) -> np.ndarray:
    """keccak() of many items at once, one a row of bytes: the sponge's lanes are arrays over the items."""
    rate = rate or 200 - 2 * size
    out = np.zeros((len(items), size), np.uint8)
    blocks = np.array([len(x) // rate + 1 for x in items], np.int64)
    for n in np.unique(blocks).tolist():  # items of as many blocks are padded and permuted together
        rows = np.flatnonzero(blocks == n)
        padded = np.zeros((len(rows), n * rate), np.uint8)
        for k, i in enumerate(rows.tolist()):
            padded[k, : len(items[i])] = np.frombuffer(items[i], np.uint8)
            padded[k, len(items[i])] = 0x06
        padded[:, -1] |= 0x80
        words = padded.view("<u8").astype(np.uint64).reshape(len(rows), n, rate // 8)
        lanes = [[np.zeros(len(rows), np.uint64) for _ in range(5)] for _ in range(5)]  # [x][y]
        for block in range(n):
            for k in range(rate // 8):
                lanes[k % 5][k // 5] = lanes[k % 5][k // 5] ^ words[:, block, k]
            lanes = _permuted(lanes)
        flat = np.stack([lanes[k % 5][k // 5] for k in range(-(-size // 8))], 1).astype("<u8")
        out[rows] = flat.view(np.uint8)[:, :size]
    return out


def _permuted(lanes: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    five = range(5)
    for constant in CONSTANTS:
        column = [np.bitwise_xor.reduce(lanes[x]) for x in five]
        mix = [column[x - 1] ^ _turned(column[(x + 1) % 5], 1) for x in five]
        moved = {(y, (2 * x + 3 * y) % 5): _turned(lanes[x][y] ^ mix[x], OFFSETS[x, y]) for x in five for y in five}
        lanes = [[moved[x, y] ^ (~moved[(x + 1) % 5, y] & moved[(x + 2) % 5, y]) for y in five] for x in five]
        lanes[0][0] = lanes[0][0] ^ np.uint64(constant)
    return lanes

"""Keccak-256 with the original padding, as contracts use it, from the public specification."""

from __future__ import annotations

from functools import lru_cache

RATE = 136
MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """Bits of a linear feedback register (x^8 + x^6 + x^5 + x^4 + 1) at positions 2^j - 1."""
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state <<= 1
            if state & 0x100:
                state ^= 0x171
        out.append(value)
    return out


def _rotations() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, TURNS = _round_constants(), _rotations()


def _turn(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & MASK if n else v


def _permute(a: list[list[int]]) -> list[list[int]]:
    for constant in CONSTANTS:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        flip = [parity[x - 1] ^ _turn(parity[(x + 1) % 5], 1) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _turn(a[x][y] ^ flip[x], TURNS[x, y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y] & MASK) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


@lru_cache(65536)
def keccak256(data: bytes) -> bytes:
    padded = data + b"\x01" + b"\0" * (RATE - 1 - len(data) % RATE)
    padded = padded[:-1] + bytes([padded[-1] | 0x80])
    state = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), RATE):
        for i in range(RATE // 8):
            state[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        state = _permute(state)
    return b"".join(state[i % 5][i // 5].to_bytes(8, "little") for i in range(4))

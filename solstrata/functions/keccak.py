"""Keccak-256 and the selectors made from it; neither Spark nor hashlib has that padding."""

from __future__ import annotations

import re

_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """The 24 constants, from the linear feedback register of the permutation's definition."""
    out, register = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if register & 1:
                constant |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        out.append(constant)
    return out


def _rotations() -> tuple[list[list[int]], list[tuple[int, int]]]:
    offsets = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        offsets[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return offsets, [(i, j) for i in range(5) for j in range(5)]


_ROUNDS = _round_constants()
_OFFSETS, _LANES = _rotations()


def _permute(a: list[list[int]]) -> None:
    for constant in _ROUNDS:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[x - 1] ^ ((c[(x + 1) % 5] << 1 | c[(x + 1) % 5] >> 63) & _MASK) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x, y in _LANES:
            v, r = a[x][y] ^ d[x], _OFFSETS[x][y]
            b[y][(2 * x + 3 * y) % 5] = (v << r | v >> (64 - r)) & _MASK
        for x, y in _LANES:
            a[x][y] = b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y])
        a[0][0] ^= constant


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        _permute(a)
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def canonical_type(name: str) -> str:
    """A parameter type as the selector has it: aliases widened, contracts and user types as address, blanks gone."""
    name = re.sub(r"\s+|payable", "", name)
    base, _, rest = name.partition("[")
    tail = "[" + rest if rest or name.endswith("]") else ""
    if base.startswith("("):
        return name
    base = {"uint": "uint256", "int": "int256", "byte": "bytes1", "fixed": "fixed128x18", "ufixed": "ufixed128x18"}.get(base, base)
    known = re.fullmatch(r"u?int\d+|bytes\d*|address|bool|string|function|u?fixed\d+x\d+", base)
    return (base if known else "address") + tail


def canonical_signature(name: str, types: list[str]) -> str:
    return f"{name}({','.join(map(canonical_type, types))})"


def selector(signature: str) -> bytes:
    return keccak256(signature.encode())[:4]

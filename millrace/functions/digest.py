"""Digests of single values (Columns), and of byte streams (hasher)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ALGORITHMS = ("md2", "md5", "sha1", "sha256", "sha384", "sha512")


def _pi_digits():
    """The decimal digits of pi, one after the other (Gibbons' spigot)."""
    q, r, t, k, n, m = 1, 0, 1, 1, 3, 3
    while True:
        if 4 * q + r - t < n * t:
            yield n
            q, r, n = 10 * q, 10 * (r - n * t), (10 * (3 * q + r)) // t - 10 * n
        else:
            q, r, t, k, n, m = q * k, (2 * q + r) * m, t * m, k + 1, (q * (7 * k + 2) + r * m) // (t * m), m + 2


def _md2_table() -> list[int]:
    """The permutation of RFC 1319: a shuffle of 0 to 255 by the digits of pi."""
    digits = _pi_digits()

    def below(n: int) -> int:
        while True:
            x, y = next(digits), 10
            if n > 10:
                x, y = x * 10 + next(digits), 100
            if n > 100:
                x, y = x * 10 + next(digits), 1000
            if x < n * (y // n):
                return x % n

    table = list(range(256))
    for i in range(2, 257):
        j = below(i)
        table[j], table[i - 1] = table[i - 1], table[j]
    return table


class MD2:
    """MD2 (RFC 1319), with the interface of hashlib."""

    table: list[int] = []

    def __init__(self) -> None:
        MD2.table = MD2.table or _md2_table()
        self.state, self.sums, self.last, self.rest = bytearray(16), bytearray(16), 0, b""

    def _block(self, block: bytes, sums: bool = True) -> None:
        s = self.table
        if sums:
            for i, c in enumerate(block):
                self.sums[i] ^= s[c ^ self.last]
                self.last = self.sums[i]
        x = bytearray(self.state) + block + bytes(a ^ b for a, b in zip(self.state, block, strict=True))
        t = 0
        for j in range(18):
            for i in range(48):
                x[i] ^= s[t]
                t = x[i]
            t = (t + j) % 256
        self.state = x[:16]

    def update(self, data: bytes) -> None:
        data = self.rest + data
        whole = len(data) // 16 * 16
        for i in range(0, whole, 16):
            self._block(data[i : i + 16])
        self.rest = data[whole:]

    def hexdigest(self) -> str:
        n = 16 - len(self.rest)
        self.update(bytes([n]) * n)
        self._block(bytes(self.sums), sums=False)
        return bytes(self.state).hex()


def hasher(algorithm: str):
    """An object with update() and hexdigest(). hashlib has no MD2."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"one of {ALGORITHMS}")
    return MD2() if algorithm == "md2" else hashlib.new(algorithm)


def md2_of(values: list[bytes]) -> list[str]:
    """Digests of many values: a block of each at a time, all values side by side."""
    import numpy as np

    MD2.table = MD2.table or _md2_table()
    table = np.array(MD2.table, np.uint8)
    padded = [v + bytes([16 - len(v) % 16]) * (16 - len(v) % 16) for v in values]
    order = sorted(range(len(values)), key=lambda i: -len(padded[i]))
    n_blocks = np.array([len(padded[i]) // 16 for i in order], np.int64)
    flat = np.frombuffer(b"".join(padded[i] for i in order), np.uint8).reshape(-1, 16)
    first = np.cumsum(n_blocks) - n_blocks
    state, sums = np.zeros((16, len(values)), np.uint8), np.zeros((16, len(values)), np.uint8)

    def take_in(block, n: int) -> None:
        x = np.concatenate([state[:, :n], block, state[:, :n] ^ block])
        t = np.zeros(n, np.uint8)
        for j in range(18):
            for i in range(48):
                x[i] ^= table[t]
                t = x[i]
            t = t + np.uint8(j)
        state[:, :n] = x[:16]

    for b in range(int(n_blocks.max(initial=0))):
        n = int(np.searchsorted(-n_blocks, -b, side="left"))  # values with more than b blocks
        block = np.ascontiguousarray(flat[first[:n] + b].T)
        last = sums[15, :n].copy()
        for i in range(16):
            sums[i, :n] ^= table[block[i] ^ last]
            last = sums[i, :n]
        take_in(block, n)
    take_in(sums, len(values))
    out = [""] * len(values)
    for place, i in enumerate(order):
        out[i] = state[:, place].tobytes().hex()
    return out


@pandas_udf(StringType())
def _md2(values: pd.Series) -> pd.Series:
    known = values.notna()
    out = pd.Series([None] * len(values), index=values.index, dtype="object")
    out[known] = md2_of([bytes(x) for x in values[known]])
    return out


def digest(value: Column, algorithm: str) -> Column:
    """Hexadecimal digest of a value's bytes."""
    value = value.cast("binary")
    if algorithm == "md2":
        return _md2(value)
    return {"md5": F.md5, "sha1": F.sha1}[algorithm](value) if algorithm in ("md5", "sha1") else F.sha2(value, int(algorithm[3:]))

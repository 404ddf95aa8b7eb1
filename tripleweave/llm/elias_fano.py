"""Elias-Fano coding of a non-decreasing sequence, with constant-time-like select.

Each value's low bits are packed side by side; its high part is a unary gap in a bit vector. Per value
that is about 2 + log2(universe / n) bits. ``select`` finds the i-th set bit of the vector from a
sample of every SAMPLE-th, so one value is read without decoding the others.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQB7x")


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing, 0 or more."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    sample = at[::SAMPLE].astype("<u8").tobytes()
    packed = np.packbits(lows, bitorder="little").tobytes()
    return _HEAD.pack(n, len(bits), low) + sample + packed + np.packbits(bits, bitorder="little").tobytes()


class EliasFano:
    """Reads what :func:`encode` wrote."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.n_bits, self.low = _HEAD.unpack_from(data)
        a = _HEAD.size
        b = a + 8 * -(-self.n // SAMPLE)
        c = b + -(-self.n * self.low // 8)
        self.size = c + -(-self.n_bits // 8)
        self.sample = np.frombuffer(data, "<u8", -(-self.n // SAMPLE), a)
        self._lows = np.frombuffer(data, np.uint8, c - b, b)
        self._bits = np.frombuffer(data, np.uint8, self.size - c, c)

    def _low(self, i: int) -> int:
        a, b = i * self.low, (i + 1) * self.low
        return (int.from_bytes(self._lows[a // 8 : -(-b // 8)].tobytes(), "little") >> a % 8) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.sample[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        now = int(self._bits[byte]) >> at % 8 << at % 8
        while rest >= now.bit_count():
            rest -= now.bit_count()
            byte += 1
            now = int(self._bits[byte])
        for _ in range(rest):
            now &= now - 1
        place = 8 * byte + (now & -now).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self._bits, bitorder="little")[: self.n_bits])
        bits = np.unpackbits(self._lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        lows = (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1) if self.low else np.zeros(self.n, np.int64)
        return (places - np.arange(self.n)) << self.low | lows

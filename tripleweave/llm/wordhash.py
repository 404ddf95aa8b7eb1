"""Hashes of all words of a batch of texts, by array operations only.

A word's hash is a polynomial over its bytes, taken from prefix sums over the whole buffer, so the
cost is a few array passes and no Python work for each word. Equal words have equal hashes; unequal
words with equal hashes are possible, so callers compare the bytes of what they find.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
U = np.uint64


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n at least of the base and of its inverse."""
    return _powers(_PIECE if n <= _PIECE else 1 << int(n).bit_length())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def byte_values(word_bytes: bytes, fold_case: bool) -> np.ndarray:
    """A random-looking value for each byte: 0 if it isn't part of words."""
    out = np.zeros(256, np.uint64)
    for b in word_bytes:
        out[b] = b + 1 + 32 * (fold_case and 65 <= b <= 90)
    return np.where(out > 0, mixed(out * U(0xD6E8FEB86659FD93)) | U(1), U(0))


class Words:
    """The words of a list of texts: ``hashes``, ``starts`` and ``ends`` (bytes in ``buffer``), and ``first``, where the words of each text begin (one entry more than texts)."""

    def __init__(self, texts: list[bytes | None], values: np.ndarray):
        self.buffer = b"\0".join(t or b"" for t in texts) + b"\0"
        data = np.frombuffer(self.buffer, np.uint8)
        ends_of_texts = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64) - 1 if texts else np.zeros(0, np.int64)
        inside = (values > 0)[data]
        inside[ends_of_texts] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends_of_texts)]).astype(np.int64)
        self.hashes = self._hashes(data, values)

    def _hashes(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + _PIECE, "right")))
            piece = values[data[low : self.ends[j - 1]]]
            up, down = powers(len(piece))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * up[: len(piece)], out=sums[1:])
            s, e = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mixed((sums[e] - sums[s]) * down[s])
            i = j
        return out

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the hash of the k words from it on, and whether its text has so many."""
        n = len(self.hashes)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h[: n - i] = h[: n - i] * U(0xC2B2AE3D27D4EB4F) + self.hashes[i:] if n > i else h[: n - i]
        return mixed(h), self.left() >= k

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

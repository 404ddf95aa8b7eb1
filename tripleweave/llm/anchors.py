"""Anchors: a content-defined sparse sample of the suffixes of texts.

Every window of ``match`` bytes has one anchor, the place in it where the hash of the next GRAM bytes
is least (the first of equals). What the anchor is depends on the window's bytes alone, so equal
windows have equal anchors at equal places, and neighbouring windows mostly share one. All windows of
a text are thus cut into runs with one anchor each, about 2 / (match - GRAM) of the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tripleweave.llm.wordhash import U, byte_values, mixed, powers

GRAM = 128
#: Bytes taken at once; longer texts are cut, with as much overlap as a window needs.
PIECE = 1 << 20
_PLACE = 24
_VALUES = byte_values(bytes(range(256)), fold_case=False)


class Sums:
    """Hashes of any span of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.at = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.at[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.at[ends] - self.at[starts]) * self.down[starts])

    def windows(self, first: int, last: int, size: int) -> np.ndarray:
        """Of the windows of ``size`` bytes that start at first..last."""
        a, b = self.at[first : last + 1], self.at[first + size : last + 1 + size]
        return mixed((b - a) * self.down[first : last + 1])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` neighbours the least."""
    m, w = keys, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(keys) - width + 1], m[width - w :]) if w < width else m


def cut(texts: list[bytes], match: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Pieces of at most PIECE bytes, or little more: which texts, from which byte on each, and the bytes; every window is in one."""
    which, froms, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < match:
            continue
        at = 0
        while True:
            part = t[at : at + PIECE]
            if held and held + len(part) > PIECE:
                yield which, froms, b"".join(parts)
                which, froms, parts, held = [], [], [], 0
            which.append(i)
            froms.append(at)
            parts.append(part)
            held += len(part)
            if at + PIECE >= len(t):
                break
            at += PIECE - match + 1
    if which:
        yield which, froms, b"".join(parts)


def runs(texts: list[bytes], match: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All runs of windows: ``text`` (index), ``anchor``, ``low`` and ``high`` (first and last window start), ``gram`` (hash of the anchor's bytes) and ``span`` (hash of all bytes of the run's windows and of where the anchor lies)."""
    found: dict[str, list] = {k: [] for k in ("text", "anchor", "low", "high", "gram", "span")}
    for which, froms, data in cut(texts, match):
        buffer = np.frombuffer(data, np.uint8)
        n = len(buffer)
        lengths = np.array([min(PIECE, len(texts[i]) - f) for i, f in zip(which, froms)], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sums = Sums(buffer)
        h = sums.windows(0, n - gram, gram)
        keys = (h >> U(_PLACE) << U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        anchor = (least(keys, match - gram + 1) & U((1 << _PLACE) - 1)).astype(np.int64)
        inside = np.zeros(len(anchor) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends - match + 1, -1)
        valid = np.cumsum(inside[:-1]) > 0
        change = np.ones(len(anchor), bool)
        change[1:] = anchor[1:] != anchor[:-1]
        change[starts] = True
        low = np.flatnonzero(change & valid)
        if not len(low):
            continue
        piece = np.searchsorted(ends, low, "right")
        stop = np.flatnonzero(change | ~valid)
        high = np.append(stop, len(anchor))[np.searchsorted(stop, low) + 1] - 1
        a = anchor[low]
        shift = np.array(froms, np.int64)[piece] - starts[piece]
        found["text"].append(np.array(which, np.int64)[piece])
        found["anchor"].append(a + shift)
        found["low"].append(low + shift)
        found["high"].append(high + shift)
        found["gram"].append(h[a])
        found["span"].append(mixed(sums.spans(low, high + match) + ((a - low) << 32 | (high - low)).astype(np.uint64)))
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("gram", "span") else np.int64) for k, v in found.items()}

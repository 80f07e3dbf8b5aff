"""Words ``[^\\x20\\x09-\\x0D]+`` of byte strings and their 64-bit hashes.

A hash is a polynomial over seeded byte values modulo 2^64, so that every word
of a block comes from one prefix sum.
"""

from __future__ import annotations

import numpy as np

from qoeflow.llm.common import U64, mix64, seeded

#: Bytes hashed at once: temporaries take about 60 times this.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_CUTS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


class Poly:
    """Prefix-sum polynomial hash of ranges of a uint64 array."""

    def __init__(self, seed: int):
        self.m = int(seeded(1, seed)[0]) | 1
        self.inv = pow(self.m, -1, 1 << 64)
        self.pw = self.ipw = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if n > len(self.pw):
            n = max(n, 2 * len(self.pw))
            for name, f in (("pw", self.m), ("ipw", self.inv)):
                a = np.full(n, f, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.pw[:len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.ipw[start])


_VALUES, _POLY = seeded(256, 11), Poly(101)


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(space)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and hash of each word; the text is worked off in blocks cut
    at spaces."""
    starts: list[np.ndarray] = []
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in _CUTS)
            if cut > at:
                end = cut
            else:                     # one word longer than a block
                end = min((p for p in (data.find(b, end) for b in _CUTS) if p >= 0), default=len(data))
        part = data[at:end]
        start, stop = spans(part)
        codes = np.frombuffer(part, np.uint8)
        starts.append(start + at)
        out.append(_POLY.ranges(_POLY.prefix(_VALUES[codes]), start, stop))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(out)

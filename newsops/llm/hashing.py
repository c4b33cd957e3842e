"""64-bit hashes of words, word windows and lines, computed on whole arrays of UTF-8 bytes.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D), which on valid UTF-8
is the same as the code-point class ``[^\\x20\\x09-\\x0D]+``.  Texts are hashed in blocks of about
one megabyte that end at white space, so the working memory does not grow with a document.
"""

from __future__ import annotations

import re

import numpy as np

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Word positions and hashes of texts; holds the table of powers, so make one per task."""

    block = 1 << 20
    table = 1 << 16

    def __init__(self):
        steps = np.full(self.table, U64(0x9E3779B97F4A7C15 | 1), dtype=U64)
        steps[0] = 1
        self.powers = np.cumprod(steps, dtype=U64)
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.gap = re.compile(rb"[\x20\x09-\x0D]")

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start offsets, end offsets and hashes of the words of ``data``."""
        parts, begin = [], 0
        while begin < len(data):
            end = min(begin + self.block, len(data))
            if end < len(data):
                at = self.gap.search(data, end)
                end = at.start() if at else len(data)
            parts.append(self._hashed(data[begin:end], begin))
            begin = end
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0, dtype=U64)
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _hashed(self, data: bytes, offset: int):
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = ~self.space[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside.size and inside[0]:
            edges = np.concatenate(([0], edges))
        if inside.size and inside[-1]:
            edges = np.concatenate((edges, [inside.size]))
        starts, ends = edges[0::2], edges[1::2]
        if not starts.size:
            return starts, ends, np.empty(0, dtype=U64)
        tail = raw[starts[0]:]
        own = np.arange(starts[0], raw.size) - np.repeat(starts, np.diff(starts, append=raw.size))
        terms = (tail.astype(U64) + U64(1)) * self.powers[own & (self.table - 1)]
        terms[~inside[starts[0]:]] = 0
        sums = np.add.reduceat(terms, starts - starts[0])
        return starts + offset, ends + offset, mix(sums + (ends - starts).astype(U64))

    def runs(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each range ``begins[i]:ends[i]`` of a sequence of word hashes."""
        out = np.zeros(len(begins), dtype=U64)
        full = ends > begins
        if full.any():
            lengths = (ends - begins)[full]
            first = np.cumsum(lengths) - lengths
            own = np.arange(lengths.sum()) - np.repeat(first, lengths)
            at = np.repeat(begins[full], lengths) + own
            sums = np.add.reduceat(hashes[at] * self.powers[own & (self.table - 1)], first)
            out[full] = mix(sums + lengths.astype(U64))
        return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` words; a shorter text is one window, an empty one none."""
    if not hashes.size:
        return hashes
    width = min(width, hashes.size)
    n = hashes.size - width + 1
    total = np.zeros(n, dtype=U64)
    for k in range(width):
        total = total * U64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(total + U64(width))

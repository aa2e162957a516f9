"""Hashes of word shingles of whole batches of texts, computed from their bytes with numpy.

A word is a run of bytes other than ASCII white space, with A-Z in lower case.  Its hash is a polynomial
over random 64-bit values of its bytes, modulo 2^64, mixed; a shingle's hash combines those of its words in
order.  All steps run over the whole batch, so there is no work per word in Python.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
for _c in range(0x41, 0x5B):
    _BYTE[_c] = _BYTE[_c + 32]
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Shingle hashes of texts; keeps tables of powers as long as the longest piece so far."""

    PIECE = 1 << 18  # bytes hashed at once

    def __init__(self, size: int = 3):
        self.size = size
        self.up, self.down = _powers(_BASE, self.PIECE), _powers(_INVERSE, self.PIECE)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word of a byte array."""
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        out = np.empty(len(start), np.uint64)
        k = 0
        while k < len(start):
            a = int(start[k])
            e = int(np.searchsorted(end, a + self.PIECE, side="right"))
            if e <= k:  # one word longer than a piece
                e, need = k + 1, int(end[k]) - a
                up, down = _powers(_BASE, need), _powers(_INVERSE, 1)
            else:
                up, down = self.up, self.down
            b = int(end[e - 1])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a:b]] * up[: b - a], dtype=np.uint64)])
            out[k:e] = (total[end[k:e] - a] - total[start[k:e] - a]) * down[start[k:e] - a] + (end[k:e] - start[k:e]).astype(np.uint64) * _U(0xA0761D6478BD642F)
            k = e
        return start, mix(out)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; texts lie in `data` at `offsets`.

        A text of fewer words has the whole sequence as its only shingle; one without words has none."""
        base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
        offsets = offsets - base
        n, s = len(offsets) - 1, self.size
        # A separator in front of each text keeps words of different texts apart.
        lengths = np.diff(offsets)
        padded = np.full(len(data) + n, 32, np.uint8)
        padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lengths)] = data
        start, h = self.words(padded)
        bounds = np.searchsorted(start, np.concatenate([offsets[:-1] + np.arange(n), [len(padded)]]))
        grams = self._combine([h[i : max(i, len(h) - s + 1 + i)] for i in range(s)], s) if len(h) >= s else np.zeros(0, np.uint64)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= s:
                out.append(np.unique(grams[a : b - s + 1]))
            elif b > a:
                out.append(self._combine([h[i : i + 1] for i in range(a, b)], b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    @staticmethod
    def _combine(parts: list[np.ndarray], n: int) -> np.ndarray:
        total = np.full(len(parts[0]), n, np.uint64)
        for p in parts:
            total = mix(total * _U(0x9FB21C651E98DF25) + p)
        return total


def text_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at

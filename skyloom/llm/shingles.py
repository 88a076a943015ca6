"""Sets of hashed word shingles, computed for whole batches of texts with numpy.

Words are runs of bytes other than the six ASCII white-space bytes, after lowering A-Z; a shingle is a run of
``k`` words, hashed to 64 bits. A text with fewer words has one shingle, its whole sequence; a text without
words has none. Long texts are read in pieces of PIECE bytes; a word that goes on carries its sum to the next piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SLICE = 256
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of bytes by powers, start and stop of every word of a piece."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(PIECE + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return (total[stop] - total[start]) * down[start], start, stop


def _steps(raw: pa.Buffer | bytes) -> Iterator[np.ndarray]:
    """Word hashes of a text of any length, by pieces; of a word that goes on, its sum and length are kept."""
    sum_, length = 0, 0
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
        sums, start, stop = _runs(b)
        goes_on = length > 0 and not _SPACE[b[0]]
        if goes_on:
            first = sum_ + pow(int(_BASE), length, 1 << 64) * int(sums[0])
            sums[0] = first & ((1 << 64) - 1)
        elif length:
            sums = np.concatenate([np.array([sum_], np.uint64), sums])
        if len(stop) and stop[-1] == len(b):
            length = int(stop[-1] - start[-1]) + (length if goes_on and len(stop) == 1 else 0)
            sum_, sums = int(sums[-1]), sums[:-1]
        else:
            sum_, length = 0, 0
        yield mix(sums)
    if length:
        yield mix(np.array([sum_], np.uint64))


def _per_text(texts: list[pa.Buffer | bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text; texts of PIECE bytes at most go together."""

    def together(held: list) -> Iterator[np.ndarray]:
        sums, start, _ = _runs(np.frombuffer(b" ".join(held), np.uint8))
        yield from np.split(mix(sums), np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))[:-1])

    held: list = []
    size = 0
    for t in texts:
        if held and size + len(t) >= PIECE:
            yield from together(held)
            held, size = [], 0
        if len(t) < PIECE:
            held.append(t)
            size += len(t) + 1
        else:
            yield np.concatenate(list(_steps(t)))
    if held:
        yield from together(held)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column; null counts as empty."""
    slices = (column.slice(at, SLICE).cast(pa.binary()) for at in range(0, len(column), SLICE))
    for h in (h for texts in slices for h in _per_text([t.as_buffer() if t.is_valid else b"" for t in texts])):
        n, width = len(h), min(k, len(h))
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        s = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            s = (s ^ h[j : n - width + 1 + j]) * _C
            s ^= s >> np.uint64(31)
        yield np.unique(mix(s))

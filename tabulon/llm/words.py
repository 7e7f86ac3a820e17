"""Words of UTF-8 texts as 64-bit keys, found for a block of texts at once with numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lower-cased. Its key is a polynomial over random byte
values, mixed; equal words have equal keys, different words differ but for a chance of
about one in 2^64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RATIO = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    lowered = np.where((code >= 65) & (code <= 90), code + U(32), code)
    with np.errstate(over="ignore"):
        return mix((lowered + U(1)) * _RATIO) | U(1)


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_VALUE = np.where(SPACE, U(0), _byte_values())
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 20, n)
        tables = []
        for ratio in (_RATIO, _INVERSE):
            steps = np.full(size, ratio, dtype=np.uint64)
            steps[0] = U(1)
            tables.append(np.cumprod(steps))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def text_blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about `size` bytes; a longer text is a
    block of its own. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def word_keys(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of a block, and for each text the range of its words: text i has
    the words bounds[i] to bounds[i + 1]."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), bounds
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_VALUE[data] * up[: len(data)], at) * down[at]), bounds

"""Texts of an Arrow batch as one byte array, and its words, for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once: numpy's temporaries take a multiple of it. One longer text is a part of its own.
PART_BYTES = 2 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)
_letters = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, PART_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base, name in ((_BASE, "_powers"), (inverse, "_inverse")):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverse


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows of up to `limit` bytes of text."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(np.diff(text_bytes(batch.column(text_col))[1]).tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words are runs without ASCII white space; row i has words bounds[i] to bounds[i + 1]."""
    solid = ~SPACE[data]
    starts = solid.copy()
    ends = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of a running polynomial sum, shifted to the same origin."""
    powers, inverse = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_letters[data] * powers[: len(data)], out=running[1:])
    return mixed((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_ORDER = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each row's runs of `width` words, repeats included; a shorter row's whole sequence is one."""
    n = np.diff(bounds)
    per_row = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(per_row, out=out[1:])
    first = np.repeat(bounds[:-1] - out[:-1], per_row) + np.arange(out[-1])
    last = np.repeat(bounds[1:], per_row)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(out[-1], dtype=np.uint64)
    for k in range(width):
        total += np.where(first + k < last, padded[np.minimum(first + k, len(words))], np.uint64(0)) * _ORDER[k]
    return mixed(total + np.minimum(last - first, width).astype(np.uint64)), out

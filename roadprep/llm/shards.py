"""Numpy helpers that run inside Spark tasks: bounded slices of Arrow batches, word spans and 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in order, cut so that the text of each slice is at most `limit` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column).cast(pa.large_string())
        sizes = np.cumsum(pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def ascii_lower_table(drop: bytes = b"") -> bytes:
    """A table for bytes.translate that lower-cases A-Z and turns the bytes of `drop` into spaces."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for b in drop:
        table[b] = 32
    return bytes(table)


def joined(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, a space after each, translated by `table`; the start of each text and the end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer((b" ".join(texts) + b" ").translate(table), np.uint8), bounds


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes; `data` ends with a byte that is in no word."""
    inside = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span: differences of one running sum, shifted back to the span's start."""
    n = len(data) + 1
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _POWERS[i] = np.multiply.accumulate(powers)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _POWERS[0][: n - 1], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * _POWERS[1][starts])
    if n > 8 * SLICE_BYTES:
        _POWERS[:] = [p[: SLICE_BYTES + 1].copy() for p in _POWERS]
    return out

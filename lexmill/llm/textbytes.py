"""Vectorised text kernels on the UTF-8 bytes of an Arrow string column.

A column of texts is one byte buffer and its offsets; words, their hashes and their shingles come from numpy passes over
that buffer. White space is ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased, other characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE[SPACE] = 0
BYTE_CODE = BYTE_CODE[LOWER]
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes handled at once; temporary arrays take some forty times as much.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the n + 1 bounds of each text's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the bounds of each text's words."""
    starts, bounds = word_starts(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    body = data[starts[0] :]
    rel = starts - starts[0]
    lens = np.diff(np.append(rel, len(body)))
    place = np.arange(len(body)) - np.repeat(rel, lens)
    code = BYTE_CODE[body]
    powers = np.multiply.accumulate(np.full(int(lens.max()) + 1, STEP, np.uint64))
    return mix(np.add.reduceat(code * powers[place], rel)), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words has its whole sequence as one, one without words none."""
    n = len(words)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : n - width + 1 + k] * PLACE[k] if len(sums) else np.uint64(0)
    sums = mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            part = (words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(part ^ (STEP >> np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

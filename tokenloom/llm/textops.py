"""Byte-level word hashing shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes in numpy, many documents at a time, so a task
never builds a Python object per word.  A word's 64-bit hash is a polynomial
over its (optionally case-folded) bytes; hashes of equal words are equal in
every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
GROUP_BYTES = 1 << 20  # texts are hashed in groups of about this size

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_WINDOW = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


SPACE_TABLE = separator_table(WHITESPACE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _R, dtype=np.uint64)
        down = np.full(size, _R_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _block_words(block: np.ndarray, sep: np.ndarray, lower: bool):
    """(start offsets, hashes) of the words of one byte block."""
    inside = np.zeros(len(block) + 2, dtype=np.int8)
    inside[1:-1] = ~sep[block]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(block) + 1)
    total = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[block] * up[:len(block)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])


def _long_words(data: np.ndarray, sep: np.ndarray, lower: bool) -> np.ndarray:
    """Word hashes of one text longer than a group, block by block, cut at separators."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + GROUP_BYTES)
        while end < len(data) and not sep[data[end]]:  # a block ends at a separator
            ahead = sep[data[end:end + GROUP_BYTES]]
            end = end + int(np.argmax(ahead)) if ahead.any() else min(len(data), end + GROUP_BYTES)
        out.append(_block_words(data[at:end], sep, lower)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: list[bytes], sep: np.ndarray = SPACE_TABLE, lower: bool = True) \
        -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, word offsets, hashes) for groups of texts.

    The words of text ``first + i`` are ``hashes[offsets[i]:offsets[i + 1]]``.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < GROUP_BYTES):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and len(texts[at]) > GROUP_BYTES:
            h = _long_words(np.frombuffer(texts[at], dtype=np.uint8), sep, lower)
            yield at, np.array([0, len(h)]), h
        else:
            joined = np.frombuffer(b"\n".join(texts[at:end]), dtype=np.uint8)
            limits = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
            starts, h = _block_words(joined, sep, lower)
            yield at, np.searchsorted(starts, limits), h
        at = end


def window_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of every window of ``size`` consecutive words of each text."""
    counts = np.diff(offsets)
    keep = np.maximum(counts - size + 1, 0)
    out = np.concatenate(([0], np.cumsum(keep)))
    if not out[-1]:
        return out, np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        total += words[i:len(words) - size + 1 + i] * _WINDOW[i]
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], keep)
    return out, mix(total[at])


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a short sequence as one item; differs from the windows of any other length."""
    total = np.uint64(len(words) + 1)
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            total += w * _WINDOW[8 + i]
    return mix(np.array([total], dtype=np.uint64))[0]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]

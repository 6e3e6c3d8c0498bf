"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A column's texts lie in one byte buffer, one after the other.  Words, lines and
shingles are spans of that buffer, and any span's hash comes from one running
sum: ``H[i] = sum(v[b_k] * P**k for k < i)`` modulo 2**64, so the hash of
``[s, e)`` is ``(H[e] - H[s]) * P**-s``, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
WORD_AND_DIGIT = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: words ``[^\x20\x09-\x0D]+``
NOT_BLANK = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with at most ``most`` bytes of text, a row at least."""
    if not batch.num_rows:
        return
    _, at = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        seed = np.full(max(n, (1 << 20) + 64), base, np.uint64)
        seed[0] = 1
        have = np.multiply.accumulate(seed)
        if n <= 1 << 24:
            _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """The running sum that :func:`span_hash` needs."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(len(data), _P, "p"), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[starts, ends)``; lengths are mixed in."""
    inverse = _power(len(sums), _PINV, "inverse")
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that stay inside one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(mask), bool)
    change[0] = mask[0]
    np.not_equal(mask[1:], mask[:-1], out=change[1:])
    begin = change & mask
    at = offsets[(offsets > 0) & (offsets < len(mask))]
    begin[at] = mask[at]
    starts = np.flatnonzero(begin)
    stop = change & ~mask
    cut = np.zeros(len(mask) + 1, bool)
    cut[:-1] = stop
    cut[at] |= mask[at - 1]
    cut[len(mask)] = mask[-1]
    return starts, np.flatnonzero(cut)


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row each byte position belongs to (empty rows own none)."""
    return np.searchsorted(offsets, positions, "right") - 1


def binary_array(chunks_at: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """A binary array over one buffer with int32 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(chunks_at) - 1, [None, pa.py_buffer(np.ascontiguousarray(chunks_at, np.int32)), pa.py_buffer(data)])

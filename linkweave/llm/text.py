"""Vectorised words of Arrow string columns, for operators that work on batches inside tasks.

A word is a run of bytes other than space and 0x09-0x0D. Those separators are ASCII, so splitting the UTF-8 bytes
is the same as splitting the code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits: for words without their punctuation.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian 64-bit load.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 64
#: Bytes of text that a task works on at once: its arrays of words and hashes take some thirty times as much.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours in order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x2545F4914F6CDD1D)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column with n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, content = column.buffers()
    if places is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most_bytes`` of text, or one row."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of the documents of a batch: ``start`` and ``length`` in bytes, ``first`` word of each document."""

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~separator[self.data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = self.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            begins[cuts] = inside[cuts]
            ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``most`` (up to 8) bytes."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.length if most is None else np.minimum(self.length, most)
        out = mix((loads[self.start] & KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rest = np.flatnonzero((length > 8) & (length <= LONG_WORD))
        done = 8
        while len(rest):
            left = np.minimum(length[rest] - done, 8)
            out[rest] = join_hashes(out[rest], loads[self.start[rest] + done] & KEEP[left])
            done += 8
            rest = rest[length[rest] > done]
        for i in np.flatnonzero(length > LONG_WORD):
            at = self.start[i]
            out[i] = xxhash.xxh64_intdigest(self.data[at : at + length[i]].tobytes())
        return out

    def ends(self, most: int, last: bool) -> np.ndarray:
        """The first or the last ``most`` (up to 8) bytes of each word as a little-endian integer."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        loads = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = np.minimum(self.length, most)
        return loads[self.start + (self.length - length if last else 0)] & KEEP[length]

    def grams(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each place on; the last width - 1 entries are left out."""
        if len(hashes) < width:
            return np.zeros(0, np.uint64)
        out, have, power = None, 0, hashes
        size = 1
        left = width
        while left:
            if left & 1:
                out = power if out is None else join_hashes(out[: len(power) - have], power[have:])
                have += size
            left >>= 1
            if left:
                power = join_hashes(power[:-size], power[size:])
                size *= 2
        return out[: len(hashes) - width + 1]

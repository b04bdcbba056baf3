"""A count-min sketch that tells which 64-bit keys may occur twice, and which may be hot.

Each task adds its keys to sparse partial sketches of two rows, cells with their counts; those are merged by slices of
cells. Two bitmaps are kept of the merged counts: which cells reached two, and which groups of eight cells have one that
reached ``HOT``. Their width follows the expected number of keys up to ``MOST_CELLS`` a row (72 MiB in all), which bounds
what is broadcast. Counts are overestimated, never under: a fuller sketch calls more keys repeated or hot, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import ARROW_BYTES, setting
from .text import mix

SEEDS = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))
SLICE = 1 << 18
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 28
#: A key that may occur so often is hot: what is grouped by key needs a finer key for it.
HOT = 1024
#: Keys that a task holds before it hands a partial sketch on.
HELD_KEYS = 1 << 20
PARTIAL, MERGED = "slice long, cells binary, counts binary", "slice long, bits binary, hot binary"


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys ^ SEEDS[row]) & np.uint64(width - 1)).astype(np.int64)


def _bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Sketch:
    width: int
    bits: np.ndarray  # a bit for each cell of both rows
    tops: np.ndarray  # a bit for each eight cells of both rows

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that occur once."""
        out = np.ones(len(keys), bool)
        for row in range(len(SEEDS)):
            out &= _bit(self.bits, cells(keys, row, self.width) + row * self.width)
        return out

    def hot(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that occur less than HOT times."""
        out = np.ones(len(keys), bool)
        for row in range(len(SEEDS)):
            out &= _bit(self.tops, (cells(keys, row, self.width) + row * self.width) >> 3)
        return out


def partial_sketches(width: int, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    """Rows of PARTIAL: cells of a slice as 32-bit integers, and their counts as 16-bit ones, up to the largest of those."""

    def flush(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        for row in range(len(SEEDS)):
            cell, count = np.unique(cells(key, row, width), return_counts=True)
            cell += row * width
            cut = np.flatnonzero(np.diff(cell // SLICE, prepend=-1))
            parts = np.split((cell % SLICE).astype("<u4"), cut[1:]), np.split(np.minimum(count, 65535).astype("<u2"), cut[1:])
            yield pa.RecordBatch.from_arrays([pa.array(cell[cut] // SLICE, pa.int64()), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in parts)], ["slice", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                held.append(keys)
                size += len(keys)
                if size >= HELD_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def merge_sketches(hot: int):
    """Partial sketches, ordered by slice -> MERGED."""

    def merged(at: int, count: np.ndarray) -> pa.RecordBatch:
        packed = (np.packbits(x, bitorder="little").tobytes() for x in (count >= 2, count.reshape(-1, 8).max(axis=1) >= hot))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["slice", "bits", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = None, np.zeros(SLICE, np.uint32)
        for batch in batches:
            for at, cell, more in zip(batch.column("slice").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                if at != current:
                    if current is not None:
                        yield merged(current, count)
                    current = at
                    count[:] = 0
                cell = np.frombuffer(cell.as_buffer(), "<u4")  # a partial sketch has a cell once
                count[cell] = np.minimum(count[cell] + np.frombuffer(more.as_buffer(), "<u2"), max(2, hot))
        if current is not None:
            yield merged(current, count)

    return run


def sketch(rows: DataFrame, expected_keys: int, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Sketch:
    """The merged sketch of the keys of all rows."""
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * int(expected_keys)).bit_length()))
    slices = rows.mapInArrow(partial_sketches(width, keys_of), PARTIAL).repartition("slice").sortWithinPartitions("slice").mapInArrow(merge_sketches(HOT), MERGED)
    out = Sketch(width, np.zeros(len(SEEDS) * width // 8, np.uint8), np.zeros(len(SEEDS) * width // 64, np.uint8))
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b"):
        for row in slices.toLocalIterator():
            for part, target, cells_a_byte in ((row.bits, out.bits, 8), (row.hot, out.tops, 64)):
                at = row.slice * SLICE // cells_a_byte
                target[at : at + SLICE // cells_a_byte] = np.frombuffer(part, np.uint8)
    return out

"""Count-min sketches of 64-bit hashes: one for each part of the input, merged, kept as one bit a
counter, "two or more" (or "one or more").

Estimates are never below the true count, so that what a sketch calls single is single. Two rows
of counters; a merged row holds one bit per counter. It is the only data broadcast, and its width
follows the input's size up to ``MOST_BITS`` (32 MB a row); beyond that estimates grow coarser, and
what follows does more work with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._kernels import mix, text_slices
from .common import partitions

DEPTH, LEAST_BITS, MOST_BITS, BLOCK_BITS = 2, 16, 28, 16
#: Rows that a part's sketch has for each row of counters, at most, whatever its width.
SLICES = 32
#: Hashes that a task holds before it hands its sketch on.
FLUSH = 1_000_000


def sketch_bits(expected: float) -> int:
    """Width of a row, as a power of two: four counters and more for each expected hash."""
    return int(np.clip(int(np.ceil(np.log2(max(expected, 1.0) * 4))), LEAST_BITS, MOST_BITS))


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch."""
    return (mix(hashes + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64)


def _slices(hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A part's sketch, cut into at most ``SLICES`` slices a row: counters that hold one, and those that hold more.

    A slice lists, for each 2**16 counters, how many there are, and then their places.
    """
    wide = _blocks(bits)
    for row in range(DEPTH):
        at, count = np.unique(counters(hashes, row, bits), return_counts=True)
        edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, wide << BLOCK_BITS))
        rows = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                lists = [row, k]
                for chosen in (at[a:b][count[a:b] == 1], at[a:b][count[a:b] > 1]):
                    lists += [np.bincount((chosen >> BLOCK_BITS) - k * wide, minlength=wide).astype(np.uint32).tobytes(), (chosen & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes()]
                rows.append(lists)
        if rows:
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["row", "slice", "ones_n", "ones", "more_n", "more"])


def _blocks(bits: int) -> int:
    """Blocks of 2**BLOCK_BITS counters in a slice."""
    return max((1 << (bits - BLOCK_BITS)) // SLICES, 1)


def _places(number: bytes, inner: bytes) -> np.ndarray:
    n = np.frombuffer(number, np.uint32)
    return np.repeat(np.arange(len(n)), n) << BLOCK_BITS | np.frombuffer(inner, np.uint16)


def of_texts(hashes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """Hashes of a batch whose first column is text, from those of a slice's bytes and offsets."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, body, offsets in text_slices(batch.column(0)):
            yield hashes(body, offsets)

    return run


def merged_sketch(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int = 2) -> np.ndarray:
    """The merged sketch of what ``hashes`` finds in ``rows``: DEPTH rows of packed bits, set where a
    counter reached ``least`` (1 or 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield from _slices(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield from _slices(np.concatenate(held), bits)

    wide = _blocks(bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(wide << BLOCK_BITS, np.uint8)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], names=["row", "slice", "twice"])

        for batch in batches:
            for row, part, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row, part):
                    if now is not None:
                        yield packed()
                    now = (row, part)
                    counts[:] = 0
                one = _places(*lists[:2])
                counts[one] = np.minimum(counts[one] + 1, 2)
                counts[_places(*lists[2:])] = 2
        if now is not None:
            yield packed()

    parts = rows.mapInArrow(count, "row int, slice int, ones_n binary, ones binary, more_n binary, more binary")
    merged = parts.repartition(partitions(rows.sparkSession), "row", "slice").sortWithinPartitions("row", "slice").mapInArrow(merge, "row int, slice int, twice binary")
    width = wide << (BLOCK_BITS - 3)
    out = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    for row in merged.collect():  # at most DEPTH * SLICES rows, together at most DEPTH << MOST_BITS bits: 64 MiB
        out[row["row"], row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["twice"], np.uint8)
    return out


def estimated(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the sketch estimates to be there as often as its bits say."""
    likely = np.ones(len(hashes), dtype=bool)
    for row in range(DEPTH):
        at = counters(hashes, row, bits)
        likely &= (table[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return likely

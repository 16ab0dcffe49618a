"""Counts over a fixed number of cells, added up over all tasks.

Each task holds one array of counts and sends it in compressed chunks; chunks of one
number meet in one partition and are added one by one. Memory and what reaches the
driver follow the number of cells, never the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

CHUNK_CELLS = 1 << 16
SCHEMA = "chunk long, cells binary"


def _batch(chunk: int, raw: bytes) -> pa.RecordBatch:
    packed = zstandard.ZstdCompressor(level=1).compress(raw)
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed])], names=["chunk", "cells"])


def send_cells(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's counts (unsigned 32-bit) that are not all zero."""
    for at in range(0, len(counts), CHUNK_CELLS):
        part = counts[at : at + CHUNK_CELLS]
        if part.any():
            yield _batch(at // CHUNK_CELLS, part.tobytes())


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=16 * CHUNK_CELLS)


def add_cells(sent: DataFrame, cells: int, dtype, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """All ``cells`` totals, each chunk of them put through ``shape`` where it is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, np.uint64)
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(_unpack(packed.as_py()), np.uint32)
                if chunk != at:
                    if at is not None:
                        yield _batch(at, shape(total).astype(dtype).tobytes())
                    at, total = chunk, np.zeros(len(part), np.uint64)
                total += part
        if at is not None:
            yield _batch(at, shape(total).astype(dtype).tobytes())

    out = np.zeros(cells, dtype)
    met = sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, SCHEMA)
    for row in met.toLocalIterator():
        part = np.frombuffer(_unpack(bytes(row["cells"])), dtype)
        out[row["chunk"] * CHUNK_CELLS : row["chunk"] * CHUNK_CELLS + len(part)] = part
    return out

"""Count-min sketch of anchors, built per partition and merged by adding.

A partition's sketch is sparse: for each slice of a row of counters the sorted
cells it touched, a cell twice where it counted two or more.  Adding sparse
sketches is concatenating them, and a merged slice keeps one bit per cell: has
it counted two or more?  The estimate of an anchor is the least over the rows,
so it never falls below the true count and no repeated anchor is lost.

The bits are broadcast.  Their size is bounded by ``MAX_BITS`` per row (128 MB)
whatever the corpus holds; beyond that the sketch only overestimates more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import mix

ROWS = 2
SLICE = 1 << 22
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
_SALT = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93))
#: Anchors gathered before a partition's sketch is written out.
FLUSH = 1 << 21


def width_for(n_bytes: int, bytes_per_anchor: int) -> int:
    """Cells of a row: about four for each anchor, a power of two."""
    want = max(1, 4 * n_bytes // bytes_per_anchor)
    return min(MAX_BITS, max(MIN_BITS, 1 << (want - 1).bit_length()))


def cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(anchor ^ _SALT[row]) >> np.uint64(65 - width.bit_length())).astype(np.int64)


def _messages(found: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    anchor = np.concatenate(found)
    slices, blobs = [], []
    for row in range(ROWS):
        cell = np.sort(cells(anchor, row, width))
        cell = cell[np.r_[True, True, cell[2:] != cell[:-2]]] if len(cell) > 2 else cell
        size = min(SLICE, width)
        cut = np.searchsorted(cell, np.arange(0, width + 1, size))
        for k in np.flatnonzero(np.diff(cut)):
            slices.append(row << 24 | int(k))
            blobs.append((cell[cut[k] : cut[k + 1]] - k * size).astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])


def merged(docs: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int) -> dict[int, bytes]:
    """Bits by slice.  ``extract`` yields the 64-bit anchors of a batch, each once per document."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for anchor in extract(batch):
                found.append(anchor)
                n += len(anchor)
                if n >= FLUSH:
                    yield from _messages(found, width)
                    found, n = [], 0
        if n:
            yield from _messages(found, width)

    size = min(SLICE, width)

    def add(table: pa.Table) -> pa.Table:
        count = np.zeros(size, np.uint8)
        for blob in table["cells"]:
            cell = np.frombuffer(blob.as_buffer(), "<u4")
            twice = cell[1:][cell[1:] == cell[:-1]]
            count[twice] = 2
            once = count[cell]
            count[cell] = np.minimum(once + 1, 2)
            count[twice] = 2
        bits = np.packbits(count >= 2, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    rows = docs.mapInArrow(partition, "slice int, cells binary").groupBy("slice").applyInArrow(add, "slice int, bits binary")
    return {r["slice"]: bytes(r["bits"]) for r in rows.collect()}


class Repeated:
    """Answers for many anchors at once whether they are estimated to repeat."""

    def __init__(self, bits: dict[int, bytes], width: int):
        size = min(SLICE, width) // 8
        self.width = width
        self.rows = []
        for row in range(ROWS):
            flat = np.zeros(width // 8, np.uint8)
            for key, data in bits.items():
                if key >> 24 == row:
                    k = key & 0xFFFFFF
                    flat[k * size : (k + 1) * size] = np.frombuffer(data, np.uint8)
            self.rows.append(flat)

    def __call__(self, anchor: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchor), bool)
        for row, flat in enumerate(self.rows):
            cell = cells(anchor, row, self.width)
            out &= (flat[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0

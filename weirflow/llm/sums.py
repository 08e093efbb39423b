"""Sums of arrays over all rows of a DataFrame, added up by blocks in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of an array in a row of sums.
BLOCK = 4_096


def array_sums(rows: DataFrame, contribution: Callable[[Iterator[pa.RecordBatch]], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum over all tasks of ``rows`` of the (height, width) array that ``contribution`` makes of a task's batches.

    The result reaches the driver, so its size must be bounded. Tasks send blocks that aren't all zero, in single precision.
    """
    blocks = -(-width // BLOCK)

    def shown(numbers: np.ndarray, arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(numbers), 64):
            some = [a.astype("<f4").tobytes() for a in arrays[at : at + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at : at + 64], pa.int32()), pa.array(some, pa.binary())], ["block", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = contribution(batches)
        parts = np.zeros((blocks, height, BLOCK))
        for row in range(height):
            padded = np.zeros(blocks * BLOCK)
            padded[:width] = got[row]
            parts[:, row] = padded.reshape(blocks, BLOCK)
        full = np.nonzero(parts.any((1, 2)))[0]
        yield from shown(full, parts[full])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                held.setdefault(block, np.zeros((height, BLOCK)))
                held[block] += np.frombuffer(sums, "<f4").reshape(height, BLOCK)
        if held:
            yield from shown(np.array(list(held)), np.stack(list(held.values())))

    kind = "block int, sums binary"
    out = np.zeros((height, blocks * BLOCK))
    for r in rows.mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect():  # a row a block
        out[:, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, "<f4").reshape(height, BLOCK)
    return out[:, :width]

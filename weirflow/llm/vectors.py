"""Embeddings as exact integer vectors, and exact sums of them over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers up to this size are exact as doubles.
EXACT = float(1 << 53)
HALF = 26


def integers(vectors: DataFrame, scale: int, shift: int = 0) -> DataFrame:
    """``vec_id`` and ``x``, the integers floor(scale * c) + shift, of the rows whose vector is not empty and finite.

    A row with a null, a non-finite entry or one whose integer is beyond 2^53 is left out.
    """
    grown = F.transform("embedding", lambda c: c.cast("double") * scale)
    fine = F.forall(grown, lambda c: F.coalesce(F.abs(c) < EXACT, F.lit(False)))  # NaN counts as larger than any number
    rows = vectors.where(F.size("embedding") > 0).where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(grown, lambda c: F.floor(c) + F.lit(shift)).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def group_sums(rows: DataFrame, group: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By (length of the vectors, group): the number of rows and the exact sum of each of their components.

    ``group`` gives each row of a matrix a small number. A task sends one row for each
    of its groups and components, so what meets in the shuffle doesn't depend on how
    many rows a group has; groups times components reach the driver. Sums are kept in two halves
    of 26 bits and more, so none overflows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                x = matrix(batch.column("x").filter(pa.array(lengths == d)))
                names = group(x)
                for g in np.unique(names).tolist():
                    own = x[names == g]
                    sums = held.setdefault((d, g), np.zeros((3, d), np.int64))
                    sums += [np.full(d, len(own)), (own >> HALF).sum(0), (own & ((1 << HALF) - 1)).sum(0)]
        for (d, g), (n, high, low) in held.items():
            each = lambda v: pa.array(np.full(d, v, np.int64))
            yield pa.RecordBatch.from_arrays([each(d), each(g), pa.array(np.arange(d)), pa.array(n), pa.array(high), pa.array(low)], ["d", "g", "at", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "d long, g long, at long, n long, high long, low long")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "g", "at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("d", "g", "at").collect():
        out.setdefault((r.d, r.g), (r.n, []))[1].append((r.high << HALF) + r.low)
    return out

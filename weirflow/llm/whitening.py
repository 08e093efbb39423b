"""Whitening of embeddings by the eigenvectors of their exactly centred covariance.

Every component ``c`` becomes the integer ``x = floor(SCALE * c) + SHIFT``. Sums of ``x``
are exact, so rows are centred without cancellation: with ``S = q * n + r`` the centred
value is ``(x - q) - r / n``. Spark's ``RowMatrix`` adds up the Gramian of the centred rows over all tasks;
its n-th part is decomposed on the driver (dimension squared, whatever the number of rows), and
the projection is sent to the tasks. The same matrix of the whitened rows, centred
again, tells how far they are from white.

Edge cases: rows whose vector is null, empty, or holds a null, a non-finite entry or one
whose integer is beyond 2^53 take no part; vectors of each length are a fit of their
own; repeated rows and null ids count as rows; a component without variance (an
eigenvalue that is rounding noise) has a null ``whitened`` and no share in
``identity_error``, which is null if no component is left, as ``explained`` is without any variance;
a ``deviation`` beyond a long is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.storage import written
from weirflow.llm.vectors import group_sums, integers, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
MOST = (1 << 63) - 1


def numbers(values: list) -> Column:
    return F.array(*map(F.lit, values))


def gramian(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """The Gramian of ``v``, arrays of ``d`` doubles, of the ``n`` rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray()


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``RESULT`` for each usable row of ``vectors`` (vec_id, embedding) and each of its first components."""
    rows = written(integers(vectors, scale, shift), "whitening-rows")
    fits = group_sums(rows, lambda x: np.zeros(len(x), np.int64))
    parts = [of_length(rows.where(F.size("x") == d), n, sums, components) for (d, _), (n, sums) in fits.items()]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], RESULT)


def of_length(rows: DataFrame, n: int, sums: list[int], components: int) -> DataFrame:
    d, means, rest = len(sums), [s // n for s in sums], [s % n for s in sums]
    away = F.zip_with("x", numbers(means), lambda x, q: (x - q).cast("double"))
    centred = F.zip_with(away, numbers([r / n for r in rest]), lambda x, r: x - r)
    covariance = gramian(rows.select(centred.alias("v")), n, d) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    k, live = len(values), int((values > trace * d * np.finfo(float).eps).sum())
    scaled = axes[:, :live] / np.sqrt(values[:live])
    sent = rows.sparkSession.sparkContext.broadcast((np.array(means), np.array(rest), scaled))  # dimension times components

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, rest, scaled = sent.value
        for batch in batches:
            if batch.num_rows:
                far = matrix(batch.column("x")) - means
                if n * (np.abs(far).max() + 1.0) > 2.0**30 / np.sqrt(d):  # the squares may not fit
                    exact = ((far.astype(object) * n - rest) ** 2).sum(1)
                    deviation = pa.array([int(v) if v <= MOST else None for v in exact], pa.int64())
                else:
                    deviation = pa.array(((far * n - rest) ** 2).sum(1))
                white = (far - rest / n) @ scaled
                lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * live, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "v"])

    done = written(rows.mapInArrow(project, "vec_id long, deviation long, v array<double>"), "whitening-done")
    error = None
    if live:
        middle = done.agg(*(F.avg(F.col("v")[i]) for i in range(live))).first()
        off = F.zip_with("v", numbers(list(middle)), lambda v, m: v - m)
        error = float(np.abs(gramian(done.select(off.alias("v")), n, live) / n - np.eye(live)).max())
    padded = F.concat("v", F.array_repeat(F.lit(None).cast("double"), k - live)) if live < k else F.col("v")
    share = numbers([float(max(v, 0)) / trace for v in values]) if trace > 0 else F.lit(None).cast("array<double>")
    out = done.select("vec_id", "deviation", F.posexplode(padded).alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

"""Exact integer clustering around centroids, by partial-distance search.

Every component ``x`` becomes the integer ``floor(SCALE * x)``. A vector's squared distance to a
centroid is added up over the dimensions with the highest variance first. The centroid that is nearest over
those has its whole distance taken as the first best; any other is
abandoned as soon as its partial distance is strictly above it, and the survivors
finish all dimensions, so ties are seen and go to the smaller number.

A round reads the written vectors once. Tasks send counts and exact sums by centroid,
never rows, so a centroid that holds most vectors is no bottleneck; what reaches
the driver is one row for each centroid and dimension.

Edge cases: vectors that are null, hold a null or non-finite component or have other
than ``DIMENSIONS`` of them take no part, nor do those with an integer beyond
2^53; fewer vectors than centroids make fewer centroids; rows that share an id start
as centroids in the order of their components, and rows without an id come last; repeated
rows are vectors of their own; an empty centroid stays where it is; distances and inertias
beyond a long are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.storage import written
from weirflow.llm.vectors import group_sums, integers, matrix

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Dimensions after which partial distances are compared, and vectors that are searched at once.
STEPS, BLOCK = (8, 16, 32), 2_048
#: Components up to this size have squared distances that fit a long.
SMALL = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the number of its nearest row of ``centroids`` and its squared distance; ``order`` of dimensions."""
    if max(abs(int(v)) for a in (x, centroids) if a.size for v in (a.min(), a.max())) > SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    names, distances = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    c = centroids[:, order]
    stops = [s for s in STEPS if s < len(order)] + [len(order)]
    for at in range(0, len(x), BLOCK):
        v = x[at : at + BLOCK][:, order]
        part = ((v[:, None, : stops[0]] - c[None, :, : stops[0]]) ** 2).sum(2)
        best = ((v - c[part.argmin(1)]) ** 2).sum(1)
        row, name = np.nonzero(part <= best[:, None])
        part = part[row, name]
        for start, stop in zip(stops, stops[1:]):
            part = part + ((v[row, start:stop] - c[name, start:stop]) ** 2).sum(1)
            alive = part <= best[row]
            row, name, part = row[alive], name[alive], part[alive]
        first = np.lexsort((name, part, row))
        first = first[np.r_[True, row[first][1:] != row[first][:-1]]]  # every row has a survivor, its first best
        names[at : at + BLOCK], distances[at : at + BLOCK] = name[first], part[first]
    return names, distances


def start(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(count)
    return np.array([r.x for r in first.collect()], np.int64)  # ``count`` rows


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid that has vectors at their componentwise floor of the mean."""
    out = centroids.copy()
    for (_, name), (n, total) in sums.items():
        out[name] = [t // n for t in total]
    return out


def as_long(total: Column) -> Column:
    return total.try_cast("long")


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """``RESULT`` for each usable row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    kept = integers(vectors.where(F.size("embedding") == dimensions), scale)
    rows = written(kept, "centroids-rows")
    centroids = start(rows, count, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    spread = rows.agg(*(F.var_pop(F.col("x")[i]) for i in range(dimensions))).first()
    order = np.argsort([-v for v in spread], kind="stable")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((centroids, order))  # ``count`` vectors
        centroids = moved(centroids, group_sums(rows, lambda x, sent=sent: nearest(x, *sent.value)[0]))
    sent = spark.sparkContext.broadcast((centroids, order))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, distances = nearest(matrix(batch.column("x")), *sent.value)
                distances = pa.array([str(v) for v in distances.tolist()]).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names.astype(np.int32)), distances], ["vec_id", "cluster", "distance"])

    done = written(rows.mapInArrow(assign, "vec_id long, cluster int, distance decimal(38,0)"), "centroids-done")
    held = {r.cluster: r.total for r in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # ``count`` rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    named = F.array(*(F.lit(digest(c)) for c in centroids.tolist()))
    totals = F.array(*(F.lit(held.get(i)).cast("decimal(38,0)") for i in range(len(centroids))))
    return done.select(
        "vec_id",
        "cluster",
        as_long(F.col("distance")).alias("distance"),
        as_long(totals[F.col("cluster")]).alias("cluster_inertia"),
        as_long(F.lit(sum(held.values())).cast("decimal(38,0)")).alias("inertia"),
        named[F.col("cluster")].alias("centroid_sha256"),
    )

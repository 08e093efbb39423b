"""Approximate nearest neighbours by largest inner product, from a random-projection forest.

The trees are grown from at most ``SAMPLE`` vectors, a tree a task, so their size is
bounded, and sent to the tasks. Every vector is placed in one small leaf of each tree; each
query takes the likeliest leaves of all trees until they hold
``BUDGET * N ** POWER`` entries of ``N`` (``FLOOR * TOP`` distinct ones at least, so few vectors
are searched whole). The share of the vectors that are scored so falls as the table grows;
for structure-free vectors, the hardest case, this power keeps the recall. Vectors and
queries meet by cells, subtrees of about ``CELL`` entries, in blocks of bounded size, where
the candidates in the query's leaves are ranked by exact inner products in double
precision; the best of all blocks are merged.

A query's ``TOP + 1``-st best score among scouts, sample vectors, bounds its result from
below, so candidates under it aren't passed on. Scouts are a fixed share of all vectors (``SHARE``, ``SCOUTS`` at
least, the sample at most), so what is passed on for a query doesn't grow with the table up to five times the sample. A query
takes a leaf of each of its best scouts too, so what sets its bound is found.

Inner products are searched as angles: vectors get one more coordinate that gives
all of them the length of the longest, and queries get a zero there.

Equal vectors are one entry that carries its ``TOP + 1`` smallest rows. That loses
nothing: a further copy has the same score and a larger id than all of those.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part; vectors of another dimension have no inner product with
a query, so each dimension is a table of its own; rows that share an id are rows of
their own, as queries and as candidates; with fewer candidates than ``TOP`` all of them
are returned; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.forest import TREES, Forest, grow, joined
from weirflow.llm.storage import located, row_key, small_or_plain, written

SAMPLE, SCOUTS, SHARE, TOP, CELL, BLOCK, FLOOR = 60_000, 2_048, 5, 20, 4_096, 8_192, 10
BUDGET, POWER = 4.0, 0.75
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, the row's locator, and ``embedding`` of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = located(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), *row_key(), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length as rows."""
    return one_array(column).flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def exact(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of one vector, or of a column of ``q`` each, with rows, summed in the order of the components."""
    total = np.zeros(len(vectors))
    for x, y in zip(q, vectors.T):
        total += x * y
    return total


def forest_of(spark: SparkSession, sample: np.ndarray, cell: int) -> Forest:
    """The trees of the sample, each grown by a task of its own."""
    sent = spark.sparkContext.broadcast(sample.astype(np.float32))  # SAMPLE vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                tree = grow(sent.value.astype(np.float64), number, cell)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pickle.dumps(tree)], pa.binary())], ["id", "tree"])

    rows = spark.range(0, TREES, 1, TREES).mapInArrow(run, "id long, tree binary").collect()
    return joined([pickle.loads(r.tree) for r in sorted(rows, key=lambda r: r.id)], sample)


def neighbours(vectors: DataFrame, asked: Column | str, top: int = TOP, budget: float = BUDGET, sample: int = SAMPLE) -> DataFrame:
    """For rows that ``asked`` (a condition, or SQL, on vec_id) picks: query_id, rank, vec_id, score."""
    rows = written(usable(vectors), "ann-vectors")
    dims = sorted(r.d for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    if not dims:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, [of_dimension(rows.where(F.size("embedding") == d), asked, top, budget, sample) for d in dims])


def of_dimension(rows: DataFrame, asked: Column | str, top: int, budget: float, sample: int) -> DataFrame:
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.unhex(F.md5(F.col("embedding").cast("string"))))
    member = F.struct("vec_id", "file_key", "row_key")
    ranked = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(member))).where(F.col("copy") <= top + 1)
    entries = ranked.groupBy("key").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list(member)).alias("ids"))
    askers = keyed.where(asked).select("vec_id", "file_key", "row_key", "key")
    entries = written(entries.join(askers.select("key").distinct().withColumn("asks", F.lit(True)), "key", "left"), "ann-entries")
    askers = written(askers, "ann-askers")

    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))
    n, longest = entries.agg(F.count("*"), F.max(norm)).first()
    taken = entries.orderBy(F.xxhash64("key"), "key").select("embedding").limit(sample).toArrow().column("embedding").combine_chunks()
    picked = taken.flatten().to_numpy().astype(np.float64).reshape(len(taken), -1)

    def lengthened(x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))
        return np.hstack([x, more[:, None]]) / longest

    forest = forest_of(spark, lengthened(picked), max(1, CELL * len(picked) // n))
    sent = spark.sparkContext.broadcast(forest)
    first = picked[: max(SCOUTS, n // SHARE)]
    scouts = spark.sparkContext.broadcast((first, forest.leaves(lengthened(first))[:, 0]))  # with a leaf of each

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaves = sent.value.leaves(lengthened(matrix(b["embedding"])))
                yield b.assign(leaves=list(leaves.astype(np.int32)), cells=list(sent.value.cells[leaves].astype(np.int32)))

    kind = dict(entries.dtypes)["embedding"]
    placed = entries.select("key", "embedding", "ids").mapInPandas(place, f"key binary, embedding {kind}, ids array<struct<vec_id: bigint, file_key: bigint, row_key: bigint>>, leaves array<int>, cells array<int>")
    placed = written(placed, "ann-placed")
    sizes = [0] * len(forest.cells)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # a row a leaf of the forest
        sizes[r.leaf] = r["count"]
    most = max(budget * n**POWER, float(FLOOR * top * TREES))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                part = b.iloc[at : at + 100]
                x = matrix(part["embedding"])
                held, homes = scouts.value
                known = x @ held.T
                best = np.argpartition(known, -top - 1, axis=1)[:, -top - 1 :] if known.shape[1] > top else np.zeros((len(x), 0), np.int64)
                least = np.take_along_axis(known, best, 1).min(1, initial=np.inf) if best.shape[1] else np.full(len(x), -np.inf)
                out = []
                for leaves, own in zip(sent.value.search(lengthened(x, True), most, sizes), best):
                    found = np.union1d(leaves, homes[own]).astype(np.int64)
                    cells = sent.value.cells[found]
                    order = np.argsort(cells, kind="stable")
                    names, first = np.unique(cells[order], return_index=True)
                    out.append(list(zip(names.tolist(), np.split(found[order], first[1:]))))
                part = part.assign(least=least - 1e-9 * np.maximum(1, np.abs(least)), met=out).explode("met")
                yield part.assign(cell=[int(c) for c, _ in part["met"]], leaves=[v for _, v in part["met"]]).drop(columns="met")

    wanted = entries.where("asks").select("key", "embedding").mapInPandas(ask, f"key binary, embedding {kind}, least double, cell int, leaves array<int>")
    wanted = written(wanted, "ann-wanted")
    split = placed.select("key", "embedding", "ids", F.explode(F.arrays_zip("cells", "leaves")).alias("p")).select("key", "embedding", "ids", F.col("p.cells").alias("cell"), F.col("p.leaves").alias("leaf"))
    parts = lambda name: F.ceil(F.count("*") / BLOCK).cast("int").alias(name)
    blocks = split.groupBy("cell").agg(parts("v")).join(wanted.groupBy("cell").agg(parts("q")), "cell")
    blocks = small_or_plain(written(blocks, "ann-blocks"))  # a row a cell of the forest
    deal = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = split.join(blocks, "cell").withColumn("bv", deal("v")).withColumn("bq", every("q")).drop("v", "q")
    right = wanted.join(blocks, "cell").withColumn("bq", deal("q")).withColumn("bv", every("v")).drop("v", "q")
    block = ["cell", "bv", "bq"]
    columns = ["key", "vec_id", "file_key", "row_key", "score"]

    out = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("file_key", pa.int64()), ("row_key", pa.int64()), ("score", pa.float64())])

    def meet(v: pa.Table, q: pa.Table) -> pa.Table:
        if not len(v) or not len(q):
            return out.empty_table()
        v, q = v.sort_by("leaf").combine_chunks(), q.combine_chunks()
        x, own = rows_of(v.column("embedding")), rows_of(q.column("embedding"))
        names, first = np.unique(v.column("leaf").to_numpy(), return_index=True)
        bounds = np.append(first, len(v))
        wanted, leaves = one_array(q.column("leaves")), q.column("least").to_numpy()
        ends = wanted.offsets.to_numpy()
        leaf = wanted.values.to_numpy()
        at = np.minimum(np.searchsorted(names, leaf), len(names) - 1)
        there = names[at] == leaf
        low, size = bounds[at], np.where(there, bounds[at + 1] - bounds[at], 0)
        asked, met = [], []
        for i, least in enumerate(leaves.tolist()):
            spans = slice(ends[i], ends[i + 1])
            n = size[spans]
            total = int(n.sum())
            if not total:
                continue
            rows = np.arange(total) + np.repeat(low[spans] - (np.cumsum(n) - n), n)
            rough = x[rows] @ own[i]
            if total > top + 1:
                least = max(least, np.partition(rough, -top - 1)[-top - 1] - 1e-9 * max(1.0, np.abs(rough).max()))
            rows = rows[rough >= least]
            asked.append(np.full(len(rows), i))
            met.append(rows)
        if not met:
            return out.empty_table()
        asked, met = np.concatenate(asked), np.concatenate(met)
        score = exact(own.T[:, asked], x[met])
        ids = one_array(v.column("ids"))
        place, rank = ids.offsets.to_numpy(), ids.values.flatten()
        copies = place[met + 1] - place[met]
        each = np.arange(copies.sum()) + np.repeat(place[met] - (np.cumsum(copies) - copies), copies)
        asked, score = np.repeat(asked, copies), np.repeat(score, copies)
        names = [c.to_numpy()[each] for c in rank]  # vec_id, file_key, row_key
        order = np.lexsort((*names[::-1], -score, asked))
        begins = np.searchsorted(asked[order], asked[order])
        order = order[np.arange(len(order)) - begins <= top]
        return pa.table([one_array(q.column("key")).take(pa.array(asked[order])), *(pa.array(c[order]) for c in names), pa.array(score[order])], schema=out)

    met = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(meet, "key binary, vec_id long, file_key long, row_key long, score double")
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "file_key", "row_key")
    short = met.groupBy(*columns[:4]).agg(F.first("score").alias("score")).withColumn("near", F.row_number().over(nearest)).where(F.col("near") <= top + 1)
    short = written(short, "ann-short")
    own = askers.select("key", F.col("vec_id").alias("query_id"), F.col("file_key").alias("own_file"), F.col("row_key").alias("own_row"))
    found = own.join(short, "key").where("own_file <> file_key or own_row <> row_key")
    rank = F.row_number().over(Window.partitionBy("own_file", "own_row").orderBy("near"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart both lie within ``r`` bits of some value
between them. So every distinct fingerprint emits all values within ``r = 1`` bit of
itself, the values are shuffled, and fingerprints that meet at a value are
candidates, which are deduplicated and verified. A value is met by at most 65
distinct fingerprints, all of them within two bits of each other, so linking each
to the smallest there keeps every component and emits no all-pairs lists.

Equal fingerprints are one node, however many documents share them.

Edge cases: a null or wordless text has fingerprint zero and links like any other;
with fewer than three words the whole sequence is the one shingle; repeated rows
keep one row each; null ids take part but are never the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.components import components
from weirflow.llm.storage import as_scan, located, small_or_plain, whole_rows, written

BITS, SEED = 64, 42
#: Shingles counted at once, so that long texts need no more memory than short ones.
BLOCK = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of shingles' 64-bit hashes as a signed integer; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """Columns ``keep`` with ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "fp long"]))


def links(nodes: DataFrame) -> DataFrame:
    """Links ``hi``, ``lo`` that connect all of the distinct ``fp`` within two bits of each other."""
    flips = [0, *(1 << b for b in range(BITS - 1)), -(1 << (BITS - 1))]
    ball = nodes.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = ball.withColumn("lo", F.min("fp").over(Window.partitionBy("value"))).where("fp > lo")
    return met.select(F.col("fp").alias("hi"), "lo").distinct().where("bit_count(hi ^ lo) <= 2")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, root (a component's smallest fp), component_id, __file, __row."""
    fps = written(fingerprints(located(docs, "doc_id", "text"), ("doc_id", "__file", "__row"), shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes.fp == roots.hi, "left").select("fp", "first_id", F.coalesce("lo", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = written(rooted.join(firsts, "root").select("fp", "root", "component_id"), "simhash-labels")
    return fps.join(labels, "fp").select("doc_id", "fp", "root", "component_id", "__file", "__row")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """Of each component that ``grouped`` finds the row with the smallest ``doc_id``, nulls last, then the first in its file; all columns."""
    docs = as_scan(docs)
    found = written(grouped(docs), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__file", "__row")
    stays = found.groupBy("root").agg(F.min(place).alias("s")).select("s.__file", "s.__row")
    dropped = written(found.select("__file", "__row").join(stays, ["__file", "__row"], "left_anti"), "simhash-dropped")
    return whole_rows(docs).join(small_or_plain(dropped), ["__file", "__row"], "left_anti").select("whole.*")

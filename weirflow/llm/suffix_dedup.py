"""Removal of repeated byte strings by a distributed merge sort of suffixes.

1. Every text is cut to its anchors (see ``suffixes``); hashes of the bytes at the
   anchors are counted, and anchors whose hash occurs once drop out: no string through
   them repeats.
2. The remaining suffixes are sorted in each task, front-coded as runs, and exchanged
   by hash of their first bytes, so suffixes that share ``GRAM`` bytes meet. Equal
   contexts are one entry of a run with a count, however many documents hold them;
   where they occur stays in a table of its own.
3. A task merges its runs with a loser tree that carries common prefixes, and finds
   which strings of ``LENGTH`` bytes through each anchor occur twice.
   A gram with more than ``HOT`` anchors would fill a task, so its contexts aren't merged:
   each of their strings through the anchor is counted by digest in a plain grouping,
   which Spark combines and splits. Both ways find the same strings.
4. The reach of the repeats is joined back to their occurrences, and spans of each
   text are united and cut out.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; repeated
rows are texts of their own, so they lose all they share; strings don't cross texts;
texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.storage import located, row_key, written
from weirflow.llm.suffixes import BACK, LENGTH, anchors, context, name, pack, repeats

RUN, PART = 40_000, 40_000
#: Anchors of one gram up to which its contexts are merged in one task.
HOT = 100_000
KEY = ["file_key", "row_key"]


def raw(value) -> bytes:
    return (value.as_py() or "").encode()


def anchored(texts: DataFrame) -> DataFrame:
    """A row for each anchor: file_key, row_key, place, gram (its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, grams, held = [], [], [], 0
            for i, value in enumerate(batch.column("text")):
                place, gram = anchors(raw(value))
                if len(place):
                    keys.append((i, len(place)))
                    places.append(place)
                    grams.append(gram)
                    held += len(place)
                if held and (held > 200_000 or i == batch.num_rows - 1):
                    rows = np.repeat(*map(np.array, zip(*keys)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in KEY), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64))], [*KEY, "place", "gram"])
                    keys, places, grams, held = [], [], [], 0
            if held:
                rows = np.repeat(*map(np.array, zip(*keys)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in KEY), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams).view(np.int64))], [*KEY, "place", "gram"])

    return texts.mapInArrow(run, "file_key long, row_key long, place long, gram long")


def runs(texts: DataFrame, parts: int) -> DataFrame:
    """From texts with their repeated ``anchors``: rows with a part's sorted run, and rows with a text's contexts by name."""
    entry = pa.list_(pa.struct([("place", pa.int64()), ("context", pa.binary())]))
    schema = pa.schema(
        [("part", pa.int32()), ("run", pa.binary()), ("file_key", pa.int64()), ("row_key", pa.int64()), ("at", entry), ("context", pa.binary()), ("suffix", pa.binary()), ("before", pa.binary()), ("times", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        hot: dict[tuple[bytes, bytes], int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for part in list(held):
                yield pa.RecordBatch.from_pylist([{"part": part, "run": pack(held.pop(part))}], schema)
            rows = [{"context": name(*k), "suffix": k[0], "before": k[1][::-1], "times": n} for k, n in hot.items()]
            hot.clear()
            for first in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_pylist(rows[first : first + 2_000], schema)

        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column("text")):
                text, at = raw(value), []
                for a in batch.column("anchors")[i].as_py():
                    key = context(text, a["place"])
                    entries = hot if a["hot"] else held.setdefault(a["gram"] % parts, {})
                    entries[key] = entries.get(key, 0) + 1
                    size += entries[key] == 1
                    at.append({"place": a["place"], "context": name(*key)})
                rows.append({"file_key": batch.column("file_key")[i].as_py(), "row_key": batch.column("row_key")[i].as_py(), "at": at})
                if size >= RUN:
                    yield from out()
                    size = 0
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        yield from out()

    kind = "part int, run binary, file_key long, row_key long, at array<struct<place: bigint, context: binary>>, context binary, suffix binary, before binary, times long"
    return texts.mapInArrow(run, kind)


def counted(contexts: DataFrame) -> DataFrame:
    """``context``, ``back`` and ``on`` as ``suffixes.repeats`` gives them, for contexts (context, suffix, before, times) of any number."""
    once = contexts.groupBy("context", "suffix", "before").agg(F.sum("times").alias("times"))
    back = F.col("back")
    strings = once.select("*", F.explode(F.sequence(F.lit(0), F.lit(BACK))).alias("back")).where((back <= F.octet_length("before")) & (LENGTH - back <= F.octet_length("suffix")))
    whole = F.concat(F.substring("before", F.octet_length("before") - back + 1, back), F.substring("suffix", F.lit(1), LENGTH - back))
    strings = written(strings.select("context", "times", "back", F.unhex(F.md5(whole)).alias("digest")), "suffix-strings")
    # equal strings have an anchor at the same place; a string with several anchors counts once at each
    twice = strings.groupBy("digest", "back").agg(F.sum("times").alias("n")).where("n > 1").select("digest", "back")
    return strings.join(twice, ["digest", "back"]).groupBy("context").agg(F.max("back").alias("back"), (LENGTH - F.min("back")).alias("on"))


def spans(texts: DataFrame) -> DataFrame:
    """For each text with repeats: file_key, row_key, spans (array of start and end, which may overlap)."""
    found = written(anchored(texts), "suffix-anchors")
    twice = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    kept = found.join(twice.select("gram", (F.col("n") > HOT).alias("hot")), "gram")
    kept = kept.groupBy(*KEY).agg(F.collect_list(F.struct("place", "gram", "hot")).alias("anchors"))
    kept = written(kept, "suffix-kept")
    cold, hot = twice.agg(F.sum(F.when(F.col("n") <= HOT, F.col("n"))), F.sum((F.col("n") > HOT).cast("int"))).first()
    parts = max(1, -(-(cold or 0) // PART))
    both = written(runs(texts.join(kept, KEY), parts), "suffix-runs")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(repeats(table.column("run").to_pylist()))
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table({"context": pa.array(columns[0], pa.binary()), "back": pa.array(columns[1], pa.int32()), "on": pa.array(columns[2], pa.int32())})

    reach = both.where("run is not null").select("part", "run").groupBy("part").applyInArrow(meet, "context binary, back int, on int")
    if hot:
        reach = reach.unionByName(counted(both.where("suffix is not null").select("context", "suffix", "before", "times")))
    reach = written(reach, "suffix-reach")
    places = both.where("at is not null").select(*KEY, F.explode("at").alias("a")).select(*KEY, "a.place", "a.context")
    cut = places.join(reach, "context").select(*KEY, F.struct((F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("on")).alias("end")).alias("s"))
    return written(cut.groupBy(*KEY).agg(F.collect_list("s").alias("spans")), "suffix-spans")


def united(pairs: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((p["start"], p["end"]) for p in pairs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_out(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, removed (array of start and end), kept (bytes)."""
    texts = located(docs, "doc_id", "text").select("doc_id", "text", *row_key())
    found = spans(texts.select(*KEY, "text"))
    joined = texts.join(found, KEY, "left").select("doc_id", "text", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, cuts, kept = [], [], []
                for value, pairs in zip(part.column("text"), part.column("spans").to_pylist()):
                    text, cut = raw(value), united(pairs or [])
                    edges = [0, *(e for c in cut for e in c), len(text)]
                    sizes.append(len(text))
                    cuts.append([{"start": a, "end": b} for a, b in cut])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary")

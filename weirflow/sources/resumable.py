"""Page reads that go on where they stopped, and that start over on a narrower slice.

A read is a row of rounds. In each round tasks fetch the next pages of all slices that
aren't done, a slice a task, and write their records together with the slice's next page token as one
table, ``folder/v=<number>``, which Spark commits as a whole. So the state of a read is the newest
whole round: a read that was killed, at any point, goes on from there, fetches again at most what
the broken round had fetched, and ends with the rows of an unbroken one.

An API that serves only so many records from one query needs the query narrowed. After ``record_limit``
records of a slice, or on a status in the list ``reset``, its paging starts over, on the slice from the
largest cursor seen, whose records come again. A slice that doesn't get narrower fails, as it would go round
forever; without a cursor a status in ``reset`` may start a slice over once.
"""

from __future__ import annotations

import json
import urllib.error
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.http import DEFAULTS, PagedReader, at_path, comes_before
from weirflow.streaming.cursors import versions

STATE = "id long, slice string, token string, seen long, latest string, tries int, done boolean"
ROUND = f"kind string, at long, record string, {STATE}"


class Walk:
    """One slice on its way through its pages. ``state`` is a row of ``STATE`` as a dict."""

    def __init__(self, options: dict, state: dict) -> None:
        self.o, self.state = options, state
        self.fields = json.loads(state["slice"])
        self.reader = PagedReader(options)
        self.token = json.loads(state["token"])

    def start_over(self) -> None:
        """Paging from the first page, on the slice from the largest cursor seen."""
        field, latest = self.o.get("start_field"), self.state["latest"]
        narrower = dict(self.fields)
        if field and self.o.get("cursor_field") and latest is not None:
            narrower[field] = json.loads(latest)
        tries = self.state["tries"] + 1 if narrower == self.fields else 0
        if tries >= (1 if self.o.get("cursor_field") else 2):
            raise ValueError(f"the slice {json.dumps(self.fields)} starts over without getting narrower")
        self.fields, self.token = narrower, self.reader.first()
        self.state |= {"tries": tries, "seen": 0, "slice": json.dumps(narrower)}

    def pages(self, count: int) -> Iterator[list]:
        """The records of up to ``count`` pages; ``state`` is then what to go on from."""
        limit, reset, field = self.o.get("record_limit"), json.loads(self.o.get("reset", "[]")), self.o.get("cursor_field")
        for _ in range(count):
            try:
                found, following = self.reader.page(self.fields, self.token)
            except urllib.error.HTTPError as e:
                if e.code not in reset:
                    raise
                self.start_over()
                continue
            yield self.reader.kept(found)
            self.state["seen"] += len(found)
            for cursor in (at_path(r, field) for r in found) if field else ():
                latest = self.state["latest"]
                if cursor is not None and (latest is None or comes_before(json.loads(latest), cursor)):
                    self.state["latest"] = json.dumps(cursor)
            if following is None and not (limit and self.state["seen"] >= int(limit)):
                self.state["done"] = True
                break
            if limit and self.state["seen"] >= int(limit):
                self.start_over()
            else:
                self.token = following
        self.state["token"] = json.dumps(self.token)


def first_state(slices: DataFrame, options: dict) -> DataFrame:
    """The state before the first round: ``slices`` has a row a slice, of the fields that go with its requests."""
    token = json.dumps(PagedReader(options).first())
    numbered = slices.select(F.monotonically_increasing_id().alias("id"), F.to_json(F.struct("*")).alias("slice"))
    rest = {"token": F.lit(token), "seen": F.lit(0).cast("long"), "latest": F.lit(None).cast("string"), "tries": F.lit(0), "done": F.lit(False)}
    return numbered.withColumns(rest)


def read_round(states: DataFrame, options: dict, pages: int) -> DataFrame:
    """Records and next states (``ROUND``) after up to ``pages`` pages of every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("record", pa.string()), ("id", pa.int64()), ("slice", pa.string()), ("token", pa.string()), ("seen", pa.int64()), ("latest", pa.string()), ("tries", pa.int32()), ("done", pa.bool_())])
        for batch in batches:
            for state in batch.to_pylist():
                walk, at = Walk(options, dict(state)), 0
                for found in walk.pages(pages):
                    rows = [{"kind": "record", "at": at + i, "record": json.dumps(r), "id": state["id"], "slice": json.dumps(walk.fields)} for i, r in enumerate(found)]
                    at += len(rows)
                    yield pa.RecordBatch.from_pylist(rows, schema)
                yield pa.RecordBatch.from_pylist([{"kind": "state", "at": at, **walk.state}], schema)

    return states.mapInArrow(run, ROUND)


def read_pages(spark: SparkSession, slices: DataFrame, folder: str, options: dict, pages: int = 10, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """``slice`` and ``record`` (JSON) of all pages of ``slices``, and whether the read is done.

    ``options`` are those of the paged HTTP source, ``cursor_field`` and ``start_field`` (the slice's field that
    narrowing sets), ``record_limit`` and ``reset``. What ``folder`` holds from an earlier call is
    gone on from; ``rounds`` stops after so many more rounds.
    """
    options = DEFAULTS | options
    first = f"{folder}/v=0"
    if not (found := versions(spark, folder)):
        states = first_state(slices, options)
        states.select(F.lit("state").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("record"), *states.columns).write.mode("overwrite").parquet(first)
        found = [0]
    at = found[-1]
    while True:
        states = spark.read.schema(ROUND).parquet(f"{folder}/v={at}").where("kind = 'state' and not done").drop("kind", "at", "record")
        left = states.count()
        if not left or rounds == 0:
            break
        at, rounds = at + 1, None if rounds is None else rounds - 1
        spread = states.repartition(min(left, 10_000), "id")
        read_round(spread, options, pages).write.mode("overwrite").parquet(f"{folder}/v={at}")
    whole = spark.read.schema(ROUND).parquet(*(f"{folder}/v={v}" for v in range(at + 1)))
    return whole.where("kind = 'record'").select("slice", "record"), not left

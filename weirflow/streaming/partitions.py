"""Cursors by partition of many streams at once, as keyed state of a streaming query.

A stream's partitions are read slice by slice, several at a time, and slices close in any order. Its sync
state must never claim more than was read: a partition's cursor is the largest one in the slices that
closed without a gap before them, and the parent's state is that before the oldest partition still open.

Events arrive as rows, in order of ``n``: ``open`` of a slice (with the parent's state at that
moment, and whether it is the partition's last), ``record`` (with a cursor), ``close`` of a
slice, and ``end`` of a read. Slices of a partition open in rising order; of one that opens below a closed one the cursor
waits longer, never less. State is keyed by stream: one entry a partition, ``cap`` of them at most, with a number for each of its
slices that are open, so it is bounded whatever the number of records and closed slices. Spark sorts a batch's events of a stream, on disk where
they are many, and they are applied ``BLOCK`` at a time, so a task holds no more of a large batch than of a small one. At the cap the oldest finished partition goes, or else the
oldest; a stream with more than ``switch`` partitions gives up cursors by partition for one global cursor, from
which partitions without an entry start.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Partitions that are kept, and beyond which a stream has one cursor.
CAP, SWITCH = 25_000, 10_000
#: Fixed value: how many events a task holds at a time.
BLOCK = 100_000
#: What a stream of events has besides its own name.
EVENTS = "stream string, n long, kind string, partition string, slice long, last boolean, cursor long, parent string"
STATE = "stream string, version long, state string"
#: The parts of a stream's state apart from its partitions.
EMPTY = {"version": 0, "created": 0, "opened": 0, "global": None, "next_global": None, "use_global": False, "parent": None, "parents": [], "synced": False}
#: Spark's check of streaming plans refuses every sort, as none can order a whole stream; that of ``partition_states`` orders a batch's partitions only.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.unsupportedOperationCheck": "false",
}


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Cursors:
    """One stream's state. ``partitions`` holds entries in the order they were made; ``touched`` those to write, ``gone`` those to delete.

    An entry's ``open`` slices are sorted, and ``ahead`` has for each the largest cursor seen in it and in the closed
    slices between it and the next open one: all that waits for it to close. ``late`` came after the slices it belongs to;
    ``top`` is the last slice with a cursor.
    """

    def __init__(self, whole: dict, partitions: dict[str, dict], cap: int, switch: int) -> None:
        self.whole, self.partitions, self.cap, self.switch = whole, partitions, cap, switch
        self.stored = set(partitions)
        self.touched: set[str] = set()
        self.gone: set[str] = set()
        self.live = [(e["seq"], p) for p, e in partitions.items() if e["seq"] is not None]
        heapq.heapify(self.live)
        for entry in partitions.values():
            self.settle(entry)

    @staticmethod
    def settle(entry: dict) -> None:
        """Brings an entry, also one written with a cursor for each closed slice, into the form that is kept here."""
        entry |= {"late": entry.get("late"), "top": entry.get("top", -1)}
        entry["open"] = sorted(entry["open"])
        seen, entry["ahead"] = entry["ahead"], {}
        for number, cursor in seen.items():
            Cursors.wait(entry, int(number), cursor)

    @staticmethod
    def wait(entry: dict, number: int, cursor: int | None) -> None:
        """A cursor of a slice waits with the last open one up to it."""
        if cursor is None:
            return
        entry["top"] = max(entry["top"], number)
        at = bisect_left(entry["open"], number + 1)
        if at:
            before = entry["open"][at - 1]
            entry["ahead"][before] = larger(entry["ahead"].get(before), cursor)
        else:
            entry["late"] = larger(entry["late"], cursor)

    def oldest(self) -> int | None:
        """The number of the oldest partition that is open."""
        while self.live:
            seq, name = self.live[0]
            if name in self.partitions and self.partitions[name]["seq"] == seq:
                return seq
            heapq.heappop(self.live)
        return None

    def room(self) -> None:
        """Makes room for one more partition: the oldest that is read to its end goes, else the oldest."""
        if self.whole["created"] > self.switch:
            self.whole["use_global"] = True
        while len(self.partitions) > self.cap - 1:
            name = next((p for p, e in self.partitions.items() if e["seq"] is None), next(iter(self.partitions)))
            del self.partitions[name]
            self.touched.discard(name)
            if name in self.stored:
                self.gone.add(name)

    def open(self, name: str, number: int, last: bool, parent: str | None) -> None:
        entry = self.partitions.get(name)
        if entry is None or entry["seq"] is None:
            self.room()
            entry = self.partitions.get(name)
            if entry is None:
                entry = {"made": self.whole["created"], "cursor": self.whole["global"]}
                self.whole["created"] += 1
            entry |= {"seq": self.whole["opened"], "open": [], "ahead": {}, "late": None, "top": -1, "finished": False}
            parents = self.whole["parents"]
            if parent is not None and (not parents or parents[-1][1] != parent):
                parents.append([self.whole["opened"], parent])
            if len(self.live) > 2 * len(self.partitions) + 100:  # most of them are read to their end
                self.live = [(e["seq"], p) for p, e in self.partitions.items() if e["seq"] is not None]
                heapq.heapify(self.live)
            heapq.heappush(self.live, (self.whole["opened"], name))
            self.whole["opened"] += 1
            self.partitions[name] = entry
            self.gone.discard(name)
        if not entry["finished"]:  # a partition that comes twice is read once
            held, waiting = entry["open"], None
            if number < entry["top"]:  # what is closed above it waits for it too
                at = bisect_left(held, number)
                if at:
                    waiting = entry["ahead"].pop(held[at - 1], None)
                else:
                    waiting, entry["late"] = entry["late"], None
            insort(held, number)
            self.wait(entry, number, waiting)
            entry["finished"] = last
        self.touched.add(name)

    def record(self, name: str, number: int, cursor: int | None) -> None:
        if cursor is None:
            return
        self.whole["synced"] = True
        self.whole["next_global"] = larger(self.whole["next_global"], cursor)
        entry = self.partitions.get(name)
        if entry is not None and entry["seq"] is not None:
            self.wait(entry, number, cursor)
            self.touched.add(name)

    def close(self, name: str, number: int) -> None:
        entry = self.partitions.get(name)
        if entry is None or entry["seq"] is None:
            return
        held = entry["open"]
        at = bisect_left(held, number)
        if at == len(held) or held[at] != number:
            return
        again = at + 1 < len(held) and held[at + 1] == number  # opened more than once
        del held[at]
        if not again:
            self.wait(entry, number, entry["ahead"].pop(number, None))
        entry["cursor"], entry["late"] = larger(entry["cursor"], entry["late"]) if entry["late"] is not None else entry["cursor"], None
        if entry["finished"] and not held:
            entry["seq"] = None
        self.touched.add(name)
        parents = self.whole["parents"]
        while parents and ((oldest := self.oldest()) is None or oldest > parents[0][0]):
            self.whole["parent"] = parents.pop(0)[1]

    def end(self, parent: str | None) -> None:
        """A read is over; where nothing is open its global cursor holds from now on."""
        if any(e["seq"] is not None for e in self.partitions.values()):
            return
        if self.whole["synced"]:
            self.whole["global"] = self.whole["next_global"]
        self.whole["parent"] = parent if parent is not None else self.whole["parent"]

    def apply(self, events: pd.DataFrame) -> None:
        """Events in their order."""
        columns = (events[c].tolist() for c in ("kind", "partition", "slice", "last", "cursor", "parent"))
        for kind, name, number, last, cursor, parent in zip(*columns):
            if kind == "open":
                self.open(name, number, last, parent)
            elif kind == "record":
                self.record(name, number, cursor)
            elif kind == "close":
                self.close(name, number)
            elif kind == "end":
                self.end(parent)

    def shown(self) -> str:
        """The sync state as JSON."""
        out = {"use_global_cursor": self.whole["use_global"]}
        if not self.whole["use_global"]:
            out["states"] = [{"partition": name, "cursor": e["cursor"]} for name, e in self.partitions.items() if e["cursor"] is not None]
        if self.whole["global"] is not None:
            out["state"] = self.whole["global"]
        if self.whole["parent"] is not None:
            out["parent_state"] = self.whole["parent"]
        return json.dumps(out)


class CursorProcessor(StatefulProcessor):
    def __init__(self, cap: int, switch: int) -> None:
        self.cap, self.switch = cap, switch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("partitions", "partition string", "entry string")
        self.whole = handle.getValueState("whole", "whole string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = json.loads(self.whole.get()[0]) if self.whole.exists() else json.loads(json.dumps(EMPTY))
        entries = {k[0]: json.loads(v[0]) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        ordered = dict(sorted(entries.items(), key=lambda e: e[1]["made"]))
        cursors = Cursors(whole, ordered, self.cap, self.switch)
        for events in blocks(rows):
            cursors.apply(condensed(events))
        for name in cursors.gone:
            self.entries.removeKey((name,))
        for name in cursors.touched & cursors.partitions.keys():
            self.entries.updateValue((name,), (json.dumps(cursors.partitions[name]),))
        whole["version"] += 1
        self.whole.update((json.dumps(whole),))
        yield pd.DataFrame({"stream": [key[0]], "version": [whole["version"]], "state": [cursors.shown()]})

    def close(self) -> None:
        pass


def blocks(chunks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stream's events, which come in order, with ``BLOCK`` rows or a chunk's more."""
    held, size, latest = [], 0, None
    for chunk in chunks:
        if not chunk["n"].is_monotonic_increasing or latest is not None and chunk["n"].iloc[0] < latest:
            raise ValueError("the events of a stream don't come in order")
        latest = chunk["n"].iloc[-1]
        held.append(chunk)
        size += len(chunk)
        if size >= BLOCK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def condensed(events: pd.DataFrame) -> pd.DataFrame:
    """Events in order; of a slice's records between which its partition has no other kind and the stream no end, only the first, with the largest cursor."""
    record = events["kind"] == "record"
    if not events[record].duplicated(["partition", "slice"]).any():
        return events
    turns = events["kind"].isin(["open", "close"]).groupby(events["partition"], dropna=False).cumsum()
    runs = events.assign(turns=turns, ends=(events["kind"] == "end").cumsum())[record]
    by = ["partition", "slice", "turns", "ends"]
    largest = runs.groupby(by, sort=False, dropna=False)["cursor"].transform("max")
    first = largest[~runs.duplicated(by)]
    kept = events[~record | events.index.isin(first.index)].copy()
    kept.loc[first.index, "cursor"] = first
    return kept


def partition_states(events: DataFrame, cap: int = CAP, switch: int = SWITCH) -> DataFrame:
    """``STATE`` after each batch of a streaming DataFrame of ``EVENTS``; needs the settings that ``rocks`` makes."""
    kind = F.when((F.col("kind") != "record") | F.col("cursor").isNotNull(), F.col("kind"))  # a record without a cursor says nothing
    filled = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)  # noqa: E731  # a null would make pandas' integers floats
    rows = events.select("stream", filled("n", 2**63 - 1), kind.alias("kind"), "partition", filled("slice", 0), filled("last", False), filled("cursor", 0), "parent")
    ordered = rows.repartition("stream").sortWithinPartitions("stream", "n")
    return ordered.groupBy("stream").transformWithStateInPandas(CursorProcessor(cap, switch), STATE, "Append", "None")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The settings of keyed state, and of the order in its batches, for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states_after(spark: SparkSession, events: DataFrame, table: str, checkpoint: str, cap: int = CAP, switch: int = SWITCH) -> DataFrame:
    """Runs what is there of ``events``, keeps every stream's states in ``table``, and returns each stream's newest."""
    with rocks(spark):
        query = partition_states(events, cap, switch).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(STATE).parquet(table).groupBy("stream").agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state"))

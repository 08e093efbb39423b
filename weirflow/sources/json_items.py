"""Items of large JSON documents, in bounded memory: ``spark.read.format("json_items")`` after ``register(spark)``.

A file is one document of any size. It is read piece by piece, and what lies outside the wanted path is passed over
without being kept, so a task holds one item and one piece at a time. Bytes of gzip are inflated on the way.

Options: ``path`` of files or a folder, ``glob``, and ``items``, a dotted path to the wanted values: a name
steps into an object, a number into a list, ``*`` into every value of either. A list at its end gives its elements, another
value itself; a path that leads nowhere gives nothing. Rows are ``file``, ``position`` in it and ``item``, as JSON text.
``items_of`` does the same for a column of bodies, which are in memory already.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weirflow.sources.store import files_below, place

PIECE, ROWS, BYTES = 256 << 10, 1_000, 4 << 20
BLANK, MARK, QUOTE, SCALAR = re.compile(rb"[ \t\r\n]*"), re.compile(rb'["{}\[\]]'), re.compile(rb'["\\]'), re.compile(rb"[^ \t\r\n,\]}:]*")


class Document:
    """A document on its way through: ``data`` is what is held of it, ``at`` the place in that."""

    def __init__(self, read: Callable[[int], bytes]) -> None:
        self.read, self.data, self.at, self.passed = read, b"", 0, 0
        self.kept: int | None = None  # where a value begins that must stay

    def more(self) -> bool:
        """Reads on, and lets go of what was passed over."""
        start = self.at if self.kept is None else self.kept
        piece = self.read(max(PIECE, len(self.data) - start))  # a long value takes few rounds
        self.data, self.at, self.passed = self.data[start:] + piece, self.at - start, self.passed + start
        if self.kept is not None:
            self.kept = 0
        return bool(piece)

    def fail(self, what: str) -> None:
        raise ValueError(f"{what} at byte {self.passed + self.at}")

    def peek(self) -> bytes:
        """The next byte that isn't blank; none at the end."""
        while True:
            self.at = BLANK.match(self.data, self.at).end()
            if self.at < len(self.data):
                return self.data[self.at : self.at + 1]
            if not self.more():
                return b""

    def take(self, sign: bytes) -> None:
        if self.peek() != sign:
            self.fail(f"expected {sign.decode()}")
        self.at += 1

    def search(self, pattern: re.Pattern) -> bytes:
        """Goes behind the next match, which is a byte."""
        while not (found := pattern.search(self.data, self.at)):
            self.at = len(self.data)
            if not self.more():
                self.fail("the document ends within a value")
        self.at = found.end()
        return found[0]

    def skip_string(self) -> None:
        self.take(b'"')
        while self.search(QUOTE) == b"\\":
            while self.at >= len(self.data):
                if not self.more():
                    self.fail("the document ends within a text")
            self.at += 1

    def skip(self) -> None:
        """Goes behind the next value."""
        first = self.peek()
        if first == b'"':
            self.skip_string()
        elif first in (b"{", b"["):
            depth = 0
            while True:
                sign = self.search(MARK)
                if sign == b'"':
                    self.at -= 1
                    self.skip_string()
                else:
                    depth += 1 if sign in b"{[" else -1
                    if not depth:
                        return
        else:
            begun = self.at
            while (end := SCALAR.match(self.data, self.at).end()) == len(self.data):
                before = self.passed + begun
                self.at = end
                more = self.more()
                begun = before - self.passed
                if not more:
                    break
            else:
                self.at = end
            if self.passed + self.at == self.passed + begun:
                self.fail("expected a value")

    def value(self) -> bytes:
        """The next value's bytes, which are JSON or fail."""
        self.peek()
        self.kept = self.at
        self.skip()
        found, self.kept = self.data[self.kept : self.at], None
        try:
            json.loads(found)
        except ValueError:
            self.fail("a value isn't JSON")
        return found

    def members(self, names: bool) -> Iterator[str]:
        """Stops before each value of the object (or list) that comes next, with its name (or number)."""
        close = b"}" if names else b"]"
        self.at += 1
        number = 0
        if self.peek() == close:
            self.at += 1
            return
        while True:
            name = str(number)
            if names:
                name = json.loads(self.value())
                self.take(b":")
            yield name
            number += 1
            if self.peek() == close:
                self.at += 1
                return
            self.take(b",")

    def items(self, steps: list[str]) -> Iterator[bytes]:
        """The values at a path below the next value."""
        first = self.peek()
        if not first:
            return
        if not steps:
            if first == b"[":
                for _ in self.members(names=False):
                    yield self.value()
            else:
                yield self.value()
        elif first in (b"{", b"["):
            for name in self.members(names=first == b"{"):
                if steps[0] in ("*", name):
                    yield from self.items(steps[1:])
                else:
                    self.skip()
        else:
            self.skip()


def inflated(read: Callable[[int], bytes]) -> Callable[[int], bytes]:
    """``read``, of bytes that may be those of gzip."""
    head = b""
    while len(head) < 2 and (piece := read(2 - len(head))):
        head += piece
    if not head.startswith(b"\x1f\x8b"):
        held = [head]
        return lambda n: held.pop() if held and held[0] else read(n)
    state = {"z": zlib.decompressobj(31), "left": head}

    def plain(n: int) -> bytes:
        while True:
            data = state["left"] or read(n)
            if not data:
                return b""
            out = state["z"].decompress(data, PIECE)
            state["left"] = state["z"].unconsumed_tail
            if state["z"].eof:  # a file may have several members
                state["left"], state["z"] = state["z"].unused_data, zlib.decompressobj(31)
            if out:
                return out

    return plain


def items(read: Callable[[int], bytes], path: str) -> Iterator[bytes]:
    """The values at a dotted path of the document that ``read`` gives piece by piece."""
    document = Document(inflated(read))
    yield from document.items([s for s in path.split(".") if s])
    if document.peek():
        document.fail("more than one value")


@dataclass
class File(InputPartition):
    path: str


class ItemsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[File]:
        return [File(f.path) for f in files_below(self.options["path"], self.options.get("glob", "*"))[1]] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, rows, size, at = ["file", "position", "item"], [], 0, 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array(range(at - len(rows), at), pa.int64()), pa.array(rows, pa.string())], names)
        with place(self.options["path"])[0].open_input_file(partition.path) as f:
            try:
                for item in items(f.read, self.options.get("items", "")):
                    rows.append(item.decode())
                    size, at = size + len(item), at + 1
                    if len(rows) >= ROWS or size > BYTES:
                        yield made()
                        rows, size = [], 0
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e
        if rows:
            yield made()


class JsonItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return "file string, position long, item string"

    def reader(self, schema) -> ItemsReader:
        return ItemsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonItems)


def items_of(df: DataFrame, body: str, path: str, keep: list[str] = ()) -> DataFrame:
    """``keep``, ``position`` and ``item`` of the items in a column of bodies (text or binary); a null body has none."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("__body")):
                data = content.as_py()
                found = [x.decode() for x in items(io.BytesIO(data).read, path)] if data is not None else []
                kept = [pa.array([batch.column(k)[i].as_py()] * len(found), batch.schema.field(k).type) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], [*keep, "position", "item"])

    kind = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "position long", "item string"])
    return df.select(*keep, df[body].cast("binary").alias("__body")).mapInArrow(run, kind)

"""Avro container files: ``read_avro``, and ``df.write.format("avro_files")`` after ``register(spark)``.

A file is a header and blocks, each followed by the file's own sync marker. So a large file is read by several
tasks: a task begins at the first marker in its range of bytes and reads the blocks whose
marker lies in it. Blocks are inflated one by one and their values decoded, by functions made
once from the writer's schema, to Arrow batches of bounded size.

Values become Spark's own types; ``text`` gives those that JSON lacks (decimals, times, binary)
as text, and doubles with ``double_as_string``. A union of null and one type is a nullable column; a union of
several types, and a type that holds itself, is JSON text. The schema is that of the first file by
name; in others, fields are taken by name and missing ones are null. A file that isn't Avro fails with its name.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.sources.store import files_below, place, reachable

MAGIC, MARK = b"Obj\x01", 16
SPLIT, PIECE, ROWS, BLOCK = 32 << 20, 1 << 20, 2_000, 64 << 10
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
#: The parts of a second in the logical types of times.
PARTS = {"millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}
#: Avro's primitive types and Spark's.
PRIMITIVE = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}

Read = Callable[[bytes, int], tuple[object, int]]


def number(data: bytes, at: int) -> tuple[int, int]:
    """A zigzag number of variable length."""
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return (out >> 1) ^ -(out & 1), at
        shift += 7


def as_json(value: object) -> str | None:
    return None if value is None else json.dumps(value, default=lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v))


@dataclass
class Kind:
    """A type: how it reads, and Spark's type for it."""

    read: Read
    spark: T.DataType


class Schema:
    """Readers for a writer's schema. ``text`` gives values that JSON lacks as text."""

    def __init__(self, schema: object, text: bool = False, double_as_string: bool = False) -> None:
        self.text, self.double_as_string = text, double_as_string
        self.names: dict[str, Kind | None] = {}
        self.kind = self.of(schema, "")
        if not isinstance(self.kind.spark, T.StructType):
            raise ValueError(f"only files of records are read, not of {schema if isinstance(schema, str) else schema.get('type')}")

    def of(self, schema: object, space: str) -> Kind:
        if isinstance(schema, list):
            return self.union(schema, space)
        if isinstance(schema, str):
            return self.primitive(schema) if schema in PRIMITIVE else self.named(schema, space)
        kind, logical = schema["type"], schema.get("logicalType")
        if isinstance(kind, dict | list) or kind not in (*PRIMITIVE, "record", "error", "enum", "fixed", "array", "map"):
            return self.of(kind, space)
        if kind in ("record", "error", "enum", "fixed"):
            name = self.full(schema["name"], schema.get("namespace", space))
            self.names[name] = None  # known, but not made yet
            made = self.record(schema, name.rpartition(".")[0]) if kind in ("record", "error") else self.enum(schema) if kind == "enum" else self.fixed(schema)
            self.names[name] = made = self.logical(made, logical, schema)
            return made
        if kind == "array":
            item = self.of(schema["items"], space)
            return Kind(self.blocks(lambda data, at: item.read(data, at), list), T.ArrayType(item.spark))
        if kind == "map":
            value = self.of(schema["values"], space)

            def pair(data: bytes, at: int) -> tuple[tuple, int]:
                key, at = self.string(data, at)
                found, at = value.read(data, at)
                return (key, found), at

            return Kind(self.blocks(pair, list), T.MapType(T.StringType(), value.spark))  # as Arrow takes maps: pairs
        return self.logical(self.primitive(kind), logical, schema)

    @staticmethod
    def full(name: str, space: str | None) -> str:
        return name if "." in name or not space else f"{space}.{name}"

    def named(self, name: str, space: str) -> Kind:
        found = self.full(name, space)
        found = found if found in self.names else name
        if found not in self.names:
            raise ValueError(f"unknown type {name}")
        if (known := self.names[found]) is not None:
            return known

        def inner(data: bytes, at: int) -> tuple[str | None, int]:  # a type within itself
            value, at = self.names[found].read(data, at)
            return as_json(value), at

        return Kind(inner, T.StringType())

    @staticmethod
    def string(data: bytes, at: int) -> tuple[str, int]:
        size, at = number(data, at)
        return data[at : at + size].decode(), at + size

    def primitive(self, name: str) -> Kind:
        def raw(data: bytes, at: int) -> tuple[object, int]:
            size, at = number(data, at)
            return data[at : at + size].decode() if self.text else data[at : at + size], at + size

        def real(data: bytes, at: int) -> tuple[object, int]:
            value = struct.unpack_from("<d", data, at)[0]
            return str(value) if self.double_as_string else value, at + 8

        reads = {
            "null": lambda data, at: (None, at),
            "boolean": lambda data, at: (data[at] == 1, at + 1),
            "int": number,
            "long": number,
            "float": lambda data, at: (struct.unpack_from("<f", data, at)[0], at + 4),
            "double": real,
            "bytes": raw,
            "string": self.string,
        }
        texts = name == "bytes" and self.text or name == "double" and self.double_as_string
        return Kind(reads[name], T.StringType() if texts else PRIMITIVE[name])

    def record(self, schema: dict, space: str) -> Kind:
        fields = [(f["name"], self.of(f["type"], space)) for f in schema["fields"]]

        def read(data: bytes, at: int) -> tuple[dict, int]:
            out = {}
            for name, kind in fields:
                out[name], at = kind.read(data, at)
            return out, at

        return Kind(read, T.StructType([T.StructField(name, kind.spark) for name, kind in fields]))

    def enum(self, schema: dict) -> Kind:
        def read(data: bytes, at: int) -> tuple[str, int]:
            place, at = number(data, at)
            return schema["symbols"][place], at

        return Kind(read, T.StringType())

    def fixed(self, schema: dict) -> Kind:
        size, text = schema["size"], self.text and "logicalType" not in schema
        return Kind(lambda data, at: (data[at : at + size].hex() if text else data[at : at + size], at + size), T.StringType() if text else T.BinaryType())

    @staticmethod
    def blocks(item: Read, make: Callable) -> Read:
        def read(data: bytes, at: int) -> tuple[object, int]:
            out = []
            while True:
                count, at = number(data, at)
                if count == 0:
                    return make(out), at
                if count < 0:  # its size in bytes comes first
                    _, at = number(data, at)
                for _ in range(abs(count)):
                    value, at = item(data, at)
                    out.append(value)

        return read

    def union(self, schemas: list, space: str) -> Kind:
        kinds = [self.of(s, space) for s in schemas]
        real = [k for k in kinds if not isinstance(k.spark, T.NullType)]

        def read(data: bytes, at: int) -> tuple[object, int]:
            branch, at = number(data, at)
            return kinds[branch].read(data, at)

        def read_json(data: bytes, at: int) -> tuple[str | None, int]:
            value, at = read(data, at)
            return as_json(value), at

        if len(real) > 1:
            return Kind(read_json, T.StringType())
        return Kind(read, real[0].spark if real else T.NullType())

    def logical(self, plain: Kind, name: str | None, schema: dict) -> Kind:
        """A type with its logical type; an unknown one is as if it weren't there."""
        part = PARTS.get((name or "").rpartition("-")[2])

        def mapped(change: Callable, kind: T.DataType) -> Kind:
            def read(data: bytes, at: int) -> tuple[object, int]:
                value, at = plain.read(data, at)
                return change(value), at

            return Kind(read, kind)

        if name == "decimal":
            precision, scale = schema["precision"], schema.get("scale", 0)
            raw = Schema.__new__(Schema)
            raw.text = raw.double_as_string = False
            plain = raw.primitive("bytes") if schema["type"] == "bytes" else Kind(lambda data, at, size=schema["size"]: (data[at : at + size], at + size), T.BinaryType())

            def exact(b: bytes) -> decimal.Decimal:
                n = int.from_bytes(b, "big", signed=True)
                return decimal.Decimal((int(n < 0), tuple(map(int, str(abs(n)))), -scale))  # without a context's rounding

            return mapped(lambda b: str(exact(b)) if self.text else exact(b), T.StringType() if self.text else T.DecimalType(min(38, precision), scale))
        if name == "date":
            return mapped(lambda d: (EPOCH + datetime.timedelta(d)).date().isoformat() if self.text else d, T.StringType() if self.text else T.DateType())
        if part and name.startswith("time-"):
            return mapped(lambda v: (EPOCH + datetime.timedelta(microseconds=v * 1_000_000 // part)).time().isoformat("microseconds"), T.StringType())
        if part and name.startswith(("timestamp-", "local-timestamp-")):
            local, spec = name.startswith("local"), "milliseconds" if part == 1_000 else "microseconds"
            start = EPOCH.replace(tzinfo=None) if local else EPOCH
            if self.text:
                return mapped(lambda v: (start + datetime.timedelta(microseconds=v * 1_000_000 // part)).isoformat("T", spec), T.StringType())
            return mapped(lambda v: v * 1_000_000 // part, T.TimestampNTZType() if local else T.TimestampType())
        return plain


@dataclass
class Header:
    schema: object
    codec: str
    marker: bytes
    end: int


def header(f, name: str) -> Header:
    """The header of an open file."""
    f.seek(0)
    data = f.read(PIECE)
    if data[:4] != MAGIC:
        raise ValueError(f"{name} isn't an Avro file")
    while True:
        try:
            found, at, meta = None, 4, {}
            while found != 0:
                found, at = number(data, at)
                if found < 0:
                    _, at = number(data, at)
                for _ in range(abs(found)):
                    key, at = Schema.string(data, at)
                    size, at = number(data, at)
                    if at + size > len(data):
                        raise IndexError
                    meta[key], at = data[at : at + size], at + size
            if at + MARK > len(data):
                raise IndexError
            return Header(json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), data[at : at + MARK], at + MARK)
        except IndexError:
            more = f.read(PIECE)
            if not more:
                raise ValueError(f"{name} ends within its header") from None
            data += more


def blocks(f, head: Header, start: int, end: int, name: str) -> Iterator[tuple[int, bytes]]:
    """The numbers of values and the inflated bytes of the blocks whose marker begins in a range of an open file."""
    at = max(start, head.end - MARK)
    f.seek(at)
    data = b""
    while (found := data.find(head.marker)) < 0:  # the first marker of the range
        more = f.read(PIECE)
        if not more:
            return
        kept = data[-(MARK - 1) :]
        at += len(data) - len(kept)
        data = kept + more
    while at + found < end:
        at, data = at + found + MARK, data[found + MARK :]
        while True:
            try:
                count, here = number(data, 0)
                size, here = number(data, here)
                if here + size + MARK <= len(data):
                    break
            except IndexError:
                pass
            more = f.read(PIECE)
            if not more:
                if not data:
                    return
                raise ValueError(f"{name} ends within a block")
            data += more
        body, found = data[here : here + size], here + size
        if data[found : found + MARK] != head.marker:
            raise ValueError(f"{name} has a broken block")
        if head.codec == "deflate":
            body = zlib.decompress(body, -15)
        elif head.codec != "null":
            raise ValueError(f"{name} is compressed with {head.codec}; null and deflate are read")
        yield count, body


def batches(f, start: int, end: int, name: str, wanted: T.StructType, text: bool, double_as_string: bool) -> Iterator[pa.RecordBatch]:
    """The records of a range of an open file with the columns of ``wanted``."""
    head, arrow = header(f, name), to_arrow_schema(wanted)
    kind, rows, size = Schema(head.schema, text, double_as_string).kind, [], 0
    for count, body in blocks(f, head, start, end, name):
        at = 0
        for _ in range(count):
            before = at
            row, at = kind.read(body, at)
            rows.append(row)
            size += at - before
            if len(rows) == ROWS or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, arrow)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class AvroReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[Range]:
        step = int(self.options.get("split", SPLIT))
        found = files_below(self.options["path"], self.options.get("glob", "*.avro"))[1]
        return [Range(f.path, at, min(f.size, at + step)) for f in found for at in range(0, f.size, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with place(self.options["path"])[0].open_input_file(partition.path) as f:
                yield from batches(f, partition.start, partition.end, partition.path, self.schema, flag(self.options, "text"), flag(self.options, "double_as_string"))


@dataclass
class Part(WriterCommitMessage):
    path: str


def avro_type(kind: T.DataType, path: str) -> object:
    """Spark's type as Avro's, records named by their place."""
    plain = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes", T.NullType: "null"}
    logical = {T.DateType: ("int", "date"), T.TimestampType: ("long", "timestamp-micros"), T.TimestampNTZType: ("long", "local-timestamp-micros")}
    if type(kind) in plain:
        return plain[type(kind)]
    if type(kind) in logical:
        return dict(zip(("type", "logicalType"), logical[type(kind)]))
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    maybe = lambda t, p: inner if (inner := avro_type(t, p)) == "null" else ["null", inner]
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": maybe(kind.elementType, f"{path}_item")}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": maybe(kind.valueType, f"{path}_value")}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": path, "fields": [{"name": f.name, "type": maybe(f.dataType, f"{path}_{f.name}")} for f in kind.fields]}
    raise ValueError(f"{path}: {kind.simpleString()} has no Avro type")


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encoded(value: object, kind: T.DataType, nullable: bool = True) -> bytes:
    """A value as ``avro_type`` says, within a union with null unless it is the whole record."""
    if isinstance(kind, T.NullType):
        return b""
    if value is None:
        return b"\x00"
    head = b"\x02" if nullable else b""
    sized = lambda b: zigzag(len(b)) + b
    if isinstance(kind, T.BooleanType):
        return head + (b"\x01" if value else b"\x00")
    if isinstance(kind, T.IntegralType):
        return head + zigzag(value)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return head + struct.pack("<f" if isinstance(kind, T.FloatType) else "<d", value)
    if isinstance(kind, T.StringType | T.BinaryType):
        return head + sized(value.encode() if isinstance(value, str) else bytes(value))
    if isinstance(kind, T.DateType):
        return head + zigzag((value - EPOCH.date()).days)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        start = EPOCH if value.tzinfo else EPOCH.replace(tzinfo=None)
        return head + zigzag((value - start) // datetime.timedelta(microseconds=1))
    if isinstance(kind, T.DecimalType):
        sign, digits, exponent = value.as_tuple()
        n = int("".join(map(str, digits))) * 10 ** (exponent + kind.scale) * (-1 if sign else 1)
        return head + sized(n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))
    if isinstance(kind, T.ArrayType):
        return head + (zigzag(len(value)) + b"".join(encoded(v, kind.elementType) for v in value) if value else b"") + b"\x00"
    if isinstance(kind, T.MapType):
        pairs = list(value.items() if isinstance(value, dict) else value)
        return head + (zigzag(len(pairs)) + b"".join(sized(k.encode()) + encoded(v, kind.valueType) for k, v in pairs) if pairs else b"") + b"\x00"
    return head + b"".join(encoded(value[f.name], f.dataType) for f in kind.fields)


class AvroWriter(DataSourceArrowWriter):
    """Files are written to a hidden folder and moved into place by the commit."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.options, self.schema, self.overwrite, self.job = options, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = place(self.options["path"])
        path, marker, deflate = f"{root}/.{self.job}/{uuid.uuid4().hex}.avro", uuid.uuid4().bytes, self.options.get("codec", "deflate") == "deflate"
        fs.create_dir(f"{root}/.{self.job}")
        meta = {"avro.schema": json.dumps(avro_type(self.schema, "record")).encode(), "avro.codec": b"deflate" if deflate else b"null"}
        sized = lambda b: zigzag(len(b)) + b
        with fs.open_output_stream(path) as out:
            out.write(MAGIC + zigzag(len(meta)) + b"".join(sized(k.encode()) + sized(v) for k, v in meta.items()) + b"\x00" + marker)

            def block(rows: list[bytes]) -> None:
                body = b"".join(rows)
                if deflate:
                    squeeze = zlib.compressobj(wbits=-15)
                    body = squeeze.compress(body) + squeeze.flush()
                out.write(zigzag(len(rows)) + sized(body) + marker)

            rows, size = [], 0
            for batch in iterator:
                for row in batch.to_pylist():
                    rows.append(encoded(row, self.schema, nullable=False))
                    size += len(rows[-1])
                    if size >= int(self.options.get("block", BLOCK)):
                        block(rows)
                        rows, size = [], 0
            if rows:
                block(rows)
        return Part(path)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = place(self.options["path"])
        if self.overwrite:
            for info in files_below(self.options["path"])[1]:
                fs.delete_file(info.path)
        for i, m in enumerate(m for m in messages if m is not None):
            fs.move(m.path, f"{root}/part-{i:05}-{self.job}.avro")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = place(self.options["path"])
        if fs.get_file_info(f"{root}/.{self.job}").type.name != "NotFound":
            fs.delete_dir(f"{root}/.{self.job}")


class AvroFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avro_files"

    def schema(self) -> T.StructType:
        fs, found = files_below(self.options["path"], self.options.get("glob", "*.avro"))
        if not found:
            raise ValueError(f"no Avro files below {self.options['path']}")
        with fs.open_input_file(found[0].path) as f:
            return Schema(header(f, found[0].path).schema, flag(self.options, "text"), flag(self.options, "double_as_string")).kind.spark

    def reader(self, schema: T.StructType) -> AvroReader:
        return AvroReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AvroFiles)


def read_avro(spark: SparkSession, path: str, glob: str = "*.avro", split: int = SPLIT, text: bool = False, double_as_string: bool = False) -> DataFrame:
    """The records of the Avro files at or below ``path``.

    Where tasks can't read ranges of files by themselves, because only Spark's readers reach the store, a file is one task's.
    """
    if reachable(path):
        register(spark)
        return spark.read.format("avro_files").options(path=path, glob=glob, split=str(split), text=str(text), double_as_string=str(double_as_string)).load()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    first = raw.orderBy("path").limit(1).first()
    if first is None:
        raise ValueError(f"no Avro files below {path}")
    schema = Schema(header(io.BytesIO(first.content), first.path).schema, text, double_as_string).kind.spark

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                yield from batches(io.BytesIO(data), 0, len(data), name, schema, text, double_as_string)

    return raw.mapInArrow(run, schema)

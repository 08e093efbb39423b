"""A store of document chunks that batches are written to whole: ``df.write.format("chunk_index")``.

A row deletes a record's chunks (``op`` is ``delete``) or adds one (``insert``). Deletes of a batch come before its
inserts. Tasks write their rows to files of their own; only the commit, a manifest that is written beside the
older ones and moved into place, makes them part of the store. So readers see a batch whole or not at
all, a failed batch leaves no file, and files of lost or repeated tasks are removed. The option ``batch`` names a
batch: one that was committed before changes nothing, so a stream or a job can be run again.

Options: ``folder``; ``batch``; ``reset``, a JSON list of streams that are emptied first (those that are
overwritten). The manifest lists files and grows with batches; ``compacted`` rewrites the store as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weirflow.functions.text import normal_key
from weirflow.sources.store import files_below, place

CHUNK = "stream string, record_id string, chunk int, content string, embedding array<float>, metadata map<string,string>"
ROW = f"op string, {CHUNK}"
#: Rows that a task writes as one group.
GROUP = 10_000


def primary_key(stream: dict) -> list[str] | None:
    """The key columns of a catalogue's stream: those its source defines, else those configured; None without any."""
    keys = stream.get("source_defined_primary_key") or stream.get("primary_key")
    if not keys:
        return None
    nested = [k for k in keys if len(k) != 1]
    if nested:
        raise ValueError(f"keys within nested fields aren't supported: {nested}")
    return [normal_key(k[0]) for k in keys]


def stream_named(catalog: list[dict], name: str) -> dict:
    """The one stream of a catalogue with a name."""
    found = [s for s in catalog if s["name"] == name]
    if len(found) != 1:
        raise ValueError(f"{len(found)} streams are named {name}, of {sorted(s['name'] for s in catalog)}")
    return found[0]


def replaced(catalog: list[dict]) -> list[str]:
    """The streams that a load empties first."""
    return [s["name"] for s in catalog if s.get("mode") == "overwrite"]


@dataclass
class Written(WriterCommitMessage):
    """A task's file and its numbers of rows."""

    path: str
    inserts: int
    deletes: int


def manifests(folder: str) -> list[dict]:
    """The committed batches, oldest first."""
    fs, _ = place(folder)
    out = []
    for info in files_below(f"{folder}/manifests", "*.json")[1]:
        with fs.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: m["version"])


class IndexWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, batch: str, reset: list[str]) -> None:
        self.folder, self.batch, self.reset = folder, batch, reset
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.folder)
        fs.create_dir(f"{root}/data/{self.job}")
        path, writer, counts = f"{root}/data/{self.job}/{uuid.uuid4().hex}.parquet", None, {"insert": 0, "delete": 0}
        try:
            for batch in iterator:
                ops = batch.column(batch.schema.get_field_index("op")).to_pylist()
                if wrong := set(ops) - counts.keys():
                    raise ValueError(f"op is insert or delete, not {wrong}")
                for op in ops:
                    counts[op] += 1
                writer = writer or pq.ParquetWriter(path, batch.schema, filesystem=fs, compression="zstd")
                writer.write_batch(batch, row_group_size=GROUP)
        finally:
            if writer:
                writer.close()
        return Written(path if writer else "", counts["insert"], counts["delete"])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = place(self.folder)
        known = manifests(self.folder)
        if any(m["batch"] == self.batch for m in known):
            return self.abort(messages)
        files = sorted(m.path for m in messages if m is not None and m.path)
        for info in files_below(f"{self.folder}/data/{self.job}")[1]:
            if info.path not in files:  # of a task that was lost after it had written
                fs.delete_file(info.path)
        version = known[-1]["version"] + 1 if known else 1
        fs.create_dir(f"{root}/manifests")
        entry = {"version": version, "batch": self.batch, "reset": self.reset, "files": [f.removeprefix(f"{root}/") for f in files]}
        entry |= {k: sum(getattr(m, k) for m in messages if m is not None) for k in ("inserts", "deletes")}
        with fs.open_output_stream(f"{root}/manifests/.{self.job}") as f:
            f.write(json.dumps(entry).encode())
        fs.move(f"{root}/manifests/.{self.job}", f"{root}/manifests/{version:012}.json")
        return None

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = place(self.folder)
        if fs.get_file_info(f"{root}/data/{self.job}").type.name != "NotFound":
            fs.delete_dir(f"{root}/data/{self.job}")


class ChunkIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_index"

    def schema(self) -> str:
        return ROW

    def writer(self, schema: StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options["folder"], self.options.get("batch") or uuid.uuid4().hex, json.loads(self.options.get("reset") or "[]"))


def operations(chunks: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The rows of a batch: every record that ``chunks`` (``CHUNK``) or ``deleted`` (stream, record_id) names is deleted, then its chunks are added."""
    kinds = [(f.name, f.dataType) for f in StructType.fromDDL(CHUNK).fields]
    added = chunks.select(F.lit("insert").alias("op"), *((F.col(n) if n in chunks.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds))
    gone = chunks.select("stream", "record_id").distinct()
    if deleted is not None:
        gone = gone.unionByName(deleted.select("stream", "record_id")).distinct()
    return added.unionByName(gone.select(F.lit("delete").alias("op"), *((F.col(n) if n in ("stream", "record_id") else F.lit(None)).cast(t).alias(n) for n, t in kinds)))


def write_batch(rows: DataFrame, folder: str, batch: str, reset: list[str] = ()) -> None:
    """Writes a batch of ``operations``; one that was written before changes nothing."""
    rows.sparkSession.dataSource.register(ChunkIndex)
    rows.select(*StructType.fromDDL(ROW).fieldNames()).write.format("chunk_index").options(folder=folder, batch=batch, reset=json.dumps(list(reset))).mode("append").save()


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks (``CHUNK``) of the store as of the newest whole batch.

    A chunk lives unless a later batch deleted its record or emptied its stream; a batch's own deletes come before it.
    """
    batches = manifests(folder)
    base = folder.rstrip("/")
    parts = [(m["version"], [f"{base}/{f}" for f in m["files"]]) for m in batches if m["files"]]
    if not parts:
        return spark.createDataFrame([], CHUNK)
    job = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    jobs = F.create_map(*[F.lit(x) for v, files in parts for x in (files[0].split("/")[-2], v)])
    rows = spark.read.schema(ROW).parquet(*(f for _, files in parts for f in files)).withColumn("version", jobs[job])
    emptied: dict[str, int] = {}
    for m in batches:
        emptied |= dict.fromkeys(m["reset"], m["version"])
    kept = rows.where("op = 'insert'")
    if emptied:
        bound = F.create_map(*[F.lit(x) for pair in emptied.items() for x in pair])
        kept = kept.where(F.coalesce(F.col("version") >= F.try_element_at(bound, F.col("stream")), F.lit(True)))
    deletes = rows.where("op = 'delete'").groupBy("stream", "record_id").agg(F.max("version").alias("gone"))
    same = kept.stream.eqNullSafe(deletes.stream) & kept.record_id.eqNullSafe(deletes.record_id) & (kept.version < deletes.gone)
    return kept.join(deletes, same, "left_anti").select(*StructType.fromDDL(CHUNK).fieldNames())


def compacted(spark: SparkSession, folder: str, into: str) -> None:
    """The live chunks of a store as a new store of one batch."""
    rows = live(spark, folder)
    write_batch(rows.select(F.lit("insert").alias("op"), "*"), into, "compacted")

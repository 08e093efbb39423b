"""Files copied as they are: by tasks, in pieces, each whole in its place or not there at all."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirflow.sources.store import files_below, place

#: The largest file that is copied, and the bytes that a task holds at a time.
LIMIT, PIECE = 1_500_000_000, 4 << 20
COPIED = "source string, file_path string, bytes long, modified timestamp, sha256 string"


def transfer(spark: SparkSession, source: str, target: str, glob: str = "*", limit: int = LIMIT, keep_folders: bool = True) -> DataFrame:
    """Copies the files at or below ``source`` whose names match to ``target``; a row (``COPIED``) a file, with its path below ``target``.

    The copy is done when this returns. A file over ``limit`` bytes, or two that would have one name without
    their folders, fail before anything is copied. A task writes to a hidden folder and moves a file into
    place when it is whole; what a failed task leaves there is removed.
    """
    fs, found = files_below(source, glob)
    root = place(source)[1]
    named = [(f, f.path[len(root) :].lstrip("/") or f.base_name) if keep_folders else (f, f.base_name) for f in found]
    large = [f.path for f in found if f.size > limit]
    if large:
        raise ValueError(f"larger than {limit} bytes: {large[:5]}")
    twice = len(named) - len({n for _, n in named})
    if twice:
        raise ValueError(f"{twice} files would take a name that another has; keep their folders")
    job = f".transfer-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, _), (there, top) = place(source), place(target)
        for batch in batches:
            for row in batch.to_pylist():
                held, goal = f"{top}/{job}/{uuid.uuid4().hex}", f"{top}/{row['name']}"
                there.create_dir(f"{top}/{job}")
                digest, size = hashlib.sha256(), 0
                with here.open_input_stream(row["path"]) as f, there.open_output_stream(held) as out:
                    while data := f.read(PIECE):
                        digest.update(data)
                        size += len(data)
                        if size > limit:  # it has grown since it was listed
                            raise ValueError(f"larger than {limit} bytes: {row['path']}")
                        out.write(data)
                there.create_dir(goal.rpartition("/")[0])
                there.move(held, goal)
                done = {"source": row["path"], "file_path": row["name"], "bytes": size, "modified": row["modified"], "sha256": digest.hexdigest()}
                yield pa.RecordBatch.from_pylist([done], pa.schema([("source", pa.string()), ("file_path", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("sha256", pa.string())]))

    rows = [(f.path, n, f.mtime) for f, n in named]
    files = spark.createDataFrame(rows, "path string, name string, modified timestamp").repartition(max(1, min(len(rows), 10_000)))
    try:
        done = files.mapInArrow(copy, COPIED).collect()  # a row a file, as the listing had
    finally:
        store, top = place(target)
        if store.get_file_info(f"{top}/{job}").type.name != "NotFound":
            store.delete_dir(f"{top}/{job}")
    return spark.createDataFrame(done, COPIED)

"""Tables in the shared folder, row locators, and joins whose small side is measured.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, which
every executor and the driver reach, so a lost executor costs a re-read and no
lineage. Results are lazy and read these tables, so they stay until the caller, having
used the results, calls ``discard``. Where the setting is unset, a temporary folder stands in for it, and only
with a local master.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows, and only when its rows have a bounded width.
BROADCAST_ROWS = 200_000
#: Rows of texts that pass to Python at once, where the session doesn't say.
TEXT_ROWS, BATCH_ROWS = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Folders made so far, by application.
_made: dict[str, list[str]] = {}


def discard(spark: SparkSession) -> None:
    """Removes the tables that this application has written here; results that read them are no use afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def made(spark: SparkSession) -> list[str]:
    """The folders that this application has made here and not discarded."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def discard_some(spark: SparkSession, folders: list[str], read: DataFrame) -> list[str]:
    """Removes ``folders``, but for those that ``read`` still reads, which it returns."""
    files = read.inputFiles()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names = {f.rstrip("/").rsplit("/", 1)[-1]: f for f in folders}
    used = {part for f in files for part in f.split("/")}
    for name, path in names.items():
        if name not in used:
            if path in (held := _made.get(spark.sparkContext.applicationId, [])):
                held.remove(path)
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    return [path for name, path in names.items() if name in used]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weirflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once, kept as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> int | None:
    """The rows of ``df``, None for more than ``rows``."""
    count = df.limit(rows + 1).count()
    return count if count <= rows else None


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``rows`` rows, else as it is.

    ``df`` must be a written table of narrow rows: beyond the bound the join is an
    ordinary shuffle join, which adaptive execution splits where a key is hot.
    """
    return F.broadcast(df) if small(df, rows) is not None else df


def for_python(texts: DataFrame) -> DataFrame:
    """``texts``, in a session whose Arrow batches are small enough for long texts.

    A session that sets their size keeps it; the default is made for short rows, and a
    batch of texts lies in memory several times, in the executor and in its worker.
    """
    conf = texts.sparkSession.conf
    if conf.get(BATCH_ROWS, None) is None:
        conf.set(BATCH_ROWS, TEXT_ROWS)
    return texts


def as_scan(docs: DataFrame) -> DataFrame:
    """``docs`` if it scans Parquet files, else the same rows written as a table."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return written(docs, "docs")
    return docs


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with ``__file`` and ``__row``, where each row lies in its Parquet file.

    The two survive a second scan, so they identify rows whose ids are null or
    repeated. A DataFrame that isn't a file scan is first written as a table.
    """
    docs = for_python(as_scan(docs))
    return docs.select(*columns, *place(docs))


def place(docs: DataFrame) -> list[Column]:
    """``__file`` and ``__row`` of a file scan, also where a column of its own is called ``_metadata``."""
    at = docs.metadataColumn("_metadata")
    return [at["file_path"].alias("__file"), at["row_index"].alias("__row")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, whatever their names, in one struct ``whole``, with ``__file`` and ``__row``."""
    docs = as_scan(docs)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), *place(docs))


def row_key() -> list[Column]:
    """``__file`` and ``__row`` of :func:`located` as two narrow columns."""
    return [F.xxhash64("__file").alias("file_key"), F.col("__row").alias("row_key")]

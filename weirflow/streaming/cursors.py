"""Streams whose checkpoints take the place of sync state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def partition_cursors(stream: DataFrame, keys: list[str], cursor: str) -> DataFrame:
    """The largest cursor and the number of records of each partition so far; write it in update mode."""
    return stream.groupBy(*keys).agg(F.max(cursor).alias("cursor"), F.count("*").alias("n"))


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, lookback: str) -> DataFrame:
    """Records that a lookback reads again are dropped, as long as they come within it."""
    return stream.withWatermark(event_time, lookback).dropDuplicatesWithinWatermark(keys)


def rate_windows(stream: DataFrame, event_time: str, window: str, lateness: str) -> DataFrame:
    """Calls in each window; late ones within ``lateness`` count."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window)).agg(F.count("*").alias("calls"))


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions of a table, oldest first, as Spark's file system lists them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    whole = lambda v: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}/_SUCCESS"))
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(v for v in found if whole(v))


#: The number of the one bucket of a table that isn't cut, which lies in its version's folder itself.
UNCUT = -1


def bucket_path(table: str, version: int, bucket: int) -> str:
    return f"{table}/v={version}" if bucket == UNCUT else f"{table}/v={version}/bucket={bucket}"


def buckets_of(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The whole versions that hold each bucket of a table, oldest first."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for v in versions(spark, table):
        names = [status.getPath().getName() for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}"))]
        for b in [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")] or [UNCUT]:
            out.setdefault(b, []).append(v)
    return out


def newest(spark: SparkSession, table: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a table that ``merge_into`` writes: of each bucket those of its newest version."""
    held = buckets_of(spark, table)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = [bucket_path(table, v[-1], b) for b, v in sorted(held.items())]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def merge_into(stream: DataFrame, table: str, keys: list[str], checkpoint: str, latest: str, buckets: int = 1) -> StreamingQuery:
    """Upserts every batch into a Parquet table by key, the row with the largest ``latest`` of a key, nulls least; a repeated batch changes nothing.

    Rows lie in ``buckets`` by a hash of their key, and a batch rewrites only those it touches, as a new version
    ``table/v=<number>/bucket=<number>`` (a single bucket lies in ``table/v=<number>``); ``newest`` reads the table. A bucket's version two back is removed, so a
    reader that has begun can end. A new checkpoint goes on from what the table holds. The number of buckets stays that of the first batch.
    """
    order, place = F.struct(F.col(latest).isNotNull(), latest), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        spark, fresh = batch.sparkSession, batch.withColumn("bucket", place)
        cut = buckets > 1
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect()) if cut else [UNCUT]  # ``buckets`` at most
        if not touched:
            return
        held = buckets_of(spark, table)
        old = [bucket_path(table, held[b][-1], b) for b in touched if b in held]
        rows = spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", place).unionByName(fresh) if old else fresh
        rest = F.struct(*(c for c in batch.columns if c not in keys))
        merged = rows.groupBy("bucket", *keys).agg(F.max_by(rest, order).alias("r")).select("bucket", *keys, "r.*").select("bucket", *batch.columns)
        whole = versions(spark, table)
        target = f"{table}/v={whole[-1] + 1 if whole else 0}"
        if cut:
            merged.write.partitionBy("bucket").mode("overwrite").parquet(target)
        else:
            merged.drop("bucket").write.mode("overwrite").parquet(target)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b in touched:
            for v in held.get(b, [])[:-1]:
                held[b].remove(v)
                gone = jvm.org.apache.hadoop.fs.Path(bucket_path(table, v, b))
                gone.getFileSystem(conf).delete(gone, True)
        for v in whole[:-1]:
            if not any(v in vs for vs in held.values()):
                gone = jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}")
                gone.getFileSystem(conf).delete(gone, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``write`` on every batch of what is there now."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

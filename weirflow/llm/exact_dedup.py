"""Exact deduplication as a stateful stream whose keyed state never expires.

Every row becomes a log entry: digest of the text, stable identifier, and locator
(Parquet file and row) of the content. A Structured Streaming aggregation over the
log keeps one state row for each digest in RocksDB: the entry that stays and the
number of entries. A digest with more than one entry is a hit; the texts of hits
are then read again and compared in full, by grouping on the bytes themselves, so
that a digest shared by different texts is told apart.

Only DataFrame operations run here. Hot groups are combined before each shuffle,
and the join that returns the outcome to the rows has plain tables on both sides,
so adaptive execution can split a hot digest.

Edge cases: a null text counts as empty; of equal texts the row with the largest
``doc_id`` stays, nulls last; rows that repeat the id as well are told apart by
their locator, the largest stays; an empty table gives no rows; columns of other
names are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.storage import as_scan, located, shared_folder, small_or_plain, whole_rows, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition reserves megabytes
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def stayer() -> Column:
    """The entry that stays: largest id, then largest locator."""
    return F.max(F.struct("doc_id", "__file", "__row")).alias("keeper")


def stream_state(spark: SparkSession, log_path: str, log: DataFrame, files_per_batch: int) -> DataFrame:
    """For each digest of the log, the entry that stays and the number of entries, from the stream's state."""
    out = shared_folder(spark, "dedup-state")
    states = log.select("digest", "doc_id", "__file", "__row").groupBy("digest").agg(stayer(), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
        state = stream.groupBy("digest").agg(stayer(), F.count("*").alias("n"))
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
            .option("checkpointLocation", shared_folder(spark, "dedup-stream"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not query.lastProgress:  # an empty log starts no batch
        return states
    updates = spark.read.option("basePath", out).schema(f"{ddl(states)}, epoch long").parquet(out)
    return updates.groupBy("digest").agg(F.max(F.struct("epoch", "keeper", "n")).alias("s")).select("digest", "s.keeper", "s.n")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest, __file, __row."""
    spark = docs.sparkSession
    placed = located(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    placed = placed.withColumn("digest", digest(F.col("text")))
    path = shared_folder(spark, "dedup-log")
    placed.drop("text").write.parquet(path)
    log = spark.read.schema(placed.drop("text").schema).parquet(path)

    states = stream_state(spark, path, log, files_per_batch)
    hits = written(states.where("n > 1").select("digest"), "dedup-hits")
    texts = placed.join(small_or_plain(hits), "digest", "left_semi")
    classes = written(texts.groupBy("digest", "text").agg(stayer(), F.count("*").alias("group_size")), "dedup-classes")
    shared = classes.groupBy("digest").agg(F.count("*").alias("texts"))
    clashes = written(shared.where("texts > 1").select("digest"), "dedup-clashes")

    plain = written(classes.drop("text").join(small_or_plain(clashes), "digest", "left_anti"), "dedup-groups")
    rest = log.join(small_or_plain(clashes), "digest", "left_anti")
    found = rest.join(plain, "digest", "left").select("doc_id", "__file", "__row", "digest", "keeper", "group_size")
    told = placed.join(small_or_plain(clashes), "digest", "left_semi").join(classes, ["digest", "text"])
    found = found.unionByName(told.select(*found.columns))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.struct("__file", "__row") == F.struct("keeper.__file", "keeper.__row"))).alias("kept"),
        "digest",
        "__file",
        "__row",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = as_scan(docs)
    dropped = written(deduplicate(docs).where("not kept").select("__file", "__row"), "dedup-dropped")
    return whole_rows(docs).join(small_or_plain(dropped), ["__file", "__row"], "left_anti").select("whole.*")

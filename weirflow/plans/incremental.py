"""An incremental sync from state to state: what to read, the records that belong to it, and the state afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.state import merge_intervals
from weirflow.plans.slices import null_safe, unsynced


def sync(
    records: DataFrame, state: DataFrame, keys: list[str], cursor: str, start: Column, end: Column, step: int = 1, lookback: int = 0, partitions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The records to load and the new state.

    ``state`` holds merged intervals (keys, ``start``, ``end``) that were read. Of every partition
    (those of ``state`` and of ``partitions``) the gaps between ``start`` and ``end`` are read, and a
    lookback before its last end again. A record belongs to the slice its cursor lies in; one without a
    cursor is loaded where its partition has any slice. Null keys are a partition like others. A slice that was read is closed as a whole,
    also where it held no record; ``most_recent`` is the largest cursor seen in an interval.
    """
    pending = unsynced(state, keys, start, end, step, lookback, partitions)
    slices = pending.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__start"), F.col("end").alias("__end"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    inside = F.col(cursor).between(F.col("__start"), F.col("__end"))
    met = records.join(slices, [*same, inside])
    asked = pending.select(*keys).distinct()
    undated = records.join(asked, null_safe(records, asked, keys), "left_semi").where(F.col(cursor).isNull())
    last = met.groupBy(*(f"__{k}" for k in keys), "__start", "__end").agg(F.max(cursor).alias("__last"))
    found = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    fresh = pending.join(last, [*found, F.col("start") == F.col("__start"), F.col("end") == F.col("__end")], "left").select(*keys, "start", "end", F.col("__last").alias("most_recent"))
    before = state if "most_recent" in state.columns else state.withColumn("most_recent", F.lit(None).cast(records.schema[cursor].dataType))
    read = before.select(*keys, "start", "end", "most_recent").unionByName(fresh)
    dated = met.select(*records.columns)
    return dated.unionByName(undated.select(*records.columns)), merge_intervals(read, keys, step=step, most_recent="most_recent")

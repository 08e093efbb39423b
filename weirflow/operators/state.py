"""Sync state: intervals, cursors by partition, inference over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", step: int = 0, most_recent: str | None = None) -> DataFrame:
    """Intervals of each key that overlap or lie within ``step`` united; the largest ``most_recent`` is kept."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    fresh = (reach.isNull() | (F.col(start) > reach + step)).cast("int")
    rows = df.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(upto))
    aggs = [F.min(start).alias(start), F.max(end).alias(end)] + ([F.max(most_recent).alias(most_recent)] if most_recent else [])
    return rows.groupBy(*keys, "__island").agg(*aggs).drop("__island")


def interval_gaps(merged: DataFrame, keys: list[str], start: str = "start", end: str = "end", step: int = 1) -> DataFrame:
    """What lies between the merged intervals of each key."""
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    rows = merged.withColumn("__next", after).where(F.col("__next") > F.col(end) + step)
    return rows.select(*keys, (F.col(end) + step).alias("gap_start"), (F.col("__next") - step).alias("gap_end"))


def max_cursor(df: DataFrame, keys: list[str], cursor: str) -> DataFrame:
    """The largest cursor of each partition, and of all in a row whose keys are null and ``is_global`` is true."""
    rows = df.rollup(*keys).agg(F.max(cursor).alias("cursor"), F.grouping_id().alias("__level"))  # one pass
    every = (1 << len(keys)) - 1
    return rows.where(F.col("__level").isin(0, every)).select(*keys, "cursor", (F.col("__level") == every).alias("is_global"))


def record_counts(df: DataFrame, stream: list[str]) -> DataFrame:
    """Records of each stream, as the floating-point count that sync state carries."""
    return df.groupBy(*stream).agg(F.count("*").cast("double").alias("n"))


def repeated(df: DataFrame, name: str) -> DataFrame:
    """Values of ``name`` that more than one row has, and how many rows."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def inferred_schema(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """The schema, nested and merged over all records, of a column of JSON text; records that don't parse are left out."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("schema"))


def is_ascending(df: DataFrame, keys: list[str], position: str, cursor: str) -> DataFrame:
    """Whether the cursor never falls in the order of ``position``."""
    before = F.lag(cursor).over(Window.partitionBy(*keys).orderBy(position))
    return df.select(*keys, F.coalesce(F.col(cursor) >= before, F.lit(True)).alias("fine")).groupBy(*keys).agg(F.every("fine").alias("ascending"))


def rollup_status(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """One status of many: failed, else timed_out, else running, else completed or (all of them) skipped."""
    some = lambda s: F.bool_or(F.col(status) == s)
    rolled = F.when(some("failed"), "failed").when(some("timed_out"), "timed_out").when(some("running"), "running").when(F.every(F.col(status) == "skipped"), "skipped").otherwise("completed")
    return df.groupBy(*keys).agg(rolled.alias("status"))


def inferred_type(value: Column) -> Column:
    """An aggregate: boolean, integer, number or string, the first that all values fit; string of nothing but nulls."""
    text = F.trim(value)
    fits = lambda ok: F.coalesce(F.every(F.when(value.isNotNull(), ok)), F.lit(False))
    boolean = F.lower(text).isin("true", "false", "yes", "no", "y", "n", "t", "f", "on", "off", "1", "0")
    return F.when(fits(boolean), "boolean").when(fits(text.try_cast("bigint").isNotNull()), "integer").when(fits(text.try_cast("double").isNotNull()), "number").otherwise("string")


def formats_that_fit(value: Column, formats: list[str]) -> list[Column]:
    """Aggregates, one for each Java date pattern: whether all values parse by it; a null doesn't."""
    return [F.every(F.coalesce(F.try_to_timestamp(value, F.lit(f)).isNotNull(), F.lit(False))).alias(f"fits_{i}") for i, f in enumerate(formats)]


def start_from_state(slices: Column, configured: Column, zero: Column) -> Column:
    """Where a sync starts: the first slice's most recent value, else its end, else the configured start, else zero."""
    first = F.try_element_at(slices, F.lit(1))
    return F.coalesce(first["most_recent"], first["end"], configured, zero)


def legacy_to_partitions(state: Column, key: str, cursor: str) -> Column:
    """A map from partition to cursor as a list of partition and cursor."""
    return F.transform(F.map_entries(state), lambda e: F.struct(F.create_map(F.lit(key), e.key).alias("partition"), F.create_map(F.lit(cursor), e.value).alias("cursor")))


def evict(history: DataFrame, most: int, uri: str = "uri", modified: str = "last_modified") -> DataFrame:
    """The newest ``most`` files of a history, by time and name."""
    return history.orderBy(F.desc(modified), F.desc(uri)).limit(most)

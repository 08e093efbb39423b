"""Slice generation as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def single(spark: SparkSession) -> DataFrame:
    """One slice without fields."""
    return spark.range(1).select()


def listed(spark: SparkSession, field: str, values: list) -> DataFrame:
    """One slice a value, in order, repeats kept."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["position", field])


def product(*slices: DataFrame) -> DataFrame:
    """All combinations of slice lists; of a field that several have the first list's holds. The lists are configured, not data."""
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.crossJoin(b.drop(*(c for c in b.columns if c in a.columns)))

    return reduce(both, slices)


def union_first(slices: list[DataFrame], field: str, position: str = "position") -> DataFrame:
    """Slices one list after another; of those with one value of ``field`` the first stays, other fields go to ``extra``."""
    named = [s.select(F.lit(i).alias("child"), position, field, F.to_json(F.struct(*(c for c in s.columns if c not in (field, position)))).alias("extra")) for i, s in enumerate(slices)]
    rank = F.row_number().over(Window.partitionBy(field).orderBy("child", position))
    return reduce(DataFrame.unionByName, named).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def grouped(slices: DataFrame, field: str, order: list[str], size: int, distinct: bool = True, partition: list[str] = ()) -> DataFrame:
    """Batches of ``size`` values in order, first occurrences only if ``distinct``: partition, batch, values, n."""
    if distinct:
        first = F.row_number().over(Window.partitionBy(*partition, field).orderBy(*order))
        slices = slices.withColumn("__first", first).where("__first = 1")
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    rows = slices.select(*partition, ((at - 1) / size).cast("long").alias("batch"), F.struct(at.alias("at"), F.col(field).alias("v")).alias("x"))
    return rows.groupBy(*partition, "batch").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.v).alias("values"), F.count("*").alias("n"))


def ranges(start: Column, end: Column, step: str, granularity: str) -> Column:
    """An array of ranges of one step from start to end; all but the last end one granularity before the next."""
    starts = F.sequence(start, end, F.expr(f"INTERVAL {step}"))
    ends = F.transform(starts, lambda s: s + F.expr(f"INTERVAL {step}") - F.expr(f"INTERVAL {granularity}"))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(x["s"].alias("start"), F.least(x["e"], end).alias("end")))


def range_slices(df: DataFrame, start: str, end: str, step: str, granularity: str) -> DataFrame:
    """One row a range; nothing where start is after end."""
    rows = df.where(F.col(start) <= F.col(end))
    return rows.withColumn("slice", F.explode(ranges(F.col(start), F.col(end), step, granularity))).select(*(c for c in df.columns), "slice.start", "slice.end") if "start" not in df.columns else rows.select(F.explode(ranges(F.col(start), F.col(end), step, granularity)).alias("slice")).select("slice.*")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Whether the keys of two DataFrames agree, nulls among them."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def unsynced(merged: DataFrame, keys: list[str], low: Column, high: Column, step: int = 1, lookback: int = 0, every: DataFrame | None = None) -> DataFrame:
    """What a sync still has to read: before the first interval, between intervals, and from the last (less a lookback) to ``high``.

    Slices don't overlap: what the lookback reads again is left out of the gaps before it.
    Keys of ``every`` without an interval were never synced and are read from ``low`` to
    ``high``; null keys are keys like others.
    """
    by = Window.partitionBy(*keys).orderBy("start")
    after, before = F.lead("start").over(by), F.lag("end").over(by)
    again = F.greatest(F.max("end").over(Window.partitionBy(*keys)) - lookback, low)
    rows = merged.withColumns({"__next": after, "__before": before, "__tail": F.when(again < high, again)})
    gap = F.array(
        F.when(F.col("__before").isNull() & (low < F.col("start")), F.struct(low.alias("start"), (F.col("start") - step).alias("end"))),
        F.when(F.col("__next") > F.col("end") + step, F.struct((F.col("end") + step).alias("start"), (F.col("__next") - step).alias("end"))),
    )
    cut = F.transform(F.array_compact(gap), lambda g: F.struct(g.start.alias("start"), F.coalesce(F.least(g.end, F.col("__tail") - step), g.end).alias("end")))
    tail = F.array_compact(F.array(F.when(F.col("__next").isNull() & F.col("__tail").isNotNull(), F.struct(F.col("__tail").alias("start"), high.alias("end")))))
    slices = F.concat(F.filter(cut, lambda g: g.start <= g.end), tail)
    out = rows.select(*keys, F.explode(slices).alias("__slice")).select(*keys, "__slice.start", "__slice.end")
    if every is None:
        return out
    asked = every.select(*keys).distinct()
    fresh = asked.join(merged.select(*keys), null_safe(asked, merged, keys), "left_anti").where(low <= high)
    return out.unionByName(fresh.select(*keys, low.alias("start"), high.alias("end")))


def pages(df: DataFrame, order: list[str], size: int, first: int = 0, partition: list[str] = ()) -> DataFrame:
    """Page number and offset of each row, as an offset or page-number reader meets them."""
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return df.withColumn("page", F.floor(at / size) + first).withColumn("offset", (F.floor(at / size) * size).cast("long"))


def property_chunks(names: list[str], limit: int, by: str = "count", always: list[str] = ()) -> list[list[str]]:
    """Column names in chunks of ``limit`` names, or of ``limit`` characters counting three more a name; ``always`` leads every chunk."""
    out, size = [[]], 0
    for name in names:
        cost = 1 if by == "count" else len(name) + 3
        if size + cost > limit:
            out.append([])
            size = 0
        out[-1].append(name)
        size += cost
    return [[*always, *chunk] for chunk in out]

"""How many calls fall in a window of time, for logs that are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed_windows(df: DataFrame, ts: Column, width: str) -> DataFrame:
    """``start`` and ``calls`` of each window of ``width`` that has calls."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "calls")


def moving_windows(df: DataFrame, keys: list[str], second: Column, width: int, into: str = "calls") -> DataFrame:
    """Each row with the calls of its key in the ``width`` seconds up to it, those of its own second included."""
    over = Window.partitionBy(*keys).orderBy("__second").rangeBetween(1 - width, 0)
    return df.withColumn("__second", second).withColumn(into, F.count("*").over(over)).drop("__second")


def over_limit(calls: Column, limit: int) -> Column:
    """Whether a call would have had to wait."""
    return calls > limit

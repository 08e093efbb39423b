"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.storage import written


def starred(links: DataFrame) -> bool:
    """Whether every node is the ``hi`` of one link or the ``lo`` of some, never both: what no step changes."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """For each node ``hi`` of a component but its smallest, that smallest node as ``lo``.

    ``links`` has columns ``hi`` and ``lo``, the larger and smaller node of each link.
    Each round is a few joins on the node; its links are written to the shared folder,
    which cuts the lineage. The number of rounds grows with the logarithm of the size; links
    that are stars already, as an earlier result is, take none.
    """
    links = written(links.where("hi > lo").distinct(), "links")
    while not starred(links):
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("least")).withColumn("least", F.least("hi", "least"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = large.join(small, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        links = written(moved.unionByName(small.withColumnRenamed("least", "lo")).distinct(), "links")
    return links

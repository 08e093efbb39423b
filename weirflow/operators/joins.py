"""Parent to child slices, merged column chunks, file history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substream(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, partition: str, extras: list[str] = ()) -> DataFrame:
    """Rows of ``child`` for each parent record that has the key, with the key as ``partition`` and ``extras`` of the parent."""
    slices = parent.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias(partition), *(F.col(e).alias(f"parent_{e}") for e in extras))
    return child.join(slices, F.col(child_key) == F.col(partition))


def substreams(parents: list[tuple[DataFrame, str]], partition: str) -> DataFrame:
    """Slices of several parents one after another."""
    return reduce(DataFrame.unionByName, [p.where(F.col(k).isNotNull()).select(F.col(k).cast("string").alias(partition)) for p, k in parents])


def merge_chunks(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of column chunks merged by key, a later chunk's value first; rows without a key stay as they are."""
    keyed = lambda d: d.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    loose = lambda d: d.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns and c not in keys]
        later = right.withColumnsRenamed({c: f"__{c}" for c in shared})
        out = left.join(later, keys, "full")
        return out.withColumns({c: F.coalesce(f"__{c}", c) for c in shared}).drop(*(f"__{c}" for c in shared)) if shared else out

    merged = reduce(both, map(keyed, chunks))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(loose, chunks), merged)


def pending_files(files: DataFrame, history: DataFrame, uri: str = "uri", modified: str = "last_modified", full: Column | None = None) -> DataFrame:
    """Files that a sync must read: new ones, and known ones that were modified since.

    ``full``, if given, is a condition for unknown files once the history is full.
    """
    known = history.select(F.col(uri).alias("__uri"), F.col(modified).alias("__modified"))
    joined = files.join(known, F.col(uri) == F.col("__uri"), "left")
    new = F.col("__uri").isNull() & (F.lit(True) if full is None else full)
    return joined.where(new | (F.col(modified) > F.col("__modified"))).drop("__uri", "__modified")


def embedded_children(parent: DataFrame, children: str, keys: list[str], fetched: DataFrame | None = None) -> DataFrame:
    """Child records that parents hold in an array of structs, and those of ``fetched``, that a reader got beyond the first page."""
    own = parent.select(*keys, F.explode(children).alias("__c")).select(*keys, "__c.*")
    return own if fetched is None else own.unionByName(fetched, allowMissingColumns=True)


def by_modified(files: DataFrame, uri: str = "uri", modified: str = "last_modified") -> DataFrame:
    """Files of one moment together, in order of name."""
    return files.groupBy(modified).agg(F.array_sort(F.collect_list(uri)).alias("uris"))

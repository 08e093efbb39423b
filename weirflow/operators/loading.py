"""Loading: append, swap, merge; documents, chunks and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(target: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null."""
    return target.unionByName(new, allowMissingColumns=True)


def swap(new: DataFrame, table: str) -> None:
    """Replaces a table."""
    new.write.mode("overwrite").saveAsTable(table)


def merge(target: DataFrame, new: DataFrame, keys: list[str], newest: Column | None = None) -> DataFrame:
    """An upsert: rows of ``target`` whose key isn't in ``new``, and one row of ``new`` for each key.

    Of rows of ``new`` with one key that with the largest ``newest`` is taken, nulls least
    (any of them without ``newest``). A null key matches nothing, so such rows are all kept.
    """
    if not keys:
        raise ValueError("a merge needs a primary key")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rest = F.struct(*(c for c in new.columns if c not in keys))
    order = F.struct(newest.isNotNull(), newest) if newest is not None else F.lit(0)
    packed = new.where(whole).select(*keys, F.struct(order.alias("__order"), rest.alias("__rest")).alias("__row"))
    taken = packed.groupBy(*keys).agg(F.max_by("__row.__rest", "__row.__order").alias("__rest")).select(*keys, "__rest.*").select(*new.columns)
    kept = target.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(taken.unionByName(new.where(~whole)), allowMissingColumns=True)


def with_load_columns(df: DataFrame, keys: list[str], extracted_at: Column) -> DataFrame:
    """Raw id, time of extraction and an empty metadata object."""
    return df.withColumns({"_raw_id": F.sha2(F.concat_ws("_", *(F.col(k).cast("string") for k in keys)), 256), "_extracted_at": extracted_at, "_meta": F.lit("{}")})


def record_id(namespace: str | None, stream: str, keys: list[str]) -> Column:
    """Namespace, stream and key of a record in one id."""
    head = "_".join(x for x in (namespace, stream) if x)
    return F.concat(F.lit(f"{head}_"), F.concat_ws("_", *(F.col(k).cast("string") for k in keys)))


def documents(df: DataFrame, text_fields: list[str], metadata: list[str], keys: list[str], stream: str, namespace: str | None = None) -> DataFrame:
    """``record_id``, ``content`` (lines of field and value) and ``metadata`` of each record."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in text_fields]
    meta = F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))])
    return df.select(record_id(namespace, stream, keys).alias("record_id"), F.concat_ws("\n", *parts).alias("content"), meta.alias("metadata"))


def chunks(df: DataFrame, text: str, size: int, overlap: int = 0, keep: list[str] = ()) -> DataFrame:
    """Runs of ``size`` words, each beginning ``overlap`` words before the last one ended: keep, chunk, content."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    step = size - overlap
    if step < 1:
        raise ValueError("the overlap must be less than the size")
    rows = df.select(*keep, words.alias("__words")).where(F.size("__words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("__words") - size) / step)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select(*keep, "chunk", F.array_join(F.slice("__words", F.col("chunk") * step + 1, F.lit(size)), " ").alias("content"))


#: Where texts of a kind are parted, before a heading or a definition.
PARTS = {"markdown": r"(?m)(?=^#{1,6} )", "python": r"(?m)(?=^(?:class|def|async def) )", "paragraphs": r"(?<=\n\n)(?=\S)", "lines": r"(?<=\n)"}


def split_chunks(df: DataFrame, text: str, size: int, kind: str = "paragraphs", keep: list[str] = ()) -> DataFrame:
    """Parts of a text put together while they fit ``size`` characters: keep, chunk, content. A longer part is cut; nothing is lost."""
    parts = F.split(F.coalesce(text, F.lit("")), PARTS.get(kind, kind))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))
    pieces = F.flatten(F.transform(F.filter(parts, lambda p: p != ""), cut))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(piece) <= size
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["open"], piece)).otherwise(piece).alias("open"))

    whole = F.aggregate(pieces, empty, add, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda c: c != ""))
    return df.select(*keep, F.posexplode(whole).alias("chunk", "content"))


def checked_embedding(vector: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and finite components only."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def write_order(deletes: list[DataFrame], inserts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Deletes of a batch together, to be written before its inserts."""
    return reduce(DataFrame.unionByName, deletes), reduce(DataFrame.unionByName, inserts)

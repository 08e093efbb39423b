"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def keep_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows whose condition is true; a condition over missing values keeps nothing."""
    return df.where(condition)


def in_range(df: DataFrame, cursor: Column, start: Column | None, end: Column | None) -> DataFrame:
    """Both ends belong to the range; a missing cursor is kept."""
    fits = F.lit(True)
    if start is not None:
        fits = fits & (cursor >= start)
    if end is not None:
        fits = fits & (cursor <= end)
    return df.where(cursor.isNull() | fits)


def route_deletes(df: DataFrame, deleted: Column, into: str = "route") -> DataFrame:
    """The rows with ``delete`` or ``load``, where each goes; in one pass."""
    return df.withColumn(into, F.when(F.coalesce(deleted, F.lit(False)), "delete").otherwise("load"))


def within_lookback(df: DataFrame, keys: list[str], cursor: str, amount: str) -> DataFrame:
    """The rows of each key that a sync with this lookback reads again: from its largest cursor less ``amount`` on."""
    last = df.groupBy(*keys).agg(F.max(cursor).alias("__last"))
    return df.join(last, list(keys)).where(F.col(cursor) >= F.col("__last") - F.expr(f"INTERVAL {amount}")).drop("__last")


#: JSON types from narrow to wide.
WIDTH = {"null": 0, "boolean": 1, "integer": 2, "number": 3, "string": 4, "object": 5}


def json_type(value: Column) -> Column:
    """The JSON type of a variant; an absent value is null."""
    kind = F.upper(F.schema_of_variant(value))
    return (
        F.when(kind.isin("BIGINT"), "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "number").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    )


def conforms(record: Column, schema: dict[str, str]) -> Column:
    """Whether a JSON object (text) has only columns of ``schema`` (name to JSON type), none wider than given. All columns are checked."""
    keys = F.json_object_keys(record)
    fits = F.coalesce(F.forall(keys, lambda k: k.isin(list(schema))), F.lit(False))
    parsed = F.try_parse_json(record)
    for name, kind in schema.items():
        got = json_type(F.try_variant_get(parsed, f"$['{name}']", "variant"))
        if kind in WIDTH:
            narrow = [k for k, w in WIDTH.items() if w <= WIDTH[kind]]
            fits = fits & (got.isNull() | got.isin(narrow))
        else:
            fits = fits & (got.isNull() | got.isin(kind, "null"))
    return fits


def enforce(df: DataFrame, record: str, schema: dict[str, str], policy: str = "skip") -> DataFrame:
    """``emit`` marks rows in ``_conforms``; ``skip`` drops those that don't conform; ``stop`` fails the job on one."""
    ok = conforms(F.col(record), schema)
    if policy == "emit":
        return df.withColumn("_conforms", ok)
    if policy == "skip":
        return df.where(ok)
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a record doesn't conform to its schema")).isNull()))


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of an order."""
    return df.orderBy(*order).limit(n)


def newest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def selected(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns that are wanted, in the order of the table."""
    return df.select(*(c for c in df.columns if c in set(wanted)))


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; arrays and structs must be equal."""
    order = [T.NullType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()]
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if a in order and b in order:
        return max(a, b, key=order.index)
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} don't merge")


def merged_schema(*schemas: T.StructType) -> T.StructType:
    """Columns of all schemas in order of appearance, each nullable and of its widest type."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            kinds[f.name] = widest(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])

"""Extraction and record transforms, each ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.text import normal_key, snake_key


def extract_json(df: DataFrame, column: str, path: str, element: str, into: str = "record") -> DataFrame:
    """One row for each element of the list at ``path`` of a JSON column, whatever the elements are.

    Another value gives one row, but none where it is missing or counts as false: null,
    false, zero, and empty text or object. Text that isn't JSON gives none.
    """
    found = F.try_variant_get(F.try_parse_json(column), path, "variant")
    shown = F.to_json(found)
    zero = ~shown.startswith('"') & (F.try_variant_get(found, "$", "double") == 0)
    counts = shown.isNotNull() & ~shown.isin("null", "false", '""', "{}") & ~F.coalesce(zero, F.lit(False))
    many = F.when(shown.startswith("["), F.try_variant_get(found, "$", "array<variant>")).when(counts, F.array(found))
    # an element that doesn't fit its type becomes null
    return df.withColumn(into, F.explode(many)).withColumn(into, F.try_variant_get(into, "$", element))


def expand(df: DataFrame, items: Column, into: str, emit_parent: bool = False, position: str | None = None) -> DataFrame:
    """A row for each item of an array; with ``emit_parent`` a row without items stays, with a null item."""
    explode = F.posexplode_outer if emit_parent else F.posexplode
    out = df.select("*", explode(items).alias("__at", into))
    return out.withColumnRenamed("__at", position) if position else out.drop("__at")


def add_fields(df: DataFrame, fields: list[tuple[str, Column | str, str | None]], when: Column | None = None) -> DataFrame:
    """Fields in order, each seeing those before it: name, expression, type or None; where ``when`` is false the old value stays."""
    for name, value, kind in fields:
        value = F.expr(value) if isinstance(value, str) else value
        value = value.cast(kind) if kind else value
        if when is not None:
            value = F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(name) if name in df.columns else None)
        df = df.withColumn(name, value)
    return df


def matching(schema: T.StructType, pattern: str) -> list[str]:
    """Dotted paths of the fields that a dotted pattern with ``*`` and ``?`` names; ``**`` stands for any number of levels."""
    step, _, rest = pattern.partition(".")
    out = matching(schema, rest) if step == "**" and rest else []
    for f in schema.fields:
        inner = f.dataType if isinstance(f.dataType, T.StructType) else None
        if step == "**":
            out += ([f"{f.name}.{p}" for p in matching(inner, pattern)] if inner else []) if rest else [f.name]
        elif fnmatchcase(f.name, step):
            out += [f.name] if not rest else [f"{f.name}.{p}" for p in matching(inner, rest)] if inner else []
    return list(dict.fromkeys(out))


def remove_fields(df: DataFrame, names: list[str], when: Column | None = None) -> DataFrame:
    """Columns or nested fields (dotted, with globs) removed, missing ones ignored; with ``when`` columns become null where it holds."""
    for name in [p for n in names for p in (matching(df.schema, n) if set(n) & set("*?[") else [n])]:
        top, _, rest = name.partition(".")
        if top not in df.columns:
            continue
        if when is not None and not rest:
            df = df.withColumn(name, F.when(~F.coalesce(when, F.lit(False)), F.col(name)))
        elif rest:
            df = df.withColumn(top, F.col(top).dropFields(rest))
        else:
            df = df.drop(name)
    return df


def renamed_keys(kind: T.DataType, rename: Callable[[str], str], nested: bool = True) -> T.DataType:
    """A schema with renamed fields, through structs but not lists; of clashing names the last wins."""
    if not isinstance(kind, T.StructType):
        return kind
    fields = {rename(f.name): T.StructField(rename(f.name), renamed_keys(f.dataType, rename) if nested else f.dataType, f.nullable) for f in kind.fields}
    return T.StructType(list(fields.values()))


def clashes(kind: T.DataType, rename: Callable[[str], str], path: str = "") -> list[str]:
    """The fields of a schema, through structs, whose new names another field takes as well."""
    if not isinstance(kind, T.StructType):
        return []
    taken = [rename(f.name) for f in kind.fields]
    out = [f"{path}{f.name}" for f, name in zip(kind.fields, taken) if taken.count(name) > 1]
    return out + [c for f in kind.fields for c in clashes(f.dataType, rename, f"{path}{f.name}.")]


def rename_keys(df: DataFrame, rename: Callable[[str], str], nested: bool = True) -> DataFrame:
    """Columns (and fields of structs) renamed; of clashing columns the last wins."""
    last = {rename(f.name): f for f in df.schema.fields}
    return df.select(*(F.col(f"`{f.name}`").cast(renamed_keys(f.dataType, rename) if nested else f.dataType).alias(name) for name, f in last.items()))


def keys_to_lower(df: DataFrame) -> DataFrame:
    return rename_keys(df, str.lower, nested=False)


def keys_to_snake(df: DataFrame) -> DataFrame:
    """Names in snake case; names that become one, or nothing, fail, so no column is lost."""
    lost = clashes(df.schema, snake_key) + [f.name for f in df.schema.fields if not snake_key(f.name)]
    if lost:
        raise ValueError(f"these names can't be told apart in snake case: {', '.join(lost)}")
    return rename_keys(df, snake_key)


def keys_replace(df: DataFrame, old: str, new: str) -> DataFrame:
    return rename_keys(df, lambda k: k.replace(old, new))


def names_for_sql(df: DataFrame) -> DataFrame:
    return rename_keys(df, normal_key, nested=False)


def flat_columns(schema: T.StructType) -> list[tuple[str, str]]:
    """Paths of the leaves of a schema and their flat names.

    Leaves are taken from the last field backwards; a leaf keeps its bare name unless
    it is taken, then it gets its whole path. An empty struct vanishes.
    """
    out: dict[str, str] = {}
    stack = [(f.name, f) for f in schema.fields]
    while stack:
        path, field = stack.pop()
        if isinstance(field.dataType, T.StructType):
            stack += [(f"{path}.{f.name}", f) for f in field.dataType.fields]
        else:
            name = field.name if field.name not in out else path
            out[name] = path
    return [(path, name) for name, path in out.items()]


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns."""
    quote = lambda path: ".".join(f"`{p}`" for p in path.split("."))
    return df.select(*(F.col(quote(path)).alias(name) for path, name in flat_columns(df.schema)))


def lift(df: DataFrame, column: str, drop: bool = False, prefix: str = "", suffix: str = "", only: bool = False) -> DataFrame:
    """Fields of a struct lifted to the top; if any name is taken nothing changes."""
    fields = df.schema[column].dataType.fieldNames()
    names = [f"{prefix}{f}{suffix}" for f in fields]
    rest = [] if only else [c for c in df.columns if not (drop and c == column)]
    if set(names) & set(rest):
        return df
    return df.select(*rest, *(F.col(column)[f].alias(n) for f, n in zip(fields, names)))


def normalize(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to their kinds; ``_cast_errors`` names those of a row whose value didn't fit and became null."""
    flags = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.lit(c)) for c, k in kinds.items()]
    errors = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return df.withColumn("_cast_errors", errors).withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def schemaless(df: DataFrame) -> DataFrame:
    """The whole row as one JSON column ``data``."""
    return df.select(F.to_json(F.struct("*")).alias("data"))

"""Truth and coercion of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rendered forms that count as false.
FALSE_FORMS = ["False", "false", "{}", "[]", "()", "", "0", "0.0"]
#: Words for true and for false.
TRUE_WORDS = ["y", "yes", "t", "true", "on", "1"]
FALSE_WORDS = ["n", "no", "f", "false", "off", "0"]


def truthy(value: Column, present: Column | None = None) -> Column:
    """Never null: false forms and absent fields are false; a null that is present is true."""
    text = value.cast("string")
    there = F.lit(True) if present is None else present
    return F.when(~there, F.lit(False)).when(value.isNull(), F.lit(True)).otherwise(~text.isin(FALSE_FORMS))


def truthy_json(text: Column, key: str) -> Column:
    """``truthy`` of a top-level key of a JSON object, telling JSON null from an absent key."""
    field = F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "variant")
    return truthy(F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "string"), field.isNotNull())


def to_bool(value: Column) -> Column:
    """True and false words, else null."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def cast_or_keep(value: Column, kind: str) -> Column:
    """A struct: the raw text, the value cast to ``kind`` or null, and whether the cast failed."""
    typed = value.try_cast(kind)
    return F.struct(value.cast("string").alias("raw"), typed.alias("typed"), (value.isNotNull() & typed.isNull()).alias("cast_error"))


def remap(value: Column, pairs: dict[str, str]) -> Column:
    """The value that ``pairs`` gives, or the value itself."""
    if not pairs:
        return value
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)

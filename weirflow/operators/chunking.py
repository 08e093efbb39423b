"""Records as documents, and documents as chunks of a size in characters, words or tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators import paths

#: What texts of a kind are parted at, the coarsest first; those before which a part begins are patterns.
SEPARATORS = {
    "text": ["\n\n", "\n", " ", ""],
    "markdown": [r"(?m)(?=^# )", r"(?m)(?=^## )", r"(?m)(?=^### )", r"(?m)(?=^#### )", r"(?m)(?=^##### )", r"(?m)(?=^###### )", "\n\n", "\n", " ", ""],
    "python": [r"(?m)(?=^class )", r"(?m)(?=^def )", r"(?m)(?=^\s+def )", "\n\n", "\n", " ", ""],
    "javascript": [r"(?m)(?=^\s*function )", r"(?m)(?=^\s*(?:const|let|var|class) )", r"(?m)(?=^\s*(?:if|for|while|switch) )", "\n\n", "\n", " ", ""],
    "html": [r"(?=<(?:body|div|p|br|li|h[1-6]|table|tr|td|th|ul|ol|header|footer|nav)\b)", "\n", " ", ""],
}
#: A value that a key lacks.
MISSING = "__not_found__"


def parted(text: str, separator: str) -> list[str]:
    """A text's parts, each with the separator after it, so that together they are the text."""
    if not separator:
        return list(text)
    if separator.startswith("(?"):
        return [p for p in re.split(separator, text) if p]
    return [p for p in re.split(f"(?<={re.escape(separator)})", text) if p]


def together(parts: list[str], size: int, overlap: int, measure: Callable[[str], int]) -> list[str]:
    """Parts next to each other put together while they fit; a chunk begins with the last parts of the one before, up to ``overlap``."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    fresh = 0  # how many of the held parts no chunk has yet
    for p in parts:
        n = measure(p)
        if fresh and sum(m for _, m in held) + n > size:
            out.append("".join(q for q, _ in held))
            fresh = 0
        while held and not fresh and (sum(m for _, m in held) > overlap or sum(m for _, m in held) + n > size):
            held.pop(0)
        held.append((p, n))
        fresh += 1
    return [*out, "".join(q for q, _ in held)] if fresh else out


def chunks_of(text: str, separators: list[str], size: int, overlap: int = 0, measure: Callable[[str], int] = len) -> list[str]:
    """A text in chunks of at most ``size``, each beginning with up to ``overlap`` of what ended the last.

    It is parted at the first separator. Short parts next to each other are put together; a part that is too
    long is chunked by itself, at the separators that follow, so chunks don't run from one section into another
    that was cut. Nothing is lost; a part without separators left may be longer.
    """
    if not text:
        return []
    if measure(text) <= size or not separators:
        return [text]
    out: list[str] = []
    short: list[str] = []
    for p in parted(text, separators[0]):
        if measure(p) <= size:
            short.append(p)
        else:
            out += together(short, size, overlap, measure) + chunks_of(p, separators[1:], size, overlap, measure)
            short = []
    return out + together(short, size, overlap, measure)


def measured(by: str) -> Callable[[str], int]:
    """A measure of texts: ``characters``, ``words``, or tokens by the file of a tokenizer."""
    if by == "characters":
        return len
    if by == "words":
        return lambda t: len(t.split())
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(by)
    return lambda t: len(known.encode(t, add_special_tokens=False).ids)


def hierarchy_chunks(df: DataFrame, text: str, size: int, overlap: int = 0, kind: str = "text", by: str = "characters", keep: list[str] = (), separators: list[str] | None = None) -> DataFrame:
    """``keep``, ``chunk`` and ``content`` of every text; ``by`` says what ``size`` and ``overlap`` count. A null or blank text has no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    steps = separators or SEPARATORS[kind]
    shape = T.StructType([*(df.schema[k] for k in keep), T.StructField("chunk", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = measured(by)
        for batch in batches:
            for i, body in enumerate(batch.column("__text")):
                whole = body.as_py()
                if whole and whole.strip():
                    found = chunks_of(whole, steps, size, overlap, measure)
                    kept = [pa.array([batch.column(k)[i].as_py()] * len(found), batch.schema.field(k).type) for k in keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], [*keep, "chunk", "content"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, shape)


def field_text(df: DataFrame, path: str) -> Column:
    """What lies at a path as text: the value alone, several as a JSON list; null where there is none."""
    found = paths.values(*paths.whole(df), paths.steps_of(path))
    if found is None:
        return F.lit(None).cast("string")
    items, kind = found
    return F.when(F.size(items) == 1, paths.as_text(F.element_at(items, 1), kind)).when(F.size(items) > 1, F.to_json(items))


def record_key(df: DataFrame, keys: list[str], stream: str, namespace: str | None = None) -> Column:
    """The id under which a stream's record is upserted: namespace, stream and key fields, which may be nested."""
    head = "_".join(x for x in (namespace, stream) if x)
    return F.concat(F.lit(f"{head}_"), F.concat_ws("_", *(F.coalesce(field_text(df, k), F.lit(MISSING)) for k in keys)))


def record_documents(
    df: DataFrame, text_fields: list[str], metadata_fields: list[str], stream: str, keys: list[str] = (), namespace: str | None = None, names: dict[str, str] | None = None, dedupe: bool = True, keep: list[str] = ()
) -> DataFrame:
    """``keep``, ``record_id``, ``content`` and ``metadata`` of each record.

    Fields are paths, with wildcards; those that a record lacks are left out. ``names`` renames fields. The id is null without keys or
    where records are only appended. A record without any text field fails.
    """
    shown = lambda f: (names or {}).get(f, f)
    lines = [F.concat(F.lit(f"{shown(f)}: "), field_text(df, f)) for f in text_fields]
    content = F.concat_ws("\n", *lines)
    content = F.when(F.coalesce(*lines).isNotNull(), content).otherwise(F.raise_error(F.lit(f"a record has none of the text fields {', '.join(text_fields)}")).cast("string"))
    pairs = [x for f in metadata_fields for x in (F.lit(shown(f)), field_text(df, f))]
    pairs += [F.lit("_stream"), F.lit("_".join(x for x in (namespace, stream) if x))]
    key = record_key(df, list(keys), stream, namespace) if keys and dedupe else F.lit(None).cast("string")
    pairs += [F.lit("_record_id"), key]
    return df.select(*keep, key.alias("record_id"), content.alias("content"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"))


def renamed_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed as a loader's mapping says, each at its new name's place at the end; a column that had the new name gives way."""
    for old, new in names.items():
        if old in df.columns and old != new:
            df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (old, new)), F.col(f"`{old}`").alias(new))
    return df

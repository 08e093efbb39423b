"""Bodies of responses (a binary or text column) to records."""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unzipped(body: Column) -> Column:
    """Bytes without gzip; other bytes as they are."""

    @F.pandas_udf("binary")
    def plain(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: gzip.decompress(b) if b is not None and b[:2] == b"\x1f\x8b" else b)

    return F.when(F.hex(F.substring(body, 1, 2)) == "1F8B", plain(body)).otherwise(body)


def text_of(body: Column) -> Column:
    """UTF-8 text without NUL characters."""
    return F.translate(F.decode(unzipped(body), "utf-8"), "\x00", "")


def json_records(df: DataFrame, body: str, schema: str, into: str = "record") -> DataFrame:
    """A list gives its elements, an object itself, what doesn't parse or is empty an empty record."""
    text = F.trim(F.col(body))
    many = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{schema}>")
    one = F.from_json(F.lit("{}"), schema)
    return df.withColumn(into, F.explode(F.when(F.coalesce(F.size(many), F.lit(0)) > 0, F.transform(many, lambda x: F.coalesce(x, one))).otherwise(F.array(one))))


def json_lines(df: DataFrame, body: str, schema: str, into: str = "record") -> DataFrame:
    """A record a line; lines that don't parse are dropped."""
    bad = "_corrupt_record"
    kind = T.StructType([*T.DataType.fromDDL(schema).fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("__line", kind, {"columnNameOfCorruptRecord": bad})
    lines = df.select("*", F.explode(F.split(body, "\r?\n")).alias("__line")).where(F.trim("__line") != "")
    lines = lines.withColumn(into, parsed).where(F.col(into)[bad].isNull())
    return lines.withColumn(into, F.col(into).dropFields(bad)).drop("__line")


def csv_records(df: DataFrame, body: str, columns: list[str], nulls: list[str] = (), separator: str = ",", into: str = "record") -> DataFrame:
    """A record for each row after the header row, by the header's names; ``columns`` are those wanted, values in ``nulls`` are null.

    Quoted fields may hold separators and line ends; a row shorter than the header has nulls; blank rows are skipped.
    """

    @F.pandas_udf("array<map<string,string>>")
    def rows(bodies: pd.Series) -> pd.Series:
        def parse(text: str | None) -> list[dict]:
            found = (r for r in csv.reader(io.StringIO(text or "", newline=""), delimiter=separator) if r)
            head = next(found, [])
            return [dict(zip(head, r)) for r in found]

        return bodies.map(parse)

    out = df.withColumn("__row", F.explode(rows(body)))
    value = lambda c: F.try_element_at("__row", F.lit(c))
    clean = F.struct(*(F.when(~value(c).isin(list(nulls)), value(c)).alias(c) if nulls else value(c).alias(c) for c in columns))
    return out.withColumn(into, clean).drop("__row")


def xml_records(df: DataFrame, body: str, schema: str, into: str = "record") -> DataFrame:
    """The document as a struct, null fields where it is malformed."""
    return df.withColumn(into, F.from_xml(body, schema))


def lines(df: DataFrame, body: str) -> DataFrame:
    """``record``: a struct with the line."""
    return df.select("*", F.explode(F.split(body, "\n")).alias("__line")).withColumn("record", F.struct(F.col("__line").alias("record"))).drop("__line")


def zip_members(files: DataFrame) -> DataFrame:
    """Of files (path, content): path, member, content of each member; a broken archive fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def dispatch(df: DataFrame, header: str, by: dict[str, Column], otherwise: Column) -> Column:
    """A decoded column chosen by the value of a header column."""
    out = None
    for value, decoded in by.items():
        out = F.when(F.col(header) == value, decoded) if out is None else out.when(F.col(header) == value, decoded)
    return otherwise if out is None else out.otherwise(otherwise)

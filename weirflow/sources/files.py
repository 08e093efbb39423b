"""File scans with the file columns that every record carries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.operators.filters import merged_schema
from weirflow.operators.state import inferred_type

URL, MODIFIED = "_source_file_url", "_source_file_last_modified"


def listing(spark: SparkSession, path: str, glob: str = "*", since: str | None = None) -> DataFrame:
    """``uri``, ``last_modified`` and ``size`` of files below ``path`` that match, not older than ``since`` (that moment included)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.select(F.col("path").alias("uri"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size")).dropDuplicates(["uri"])
    return files.where(F.col("last_modified") >= F.lit(since).cast("timestamp")) if since else files


def with_file_columns(df: DataFrame) -> DataFrame:
    """The records of a file scan with the url and time of their file."""
    return df.select("*", F.col("_metadata.file_path").alias(URL), F.col("_metadata.file_modification_time").alias(MODIFIED))


def duplicate_names(files: DataFrame) -> DataFrame:
    """Base names that more than one file has."""
    return files.groupBy(F.element_at(F.split("uri", "/"), -1).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, nulls: list[str] = ("",), **options: str) -> DataFrame:
    """All columns as strings, those in ``nulls`` as null; names from the header (blank trailing ones dropped) or ``columns``."""
    reader = spark.read.options(**{"header": str(columns is None).lower(), "inferSchema": "false", "mode": "PERMISSIVE"} | options)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = with_file_columns(reader.csv(path))
    blank = [c for c in df.columns if not c.strip() or c.startswith("_c") and columns is None]
    df = df.drop(*blank)
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(list(nulls)), F.col(f"`{c}`")) for c in df.columns if c not in (URL, MODIFIED)})


def read_csv_below(spark: SparkSession, path: str, before_header: int = 0, after_header: int = 0, separator: str = ",") -> DataFrame:
    """CSV files with rows to skip before and after the header line; the header is that of the first file.

    Lines are counted in each file by their place in it; a field can't hold a line end here.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"), F.col("_metadata.file_path").alias(URL))
    head = lines.where(F.col("at") == before_header).orderBy(URL).select("line").first()
    if head is None:
        return spark.createDataFrame([], f"{URL} string")
    schema = ", ".join(f"`{c.strip()}` string" for c in head[0].split(separator) if c.strip())
    body = lines.where((F.col("at") > before_header + after_header) & (F.trim("line") != ""))
    return body.select(F.from_csv("line", schema, {"sep": separator}).alias("r"), URL).select("r.*", URL)


def infer_csv(df: DataFrame) -> T.StructType:
    """The schema that all values of string columns fit."""
    kinds = {"boolean": T.BooleanType(), "integer": T.LongType(), "number": T.DoubleType(), "string": T.StringType()}
    columns = [c for c in df.columns if c not in (URL, MODIFIED)]
    row = df.agg(*(inferred_type(F.col(f"`{c}`")).alias(c) for c in columns)).first()
    return T.StructType([T.StructField(c, kinds[row[c]], True) for c in columns])


def cast_csv(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema cast, others dropped; a value that doesn't fit stays as text in ``_uncast``."""
    uncast: list[Column] = []
    out = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`")
        typed = value.try_cast(f.dataType)
        out.append(typed.alias(f.name))
        uncast += [F.lit(f.name), F.when(typed.isNull(), value)]
    kept = F.map_filter(F.create_map(*uncast), lambda k, v: v.isNotNull()).alias("_uncast")
    return df.select(*out, kept, *(c for c in df.columns if c in (URL, MODIFIED)))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record a line, lines that don't parse dropped; without a schema the record is one JSON column ``data``."""
    if schema is None:
        lines = with_file_columns(spark.read.text(path))
        return lines.where(F.try_parse_json("value").isNotNull() & (F.trim("value") != "")).withColumnRenamed("value", "data")
    bad = "_corrupt_record"
    df = with_file_columns(spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path))
    return df.where(F.col(bad).isNull()).drop(bad)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of several paths with the columns of all; types widen from null over boolean, integer, number to string."""
    frames = [with_file_columns(spark.read.option("mergeSchema", "true").parquet(p)) for p in paths]
    schema = merged_schema(*(widened(f.schema) for f in frames))
    cast = [f.select(*((F.col(f"`{s.name}`") if s.name in f.columns else F.lit(None)).cast(s.dataType).alias(s.name) for s in schema.fields)) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f)
    return out


def widened(schema: T.StructType) -> T.StructType:
    """Integers as long and floats as double, as JSON has them."""
    whole, real = (T.ByteType, T.ShortType, T.IntegerType), (T.FloatType,)
    kind = lambda t: T.LongType() if isinstance(t, whole) else T.DoubleType() if isinstance(t, real) else t
    return T.StructType([T.StructField(f.name, kind(f.dataType), True) for f in schema.fields])


def json_values(df: DataFrame, decimal_as_float: bool = False) -> DataFrame:
    """Columns as JSON has them: times and dates in ISO form, binary and decimals as text, durations as microseconds, maps as objects."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.BinaryType):
            c = F.decode(c, "utf-8")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double" if decimal_as_float else "string")
        elif isinstance(t, T.DayTimeIntervalType):
            c = c.cast("interval day to second")
            c = (F.extract(F.lit("DAY"), c).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), c).cast("long") * 3_600_000_000
                 + F.extract(F.lit("MINUTE"), c).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"))
        out.append(c.alias(f.name))
    return df.select(*out)


#: Endings of documents that are text already.
TEXT_ENDINGS = ["md", "txt"]


def read_documents(spark: SparkSession, path: str, skip_unknown: bool = True) -> DataFrame:
    """``document_key``, ``content`` and ``parse_error`` of text and Markdown files; other kinds have an error, or fail the job."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(TEXT_ENDINGS)
    error = F.lit("no parser for this kind of file")
    content = F.when(known, F.decode("content", "utf-8"))
    if not skip_unknown:
        content = content.otherwise(F.raise_error(error).cast("string"))
    return raw.select(F.col("path").alias("document_key"), content.alias("content"), F.when(~known, error).alias("parse_error"))


def parsed_files(raw: DataFrame, parse: Callable[[bytes], Iterable[dict]], schema: str, table: str) -> DataFrame:
    """The records that ``parse`` makes of files (path, content), and what went wrong, in one pass kept as ``table``.

    A row is a record (``record``, with its ``position`` in the file) or a file's error (``error``, at the
    position where it stopped): one file that can't be read costs its own rest, not the job. See ``records_of`` and ``errors_of``.
    """
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("position", T.LongType()), T.StructField("record", T.StructType.fromDDL(schema)), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, at = [], 0
                try:
                    for record in parse(content.as_py()):
                        rows.append({"path": path, "position": at, "record": record})
                        at += 1
                        if len(rows) == 1_000:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                except Exception as e:  # of any parser; it is a row of the result
                    rows.append({"path": path, "position": at, "error": f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    raw.select("path", "content").mapInArrow(run, kind).write.parquet(table)
    return raw.sparkSession.read.schema(kind).parquet(table)


def records_of(parsed: DataFrame) -> DataFrame:
    """The records of ``parsed_files`` with their file's url."""
    return parsed.where("error is null").select("record.*", F.col("path").alias(URL))


def errors_of(parsed: DataFrame) -> DataFrame:
    """``path``, ``position`` and ``error`` of the files of ``parsed_files`` that couldn't be read to their ends."""
    return parsed.where("error is not null").select("path", "position", "error")


def fail_on_errors(parsed: DataFrame, raw: DataFrame) -> None:
    """Fails, after everything was read, if any file had an error, with the first few of them."""
    bad = errors_of(parsed)
    count = bad.count()
    if count:
        some = "; ".join(f"{r.path} at {r.position}: {r.error}" for r in bad.orderBy("path").limit(5).collect())
        raise ValueError(f"{count} of {raw.count()} files couldn't be read: {some}")

"""The text of word-processor documents and slides, as Markdown, from their XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.files import TEXT_ENDINGS


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def named(e: ElementTree.Element, name: str) -> str | None:
    """An attribute by its name without its space."""
    return next((v for k, v in e.items() if local(k) == name), None)


def run_text(e: ElementTree.Element) -> str:
    """The text of a paragraph: its runs, tabs and breaks."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(x.text or "" if local(x.tag) == "t" else signs.get(local(x.tag), "") for x in e.iter())


def paragraph(p: ElementTree.Element) -> str:
    """A paragraph, a heading or a list item."""
    text = run_text(p).strip()
    style = next((named(x, "val") or "" for x in p.iter() if local(x.tag) == "pStyle"), "")
    level = re.fullmatch(r"(?i)heading\s*(\d)", style)
    if text and (level or style.lower() == "title"):
        return f"{'#' * min(6, int(level[1]) if level else 1)} {text}"
    return f"- {text}" if text and any(local(x.tag) == "numPr" for x in p.iter()) else text


def word_text(content: bytes) -> str:
    """A document's paragraphs, and its tables as rows with bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if local(e.tag) == "body")
    out = []
    for e in body:
        if local(e.tag) == "p":
            out.append(paragraph(e))
        elif local(e.tag) == "tbl":
            rows = [[" ".join(filter(None, map(paragraph, (p for p in c.iter() if local(p.tag) == "p")))) for c in r if local(c.tag) == "tc"] for r in e if local(r.tag) == "tr"]
            out.append("\n".join(f"| {' | '.join(r)} |" for r in rows))
    return "\n\n".join(filter(None, out))


def slides_text(content: bytes) -> str:
    """The texts of slides in order, each slide's title as a heading."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for _, name in slides:
            for shape in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e.tag) == "sp"):
                title = any(local(x.tag) == "ph" and (named(x, "type") or "") in ("title", "ctrTitle") for x in shape.iter())
                lines = [t for p in shape.iter() if local(p.tag) == "p" and (t := run_text(p).strip())]
                out += [f"# {' '.join(lines)}"] if title and lines else lines
    return "\n\n".join(out)


#: How documents of a kind are read, by their endings.
PARSERS: dict[str, Callable[[bytes], str]] = {"docx": word_text, "pptx": slides_text}


def read_office(spark: SparkSession, path: str, glob: str = "*", skip_broken: bool = True) -> DataFrame:
    """``document_key``, ``content`` and ``parse_error`` of text, Markdown, word-processor files and slides.

    A file of another kind, or one that can't be read, has an error and no content, or fails the job.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))

    @F.pandas_udf("text string, error string")
    def parsed(contents: pd.Series, endings: pd.Series) -> pd.DataFrame:
        def one(content: bytes, kind: str) -> tuple[str | None, str | None]:
            try:
                return PARSERS[kind](content), None
            except (KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                return None, f"no {kind} document: {e or type(e).__name__}"

        return pd.DataFrame([one(c, k) for c, k in zip(contents, endings)], columns=["text", "error"])

    none: Column = F.struct(F.lit(None).cast("string").alias("text"), F.lit("no parser for this kind of file").alias("error"))
    plain = F.struct(F.decode("content", "utf-8").alias("text"), F.lit(None).cast("string").alias("error"))
    got = F.when(ending.isin(TEXT_ENDINGS), plain).when(ending.isin(list(PARSERS)), parsed("content", ending)).otherwise(none)
    rows = raw.select(F.col("path").alias("document_key"), got.alias("r")).select("document_key", F.col("r.text").alias("content"), F.col("r.error").alias("parse_error"))
    if skip_broken:
        return rows
    failed = F.raise_error(F.concat("document_key", F.lit(": "), "parse_error")).cast("string")
    return rows.withColumn("content", F.when(F.col("parse_error").isNotNull(), failed).otherwise(F.col("content")))

"""Workbooks (xlsx) as records: cells typed by what the sheet says, columns by all rows of all workbooks.

A sheet's XML is parsed row by row, so a task holds a workbook's bytes, its shared texts and one row. The first
row with cells names the columns; a name that is missing becomes ``column_<number>``, a repeated one gets a number at its end.
Rows may be ragged: what a row lacks is null. A number in a cell whose style is a date is a time; error
values are null. A column is a number, a boolean or a time if all its cells are, else text.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The built-in formats that show dates and times.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Kinds of cells, and Spark's types for columns of one kind.
KINDS = {"number": "double", "boolean": "boolean", "time": "timestamp_ntz", "text": "string"}
CELLS = "path string, row int, cells map<string, struct<at: int, kind: string, text: string>>"
ROWS = 1_000


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parts(stream, *wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of an XML stream with one of the names, each dropped after use."""
    path = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        if local(e.tag) in wanted:
            yield e
            if path:
                path[-1].clear()


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for run in (si, *(r for r in si if local(r.tag) == "r")) for t in run if local(t.tag) == "t") for si in parts(f, "si")]


def dated_styles(z: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code)
    own = {int(e.get("numFmtId")) for e in root.iter() if local(e.tag) == "numFmt" and re.search("[dmyhs]", plain(e.get("formatCode", "")).lower())}
    styles = next((e for e in root if local(e.tag) == "cellXfs"), ())
    return {i for i, e in enumerate(styles) if int(e.get("numFmtId") or 0) in own | DATES}


def column_number(reference: str) -> int:
    """The place of a cell from its letters, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def moment(serial: float, from_1904: bool) -> str:
    """A serial number of days as a time; the 29th of February 1900 that sheets count never was."""
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30 if serial >= 60 else 31)
    return (start + datetime.timedelta(milliseconds=round(serial * 86_400_000))).isoformat(" ")


def sheet(z: zipfile.ZipFile, name: str | None) -> tuple[str, bool]:
    """The member that holds a sheet (the first without a name), and whether days count from 1904."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {e.get("Id"): e.get("Target") for e in links}
    sheets = [(e.get("name"), targets[next(v for k, v in e.items() if local(k) == "id")]) for e in book.iter() if local(e.tag) == "sheet"]
    found = [t for n, t in sheets if name in (None, n)]
    if not found:
        raise ValueError(f"no sheet {name}")
    early = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    return found[0].lstrip("/") if found[0].startswith("/") else f"xl/{found[0]}", early


def cells(content: bytes, name: str | None = None) -> Iterator[dict[int, tuple[str, str]]]:
    """The kind and text of the cells of each row that has some, by their place."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        member, early = sheet(z, name)
        texts, dated = shared_texts(z), dated_styles(z)
        with z.open(member) as f:
            for row in parts(f, "row"):
                out, at = {}, -1
                for c in row:
                    at = column_number(c.get("r")) if c.get("r") else at + 1
                    value = next((v.text for v in c if local(v.tag) == "v"), None)
                    kind = c.get("t", "n")
                    if kind == "inlineStr":
                        out[at] = ("text", "".join(t.text or "" for t in c.iter() if local(t.tag) == "t"))
                    elif value is None or kind == "e":
                        continue
                    elif kind == "s":
                        out[at] = ("text", texts[int(value)])
                    elif kind == "b":
                        out[at] = ("boolean", "true" if value == "1" else "false")
                    elif kind == "d":
                        out[at] = ("time", value.replace("T", " ").removesuffix("Z"))
                    elif kind == "str":
                        out[at] = ("text", value)
                    elif int(c.get("s") or 0) in dated:
                        out[at] = ("time", moment(float(value), early))
                    else:
                        out[at] = ("number", value)
                if out:
                    yield out


def named(head: dict[int, tuple[str, str]], width: int) -> list[str]:
    """Names for columns, none of them twice."""
    out: list[str] = []
    for i in range(width):
        name = head.get(i, ("", ""))[1].strip() or f"column_{i + 1}"
        n, tried = 0, name
        while tried in out:
            n += 1
            tried = f"{name}_{n}"
        out.append(tried)
    return out


def sheet_cells(files: DataFrame, name: str | None = None) -> DataFrame:
    """``CELLS``: the cells of each row below the header, by column name, of workbooks (path, content). A broken workbook fails with its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.struct([("at", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))

        def made(path: str, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], kind)], ["path", "row", "cells"])

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                head, names, rows, number = None, [], [], 0
                try:
                    for found in cells(content.as_py(), name):
                        if head is None:
                            head = found
                        else:
                            number += 1
                            if max(found) >= len(names) or not names:
                                names = named(head, max(*found, *head) + 1)
                            rows.append((number, [(names[i], {"at": i, "kind": k, "text": t}) for i, (k, t) in found.items()]))
                            if len(rows) == ROWS:
                                yield made(path, rows)
                                rows = []
                except (KeyError, ValueError, IndexError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    raise ValueError(f"{path} isn't a workbook that can be read: {e}") from e
                if head is not None:  # a row without cells tells the names of columns without any
                    whole = named(head, max([len(names) - 1, *head]) + 1)
                    rows.append((0, [(n, {"at": i, "kind": None, "text": None}) for i, n in enumerate(whole)]))
                    yield made(path, rows)

    return files.select("path", "content").mapInArrow(run, CELLS)


def schema_of(rows: DataFrame) -> str:
    """The columns of ``CELLS`` in order, with the one type that all their cells have, else text; a column without cells is a number."""
    flat = rows.select(F.explode("cells").alias("name", "c")).groupBy("name").agg(F.min("c.at").alias("at"), F.collect_set("c.kind").alias("kinds"))
    found = sorted(flat.collect(), key=lambda r: (r["at"], r["name"]))  # a row a column
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    return ", ".join(f"{quoted(r['name'])} {KINDS[r.kinds[0]] if len(r.kinds) == 1 else 'string' if r.kinds else 'double'}" for r in found)


def typed(rows: DataFrame, schema: str, keep: list[str] = ()) -> DataFrame:
    """``CELLS`` as columns of ``schema``; values that don't fit are null."""
    fields = T.StructType.fromDDL(schema).fields if schema else []
    return rows.where("row > 0").select(*keep, *(F.try_element_at("cells", F.lit(f.name))["text"].try_cast(f.dataType).alias(f.name) for f in fields))


def read_workbooks(spark: SparkSession, path: str, schema: str | None = None, name: str | None = None, glob: str = "*.xlsx") -> DataFrame:
    """The records of the workbooks at or below ``path``, with the columns of all or of ``schema``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = sheet_cells(files, name)
    return typed(rows, schema if schema is not None else schema_of(rows))


def workbook(rows: Iterable[Iterable[object]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet of texts, numbers, booleans and times; None is an empty cell."""
    texts: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        line = []
        for i, value in enumerate(row):
            letters, n = "", i + 1
            while n:
                n, rest = divmod(n - 1, 26)
                letters = chr(65 + rest) + letters
            at = f'r="{letters}{r}"'
            if isinstance(value, bool):
                line.append(f'<c {at} t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, datetime.datetime):
                days = (value - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
                line.append(f'<c {at} s="1"><v>{days!r}</v></c>')
            elif isinstance(value, int | float):
                line.append(f"<c {at}><v>{value!r}</v></c>")
            elif value is not None:
                line.append(f'<c {at} t="s"><v>{texts.setdefault(str(value), len(texts))}</v></c>')
        lines.append(f'<row r="{r}">{"".join(line)}</row>')
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    members = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="s1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="s1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">{"".join(f"""<si><t xml:space="preserve">{escape(t)}</t></si>""" for t in texts)}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, text in members.items():
            z.writestr(member, head + text)
    return out.getvalue()

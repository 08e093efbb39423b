"""WARC archives: write captures, read records back, assemble transactions.

A capture is three records: the request, the response (or a revisit, where another
capture holds an equal payload) and metadata. Request and metadata name the response
in ``WARC-Concurrent-To``. ``write`` makes them with string functions and Spark's
text writer, gzipped; ``records`` parses whole archive files; ``transactions`` joins
the three kinds through the concurrent-to identifiers to one nested row a capture.

Record ids hold the page's id and where its row lies, so they are unique even where
ids repeat. An archive file is one gzip member, as Spark's text writer makes it;
reading takes any number of members, in time linear in their bytes.

Edge cases: a null payload is empty; a null id is written as ``null``; rows that
share the largest id of their payload are all responses, and revisits refer to the last of them;
a null url is empty; a record without its response keeps a row with a null response; of several
records of a kind in one capture the smallest is taken; line
ends in a url are percent-encoded so that they can't end a header line; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.storage import located, row_key, shared_folder, small_or_plain, written

END = "\r\n\r\n"
PLACE = ["file_key", "row_key"]
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile that WARC 1.1 gives for a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages in an archive file at most, and bytes of pages; a file is parsed by one task.
FILE_PAGES, FILE_BYTES = 5_000, 1 << 28


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: four groups of 40 bits, each eight digits of base 32."""
    hexed = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, headers: list[Column], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}"), *headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))


def write(pages: DataFrame, path: str, revisit_from: int = 0, file_pages: int = FILE_PAGES) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``.

    Of equal payloads of ``revisit_from`` bytes or more, that with the largest page_id
    is the response and the others revisit it.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = located(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), *row_key())
    pages = pages.withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html"), "exact": F.unhex(F.sha2("html", 256))})
    last = F.max(F.struct("page_id", *PLACE)).alias("first")
    groups = pages.where(F.col("bytes") >= revisit_from).groupBy("exact").agg(last, F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    groups = written(groups, "warc-groups")
    longest = max(groups.agg(F.max("bytes")).first()[0] or 0, revisit_from)
    first = small_or_plain(written(groups.where("n > 1").select("exact", "first"), "warc-copies"))
    rows = pages.join(first, "exact", "left")

    def urn(part: str, page: Column | None = None) -> Column:
        of = (lambda c: page[c]) if page is not None else F.col
        return F.concat(F.lit("<urn:capture:"), F.coalesce(of("page_id").cast("string"), F.lit("null")), F.lit(f":{part}:"), F.hex(of("file_key")), F.lit("-"), of("row_key"), F.lit(">"))

    own, number = urn("response"), F.col("page_id")
    target = F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A")
    uri, digest = header("WARC-Target-URI", target), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = header("Content-Type", "application/http;msgtype=response")
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit(END))
    again = F.coalesce(F.col("first.page_id") > number, F.col("first.page_id").isNotNull() & number.isNull())
    response = record("response", [header("WARC-Record-ID", own), uri, digest, http], F.concat(answer, "html"))
    revisit = record(
        "revisit",
        [header("WARC-Record-ID", own), uri, digest, header("WARC-Profile", PROFILE), header("WARC-Refers-To", urn("response", F.col("first"))), http],
        answer,
    )
    beside = header("WARC-Concurrent-To", own)
    request = record(
        "request",
        [header("WARC-Record-ID", urn("request")), beside, uri, header("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + END)),
    )
    metadata = record(
        "metadata",
        [header("WARC-Record-ID", urn("metadata")), beside, uri, header("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(number.cast("string"), F.lit("null")), F.lit("\r\n")),
    )
    capture = F.concat(request, F.lit(END), F.when(again, revisit).otherwise(response), F.lit(END), metadata)
    few = max(1, FILE_BYTES // max(1, longest))
    short = F.col("bytes") <= FILE_BYTES // file_pages

    def save(some: DataFrame, most: int) -> None:
        out = some.select(capture.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", most).text(path)

    if few >= file_pages:
        save(rows, file_pages)
    else:  # long pages go to files of fewer pages
        save(rows.where(short), file_pages)
        save(rows.where(~short), few)


def unpacked(content: bytes) -> Iterator[bytes]:
    """Pieces of an archive's plain bytes; any number of gzip members, or none."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, step = memoryview(content), 0, 1 << 16
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a gzip member")
            piece = view[at : at + step]
            yield member.decompress(piece)
            at += len(piece)
        at -= len(member.unused_data)


class Pieces(io.RawIOBase):
    """The pieces as one readable stream."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.rest = piece
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive file, in order."""
    stream = io.BufferedReader(Pieces(unpacked(content)), 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("an archive record doesn't start with WARC/")
            continue
        head = fields(list(iter(lambda: stream.readline().rstrip(b"\r\n"), b"")))
        block = stream.read(int(head["content-length"]))
        kind, http, payload = head["warc-type"], {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = fields(top.split(b"\r\n")[1:])
        size = int(http.get("content-length", 0)) if kind == "revisit" else len(payload)
        sha1 = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": head.get("warc-record-id"), "kind": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
            "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_bytes": size, "payload_digest": sha1, "payload": payload,
        }


RECORD = "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string"


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``; ``payload`` only if asked for."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in RECORD.split(", ")]
    if payloads:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for content in got.column("content"):
                rows, held = [], 0
                for r in parse(content.as_py()):
                    rows.append(r)
                    held += len(r["payload"]) if payloads else 0
                    if len(rows) >= 2000 or held > 8_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response, metadata (structs of record columns).

    Records of a capture meet in one shuffle, by the identifier that they are concurrent to.
    """
    answers = F.col("kind").isin("response", "revisit")
    capture = F.when(answers, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    nested = F.struct(*found.columns)
    kinds = {"request": F.col("kind") == "request", "response": answers, "metadata": F.col("kind") == "metadata"}
    found = found.where(F.col("kind").isin("request", "response", "revisit", "metadata"))
    return found.groupBy(capture.alias("capture_id")).agg(*(F.min(F.when(is_kind, nested)).alias(name) for name, is_kind in kinds.items()))


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back as captures, without payloads."""
    path = shared_folder(pages.sparkSession, "warc")
    write(pages, path)
    return transactions(records(pages.sparkSession, path, payloads=False))

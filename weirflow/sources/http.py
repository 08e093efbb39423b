"""A paged HTTP source: ``spark.read.format("paged_http")`` after ``register(spark)``.

Where: ``url``; ``method`` (GET); ``params``, ``headers`` and ``body`` (sent as JSON), each a
JSON object that goes with every request; ``token``, a bearer token. ``slices`` is a JSON
list of objects, one partition each, whose fields go to the query; ``inject``, a JSON
object from field to ``[place, name]``, sends a field elsewhere: place is ``query``,
``header`` or ``body`` (there ``name`` may be a dotted path). Two values for one name fail.

What: ``records``, a dotted path to the list of records (``*`` takes every item or value);
``pagination``, one of ``none``, ``offset``, ``page``, ``cursor`` and ``link``; ``page_size``, ``size_param``,
``page_param``, ``first_page``; ``cursor_path``, where a response holds the next cursor (or, for ``link``, the
next page's url, also relative; without it the response's ``Link`` header says it);
``more_path``, where a response says whether there are more pages.
``stop_field`` and ``stop_before`` end a slice, whose newest records come first, after
the first page that has only records before that value; with ``drop_passed`` those records, which were read
before, are left out once the page was judged.

Errors: ``retries`` and ``backoff`` for rate limits, server errors and broken connections,
and for statuses in the list ``retry``; a status in the list ``ignore`` ends its slice; others fail.
``Retry-After`` (seconds or a date), or the header ``wait_header`` (``wait_kind`` ``seconds``, or ``until``, a
time in seconds since 1970; ``wait_pattern`` picks its number), says how long to wait, ``max_wait`` seconds
at most and ``min_wait`` at least. Only http and https are read.
Rows are ``slice`` and ``record``, both JSON.
"""

from __future__ import annotations

import email.utils
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def at_path(value, path: str):
    """What lies at a dotted path; a ``*`` makes a list of what all items or values have there."""
    steps = [step for step in path.split(".") if step]
    for i, step in enumerate(steps):
        if step == "*":
            items = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
            found = [at_path(x, ".".join(steps[i + 1 :])) for x in items]
            found = [x for x in found if x is not None]
            return [y for x in found for y in x] if "*" in steps[i + 1 :] else found
        value = value.get(step) if isinstance(value, dict) else value[int(step)] if isinstance(value, list) and step.isdigit() and int(step) < len(value) else None
    return value


def put(places: dict[str, dict], place: str, name: str, value: object) -> None:
    """Sets a value of a request; a name that has one already fails."""
    at, *rest = places[place], *(name.split(".") if place == "body" else [name])
    for step in rest[:-1]:
        at = at.setdefault(step, {})
        if not isinstance(at, dict):
            raise ValueError(f"{name} is set twice in the {place}")
    if rest[-1] in at:
        raise ValueError(f"{name} is set twice in the {place}")
    at[rest[-1]] = value


class Slice(InputPartition):
    def __init__(self, fields: dict) -> None:
        self.fields = fields


class Ignored(Exception):
    """A status that ends a slice."""


def number_or_text(value: object) -> float | str:
    """A number where the value reads as one, so that cursors compare by size."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return str(value)


def comes_before(value: object, bound: object) -> bool:
    """Whether ``value`` comes before ``bound``, as numbers if both are, else as text."""
    a, b = number_or_text(value), number_or_text(bound)
    return a < b if type(a) is type(b) else str(value) < str(bound)


#: What is assumed where an option isn't given.
DEFAULTS = {
    "method": "GET", "params": "{}", "headers": "{}", "body": "{}", "slices": "[{}]", "inject": "{}", "records": "", "pagination": "none", "page_size": "100",
    "size_param": "limit", "page_param": "offset", "first_page": "0", "retries": "5", "backoff": "0.5", "retry": "[]", "ignore": "[]", "max_wait": "600", "min_wait": "0", "wait_kind": "seconds", "wait_pattern": r"[\d.]+",
}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = DEFAULTS | options

    def partitions(self) -> list[Slice]:
        return [Slice(s) for s in json.loads(self.o["slices"])]

    def request(self, fields: dict, paging: dict, url: str | None = None) -> urllib.request.Request:
        places = {k: json.loads(self.o[o]) for k, o in (("query", "params"), ("header", "headers"), ("body", "body"))}
        if self.o.get("token"):
            put(places, "header", "Authorization", f"Bearer {self.o['token']}")
        elsewhere = json.loads(self.o["inject"])
        for name, value in {**fields, **paging}.items():
            put(places, *elsewhere.get(name, ["query", name]), value)
        if url is None:
            url = self.o["url"] + (f"?{urllib.parse.urlencode(places['query'])}" if places["query"] else "")
        if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
            raise ValueError(f"only http and https are read, not {url}")
        data = json.dumps(places["body"]).encode() if places["body"] else None
        headers = {k: str(v) for k, v in places["header"].items()} | ({"Content-Type": "application/json"} if data else {})
        return urllib.request.Request(url, data, headers, method=self.o["method"])

    def asked_wait(self, headers, now: float) -> float | None:
        """The seconds that a response's headers ask to wait, within the bounds; None if they say nothing."""
        named, after = self.o.get("wait_header"), headers.get("Retry-After")
        wait = None
        if named and headers.get(named) and (found := re.search(self.o["wait_pattern"], headers[named])):
            wait = float(found[0]) - (now if self.o["wait_kind"] == "until" else 0)
        elif after and re.fullmatch(r"[\d.]+", after.strip()):
            wait = float(after)
        elif after and (date := email.utils.parsedate_to_datetime(after)):
            wait = date.timestamp() - now
        return None if wait is None else min(max(wait, float(self.o["min_wait"]), 0), float(self.o["max_wait"]))

    def fetch(self, fields: dict, paging: dict, url: str | None = None) -> tuple[object, object]:
        """A response's body and headers; what may pass is tried again with growing waits."""
        request, last = self.request(fields, paging, url), int(self.o["retries"])
        for attempt in range(last + 1):
            wait = min(float(self.o["backoff"]) * 2**attempt, float(self.o["max_wait"]))
            try:
                with urllib.request.urlopen(request, timeout=60) as response:
                    return json.load(response), response.headers
            except urllib.error.HTTPError as e:
                if e.code in json.loads(self.o["ignore"]):
                    raise Ignored from e
                passing = e.code == 429 or e.code >= 500 or e.code in json.loads(self.o["retry"])
                if not passing or attempt == last:
                    raise
                asked = self.asked_wait(e.headers, time.time())
                wait = wait if asked is None else asked
            except urllib.error.URLError:
                if attempt == last:
                    raise
            time.sleep(wait)
        return None, {}

    def passed(self, found: list) -> bool:
        """Whether a page has only records before the stop."""
        field, before = self.o.get("stop_field"), self.o.get("stop_before")
        return bool(field and before and found) and all(comes_before(at_path(r, field), before) for r in found)

    def kept(self, found: list) -> list:
        """A page's records without those before the stop, if they are to be dropped; one without a cursor stays."""
        field, before = self.o.get("stop_field"), self.o.get("stop_before")
        if not (field and before and str(self.o.get("drop_passed", "")).lower() == "true"):
            return found
        return [r for r in found if (at := at_path(r, field)) is None or not comes_before(at, before)]

    def first(self) -> object:
        """The token of a slice's first page."""
        return int(self.o["first_page"]) if self.o["pagination"] in ("offset", "page") else None

    def page(self, fields: dict, token: object) -> tuple[list, object]:
        """The records of one page, and the next page's token, None after the last."""
        kind, size = self.o["pagination"], int(self.o["page_size"])
        paging = {self.o["size_param"]: size} if kind in ("offset", "page") else {}
        if token is not None and kind != "link" and not (kind == "offset" and token == self.first()):
            paging[self.o["page_param"]] = token
        try:
            body, headers = self.fetch(fields, paging, token if kind == "link" else None)
        except Ignored:
            return [], None
        found = at_path(body, self.o["records"])
        found = found if isinstance(found, list) else [found] if found else []
        if self.passed(found) or kind == "none" or self.o.get("more_path") and not at_path(body, self.o["more_path"]):
            return found, None
        if kind == "link":
            link = at_path(body, self.o["cursor_path"]) if "cursor_path" in self.o else (re.search(r'<([^>]*)>[^,]*rel="?next"?', headers.get("Link") or "") or [None, None])[1]
            return found, urllib.parse.urljoin(token or self.o["url"], link) if link else None
        if kind == "cursor":
            return found, at_path(body, self.o["cursor_path"]) or None
        if len(found) < size:
            return found, None
        return found, token + (len(found) if kind == "offset" else 1)

    def read(self, partition: Slice) -> Iterator[tuple]:
        token = self.first()
        while True:
            found, token = self.page(partition.fields, token)
            for record in self.kept(found):
                yield json.dumps(partition.fields), json.dumps(record)
            if token is None:
                return


class PagedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "slice string, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedHttp)


def property_names(options: dict, name: str = "name", wanted: list[str] | None = None) -> list[str]:
    """The names of the properties that an endpoint lists (each once, in order), of ``wanted`` alone if given; a list of names, as long as a schema."""
    reader = PagedReader(options)
    found = [at_path(json.loads(record), name) for part in reader.partitions() for _, record in reader.read(part)]
    return [n for n in dict.fromkeys(found) if n is not None and (wanted is None or n in wanted)]

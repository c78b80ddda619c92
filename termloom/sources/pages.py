"""JSON over HTTP as Spark data sources: numbered pages, and searches of another server by scroll.

``paged_json`` asks ``url&sn=<from>&ln=<rows>``, from 1, and reads ``total_count``,
``fieldname_list`` and ``result`` of each answer. A task takes a run of pages,
so that the driver's list of tasks is bounded, however many pages there are.
Every row up to ``total_count`` is read, the last one included.

``search_scroll`` sends a query to another search server and follows its
scroll. ``slices`` of one search are read by as many tasks at once.

Both send basic authentication if ``user`` is set. An answer that is no answer
after ``tries`` fails the task, as does a page with fewer rows than its own
``total_count`` promises: rows are never left out. A step of a scroll is asked
once only, since asking again would pass over a page; the task begins anew.

Defined cases: a missing field is null; a value that is no string comes as
JSON; an empty list gives an empty result; without ``total_count`` the first
page is all there is.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Least rows of a page, and tasks that the pages are dealt to at most.
LEAST_LENGTH, MOST_TASKS = 10, 10_000
#: Rows of a scroll's page and the time it is kept, unless set.
SCROLL_SIZE, KEEP_ALIVE = 10_000, "1m"


def asked(url: str, options: dict, body: dict | None = None, method: str | None = None, tries: int | None = None) -> dict:
    """The JSON object that a server answers; server errors and lost connections are tried again, refusals are not."""
    headers = {"Content-Type": "application/json"}
    if options.get("user"):
        pair = f"{options['user']}:{options.get('password', '')}".encode()
        headers["Authorization"] = "Basic " + base64.b64encode(pair).decode()
    sent = None if body is None else json.dumps(body).encode()
    tries = tries or int(options.get("tries", 4))
    for left in range(tries - 1, -1, -1):
        try:
            request = urllib.request.Request(url, sent, headers, method=method)
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as answer:
                return json.loads(answer.read())
        except OSError as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
            if refused or not left:
                raise
            time.sleep(0.5 * 2 ** (tries - 1 - left))
    raise ValueError("tries must be 1 or more")


def as_text(value: object) -> str | None:
    """A field's value: strings as they are, all else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _strings(schema: StructType) -> StructType:
    if any(not isinstance(f.dataType, StringType) for f in schema):
        raise ValueError("fields are read as strings; cast them afterwards")
    return schema


@dataclass
class Run(InputPartition):
    """Pages that begin at ``first`` and at every page's length after it, up to ``last``."""

    first: int
    last: int


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> StructType:
        names = PagedReader(StructType(), dict(self.options)).page(None).get("fieldname_list") or []
        if not names:
            raise ValueError("the answer names no fields; give a schema")
        return StructType([StructField(str(n), StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(_strings(schema), dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options = schema.names, options
        self.start = max(1, int(options.get("start", 1)))
        self.length = max(LEAST_LENGTH, int(options.get("length", 1000)))

    def page(self, at: int | None) -> dict:
        return asked(f"{self.options['url']}&sn={at or self.start}&ln={self.length}", self.options)

    def partitions(self) -> list[InputPartition]:
        total = int(self.page(None).get("total_count") or 0)
        pages = max(1, -(-(total - self.start + 1) // self.length))
        each = -(-pages // MOST_TASKS)
        starts = range(self.start, self.start + pages * self.length, each * self.length)
        return [Run(s, min(s + (each - 1) * self.length, self.start + (pages - 1) * self.length)) for s in starts]

    def read(self, partition: Run) -> Iterator[tuple]:
        for at in range(partition.first, partition.last + 1, self.length):
            page = self.page(at)
            rows = page.get("result") or []
            promised = min(self.length, int(page.get("total_count") or 0) - at + 1)
            if len(rows) < promised:
                raise ValueError(f"page at {at}: {len(rows)} rows of {promised}; a smaller length may be needed")
            for row in rows:
                yield tuple(as_text(row.get(n)) for n in self.names)


@dataclass
class Slice(InputPartition):
    """One of the slices of a search."""

    number: int


class SearchScroll(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_scroll"

    def schema(self) -> str:
        return "_id string, _source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScrollReader(dict(self.options))


class ScrollReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.slices = max(1, int(options.get("slices", 1)))

    def partitions(self) -> list[InputPartition]:
        return [Slice(k) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        url, keep = self.options["url"].rstrip("/"), self.options.get("keep_alive", KEEP_ALIVE)
        body = {"size": int(self.options.get("size", SCROLL_SIZE)), "query": json.loads(self.options.get("query", '{"match_all": {}}'))}
        if self.slices > 1:
            body["slice"] = {"id": partition.number, "max": self.slices}
        step = urllib.parse.urlsplit(url)._replace(path="/_search/scroll", query="").geturl()
        answer = asked(f"{url}/_search?scroll={keep}", self.options, body, "POST")
        try:
            while hits := answer["hits"]["hits"]:
                for hit in hits:
                    yield hit["_id"], as_text(hit.get("_source"))
                answer = asked(step, self.options, {"scroll": keep, "scroll_id": answer["_scroll_id"]}, "POST", tries=1)
        finally:
            try:
                asked(step, self.options, {"scroll_id": answer["_scroll_id"]}, "DELETE", tries=1)
            except (OSError, ValueError, KeyError):
                pass  # it ends by itself when its time is over


def read_pages(spark: SparkSession, url: str, start: int = 1, length: int = 1000, **options: object) -> DataFrame:
    """All rows of a paged list from ``start`` on; a page has ``length`` rows, 10 at least."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=url, start=start, length=length, **options).load()


def scan_remote(spark: SparkSession, url: str, query: dict | None = None, slices: int = 1, **options: object) -> DataFrame:
    """(_id, _source) of all that ``query`` finds at ``url`` (server and index); ``_source`` is JSON for ``from_json``."""
    spark.dataSource.register(SearchScroll)
    sent = json.dumps(query or {"match_all": {}})
    return spark.read.format("search_scroll").options(url=url, query=sent, slices=slices, **options).load()

"""Data source ``paged_json``: items of a service that answers in numbered pages, as a table or as a stream of pages.

``spark.dataSource.register(PagedJson)``, then ``spark.read.format("paged_json")``
with the options

* ``path``: an http(s) address, asked with ``page`` and ``size`` (and ``q``, ``body``:
  a JSON text, posted), or a folder of saved pages: ``page-<n>.json`` files, or
  ``page=<n>`` folders whose files hold the page.
* ``start`` (0), ``pages`` (500 at most by default), ``size`` (500), ``q``, ``body``.

A partition is a run of pages, of one where there are up to ``PARTITIONS`` of them. Planning asks the first page for ``page.totalPages``;
comparisons of the column ``page`` narrow the range before that. Where a service
doesn't tell, one task asks page after page and ends at the first one without
items. Rows are (page, pos, item), the item as JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .files import opened

LISTS = ("neurons", "Neuron", "results", "data")  # fixed values: names of the list of items where there is no _embedded
TIMEOUT_S = 60
PARTITIONS = 512  # more pages than this share partitions, as a task costs more than a page of a folder


def items_of(page: dict) -> list:
    """The items of a page: the first list below ``_embedded``, else the first that one of the usual names has."""
    embedded = page.get("_embedded")
    found = [v for v in embedded.values() if isinstance(v, list)] if isinstance(embedded, dict) else []
    found += [page[k] for k in LISTS if isinstance(page.get(k), list)]
    return found[0] if found else []


def total_pages(page: dict) -> int | None:
    said = page.get("page")
    total = said.get("totalPages") if isinstance(said, dict) else None
    return total if isinstance(total, int) and not isinstance(total, bool) else None


@dataclass
class Service:
    """Where pages come from."""

    path: str
    size: int
    q: str | None
    body: str | None

    def page(self, n: int) -> dict | None:
        """Page ``n``; None if a folder doesn't hold it."""
        if self.path.startswith(("http://", "https://")):
            asked = {"page": n, "size": self.size} | ({"q": self.q} if self.q else {})
            request = Request(f"{self.path}?{urlencode(asked)}", data=self.body.encode() if self.body else None, headers={"Content-Type": "application/json"})
            with urlopen(request, timeout=TIMEOUT_S) as answer:
                return json.load(answer)
        system, base = opened(self.path if ":" in self.path else f"file://{self.path}")
        file, folder = system.get_file_info([f"{base}/page-{n}.json", f"{base}/page={n}"])
        if file.type == fs.FileType.File:
            parts = [file.path]
        elif folder.type == fs.FileType.Directory:
            parts = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder.path)) if i.is_file and not i.base_name.startswith((".", "_")))
        else:
            return None
        text = b"".join(system.open_input_stream(p).read() for p in parts)
        return json.loads(text) if text.strip() else {}

    def rows(self, n: int) -> list[tuple[int, int, str]]:
        return [(n, i, json.dumps(item)) for i, item in enumerate(items_of(self.page(n) or {}))]


@dataclass
class Page(InputPartition):
    """All pages from ``first`` up to ``last``; with ``until_empty`` only up to the first one without items."""

    first: int
    last: int
    until_empty: bool = False


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, pos int, item string"

    def settings(self) -> tuple[Service, int, int]:
        """The service, the first page and the last one that may be asked for."""
        o = self.options
        first = int(o.get("start", 0))
        return Service(o["path"].rstrip("/"), int(o.get("size", 500)), o.get("q"), o.get("body")), first, first + int(o.get("pages", 500)) - 1

    def reader(self, schema) -> DataSourceReader:
        return Pages(*self.settings())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(*self.settings())


class Pages(DataSourceReader):
    def __init__(self, service: Service, first: int, last: int):
        self.service, self.first, self.last, self.start = service, first, last, first

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of ``page`` with a number; the others are left to Spark."""
        for f in filters:
            n = f.value if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("page",) else None
            if not isinstance(n, int):
                yield f
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.first = max(self.first, n + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.last = min(self.last, n - isinstance(f, LessThan))

    def partitions(self) -> list[Page]:
        if self.first > self.last:
            return [Page(0, -1)]
        total = total_pages(self.service.page(self.start) or {})
        if total is None:
            # Nobody says which page is the last: they are asked in a row, from the service's first on, as an empty page ends them.
            return [Page(self.start, self.last, True)]
        last = min(self.last, total - 1)
        run = max(1, -(-(last - self.first + 1) // PARTITIONS))
        return [Page(n, min(n + run - 1, last)) for n in range(self.first, last + 1, run)] or [Page(0, -1)]

    def read(self, partition: Page) -> Iterator[tuple[int, int, str]]:
        for n in range(partition.first, partition.last + 1):
            rows = self.service.rows(n)
            if not rows and partition.until_empty:
                return
            if n >= self.first:
                yield from rows


class PageStream(DataSourceStreamReader):
    """Pages as they appear: an offset is the number of the next page. A page is taken once it is there and has items."""

    def __init__(self, service: Service, first: int, last: int):
        self.service, self.first, self.last, self.next = service, first, last, first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        while self.next <= self.last and self.service.rows(self.next):
            self.next += 1
        return {"page": self.next}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.next = max(self.next, end["page"])
        return [Page(n, n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple[int, int, str]]:
        for n in range(partition.first, partition.last + 1):
            yield from self.service.rows(n)

    def commit(self, end: dict) -> None:
        pass


def pages(spark, path: str, **options: str):
    """The items of all pages (page, pos, item), with comparisons of ``page`` pushed to the source."""
    spark.dataSource.register(PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_json").options(path=path, **options).load()

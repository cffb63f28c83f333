"""Sources that hand out pages: offset pages, cursor pages, retries with back-off.

A page is fetched by a function named ``module:function``, so that it can be found again on a
worker. Offset pages are read by many tasks at once once the number of records is known; a cursor
leads from page to page, so its chain is one task, and a chain that breaks off is an error, never a
shorter table.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Unavailable(Exception):
    """The other side is busy or failing for now (429, 5xx): worth another try after ``wait`` seconds."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


def retried(call: Callable, tries: int = 5, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; on ``Unavailable`` again after 1, 2, 4 ... seconds or the wait asked for, the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Unavailable as e:
            if k == tries - 1:
                raise
            sleep(min(longest, e.wait if e.wait is not None else 2.0**k))


def named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.at = named(options["fetch"]), options.get("at", "")
        self.page, self.tasks = int(options.get("page", "1000")), int(options.get("tasks", "8"))
        self.tries, self.by = int(options.get("tries", "5")), options.get("by", "offset")

    def partitions(self) -> list[Pages]:
        if self.by == "cursor":
            return [Pages(0, 0)]
        total = retried(lambda: self.fetch(self.at, 0, 0), self.tries)["total"]
        pages = -(-total // self.page)
        step = max(1, -(-pages // self.tasks))
        return [Pages(k, min(pages, k + step)) for k in range(0, pages, step)]

    def read(self, part: Pages) -> Iterator[tuple]:
        if self.by == "cursor":
            cursor = None
            while True:
                page = retried(lambda: self.fetch(self.at, cursor, self.page), self.tries)
                yield from page["rows"]
                cursor = page.get("next")
                if cursor is None:
                    return
        for k in range(part.first, part.last):
            yield from retried(lambda: self.fetch(self.at, k * self.page, self.page), self.tries)["rows"]


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with the options ``fetch`` (``module:function``), ``at`` (passed on), ``page``, ``tasks``, ``tries``, ``by`` (``offset`` or ``cursor``) and a schema.

    ``fetch(at, offset or cursor, size)`` returns ``rows`` (tuples), ``total`` for size 0, and
    ``next`` (None at the end) for cursors.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def parquet_pages(at: str, offset: int | None, size: int) -> dict:
    """Pages of a Parquet table, as an interface would hand them out; ``at`` is ``path?column,column``."""
    import pyarrow.dataset as ds

    path, _, columns = at.partition("?")
    data = ds.dataset(path)
    total = data.count_rows()
    if not size:
        return {"total": total, "rows": []}
    start = offset or 0
    rows, seen = [], 0
    for batch in data.to_batches(columns=columns.split(",")):
        if seen + batch.num_rows > start and seen < start + size:
            part = batch.slice(max(0, start - seen), start + size - max(start, seen))
            rows += list(zip(*(c.to_pylist() for c in part.columns)))
        seen += batch.num_rows
        if seen >= start + size:
            break
    return {"rows": rows, "next": start + size if start + size < total else None}

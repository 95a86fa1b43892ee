"""Vendors' landed answers as a data source: a partition for each window of days, its pages read in turn.

``path`` holds a folder ``start=YYYY-MM-DD`` for each window asked for, and in it the
pages ``page=1.json``, ``page=2.json``, ... as they came. A window's pages are read until
one says that none follows; a page that is then missing is an error. Windows that end
before ``since`` are not read.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "start string, page int, item string"


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Window(InputPartition):
    """A window's first day."""

    def __init__(self, start: str):
        super().__init__(start)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.items = options["path"].rstrip("/"), options.get("items", "data")
        self.days, self.since = int(options.get("days", 30)), options.get("since")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A lower end of ``start`` leaves windows out; any other filter is Spark's."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("start",):
                low = dt.date.fromisoformat(f.value)
                self.first = max(getattr(self, "first", dt.date.min), low + dt.timedelta(isinstance(f, GreaterThan)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.path)
        found = (re.fullmatch(r"start=(\d{4}-\d{2}-\d{2})", x.base_name) for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)
        starts = sorted(m[1] for m in found if m)
        last = lambda s: (dt.date.fromisoformat(s) + dt.timedelta(self.days - 1)).isoformat()
        first = getattr(self, "first", dt.date.min).isoformat()
        return [Window(s) for s in starts if s >= first and (self.since is None or last(s) >= self.since)]

    def read(self, partition: Window | None) -> Iterator[tuple]:
        if partition is None:  # no window is left
            return
        system, root = _files(self.path)
        page = 0
        while True:
            page += 1
            with system.open_input_stream(f"{root}/start={partition.value}/page={page}.json") as f:
                answer = json.loads(f.read())
            for item in answer.get(self.items) or []:
                yield partition.value, page, json.dumps(item)
            if not (answer.get("pagination") or {}).get("hasNextPage"):
                return


class VendorPages(DataSource):
    """``spark.read.format("vendor_pages")`` with ``path``, ``items`` (the list's name), ``since`` and ``days`` of a window."""

    @classmethod
    def name(cls) -> str:
        return "vendor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def pages(spark: SparkSession, path: str, *, items: str = "data", since: str | None = None, days: int = 30) -> DataFrame:
    """Items of a vendor's answers, a row each. The session's filters reach Python sources from then on."""
    spark.dataSource.register(VendorPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("vendor_pages").option("path", path).option("items", items).option("days", str(days))
    return (reader.option("since", since) if since else reader).load()

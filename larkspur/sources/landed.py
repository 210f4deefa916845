"""Landed raw pages as a source of Spark: ``spark.read.format("landed_pages")`` and ``readStream``.

Collectors land a page a file and say in its name what it is
(``<source>_[<app>_]run<r>_page<p>_<stamp>``), so a filter on run, page or app is answered by
names: files that can't match are neither opened nor planned. What is left is dealt into
partitions of about ``bytes_per_partition`` each. As a stream, an offset is the last file
taken, by the time it landed and its name.

Options: ``path`` (any store that Arrow's file systems reach, ``file:`` or a plain path, ``hdfs:``,
``s3:``, ``gs:``) and ``bytes_per_partition``. Files land whole and are not changed. Names that
are not those of pages are left alone; a file that can't be read is an error, not a missing page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "landed_pages"
SCHEMA = "source string, app string, run long, page long, name string, payload string"
NAME = re.compile(r"(?P<source>apple_app_store|google_play|[a-z]+)_(?:(?P<app>[^_]+(?:_[^_]+)*?)_)?run(?P<run>\d+)_page(?P<page>\d+)_")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BYTES = 64 << 20
KEYS = ("source", "app", "run", "page", "name")


@dataclass(frozen=True)
class Page:
    path: str
    name: str
    size: int
    landed: int
    source: str
    app: str | None
    run: int
    page: int


@dataclass
class Files(InputPartition):
    pages: tuple[Page, ...]


def file_system(path: str):
    """The store of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[Page]:
    """The pages below a folder, by the time they landed and their names."""
    from pyarrow import fs

    store, root = file_system(path)
    out = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        m = NAME.match(info.base_name) if info.type == fs.FileType.File else None
        if m:
            out.append(Page(info.path, info.base_name, info.size or 0, info.mtime_ns or 0, m["source"], m["app"], int(m["run"]), int(m["page"])))
    return sorted(out, key=lambda p: (p.landed, p.name, p.path))


def tests_of(filters: list[Filter]) -> tuple[list, list[Filter]]:
    """What names can answer of some filters, as functions of a page, and the filters they can't."""
    tests, rest = [], []
    for f in filters:
        (column,) = f.attribute if len(getattr(f, "attribute", ())) == 1 else (None,)
        if column not in KEYS:
            rest.append(f)
        elif isinstance(f, EqualTo):
            tests.append(lambda p, c=column, v=f.value: getattr(p, c) == v)
        elif isinstance(f, In):
            tests.append(lambda p, c=column, v=tuple(f.value): getattr(p, c) in v)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and column in ("run", "page"):
            compare = {GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}[type(f)]
            tests.append(lambda p, c=column, v=f.value, compare=compare: compare(getattr(p, c), v))
        else:
            rest.append(f)
    return tests, rest


def dealt(pages: list[Page], most: int) -> list[Files]:
    """Pages in partitions of about ``most`` bytes, in their order."""
    out, held, size = [], [], 0
    for p in pages:
        if held and size + p.size > most:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(p)
        size += p.size
    return [*out, Files(tuple(held))] if held else out


def rows_of(path: str, part: Files) -> Iterator[tuple]:
    store, _ = file_system(path)
    for p in part.pages:
        with store.open_input_stream(p.path) as stream:
            yield p.source, p.app, p.run, p.page, p.name, stream.read().decode("utf-8")


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most, self.tests = options["path"], int(options.get("bytes_per_partition", BYTES)), []

    def pushFilters(self, filters):
        self.tests, rest = tests_of(filters)
        yield from rest

    def partitions(self):
        kept = [p for p in listed(self.path) if all(test(p) for test in self.tests)]
        self.tests = []
        return dealt(kept, self.most) or [Files(())]  # of no partition at all Spark makes one of its own

    def read(self, partition):
        yield from rows_of(self.path, partition)


class PagesStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("bytes_per_partition", BYTES))

    def initialOffset(self):
        return {"landed": -1, "name": ""}

    def latestOffset(self):
        pages = listed(self.path)
        return {"landed": pages[-1].landed, "name": pages[-1].name} if pages else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["landed"], start["name"]), (end["landed"], end["name"])
        return dealt([p for p in listed(self.path) if low < (p.landed, p.name) <= high], self.most)

    def read(self, partition):
        yield from rows_of(self.path, partition)

    def commit(self, end):
        pass

    def stop(self):
        pass


class LandedPages(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PagesReader(dict(self.options))

    def streamReader(self, schema):
        return PagesStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and has filters pushed to it."""
    spark.dataSource.register(LandedPages)
    spark.conf.set(PUSHDOWN, "true")

"""Documents of many pages as a Spark source whose partitions are page ranges.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("paths", json.dumps(paths)).option("reader", "module:object").load()

A reader has count(data) and pages(data, first, last), pages from 1; data is the file's bytes, read through
pyarrow's file systems, so a path may lie in any store that they know. The reader `form_feed` takes
texts whose pages end with a form feed; one around a PDF library plugs in the same way. A range that cannot be read is a row with
its error and no page, so one bad range costs no other. `extract` reads once, then reads only failed ranges
again, by the next reader in turn, and puts the pages of each document together.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stored import stored

RANGE_PAGES = 15
SCHEMA = "path string, first int, last int, total int, page int, text string, error string"


class FormFeed:
    """Texts in UTF-8 whose pages are separated by form feeds."""

    def count(self, data: bytes) -> int:
        return data.count(b"\f") + 1

    def pages(self, data: bytes, first: int, last: int) -> list[str]:
        return [p.decode("utf-8") for p in data.split(b"\f")[first - 1 : last]]


form_feed = FormFeed()


def _bytes(path: str) -> bytes:
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        store, where = fs.LocalFileSystem(), path
    else:
        store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f:
        return f.read()


def _named(name: str) -> object:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    last: int
    total: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.reader = options.get("reader", "quillmere.sources.paged:form_feed")
        self.size = int(options.get("rangepages", RANGE_PAGES))
        self.paths, self.ranges = json.loads(options.get("paths", "[]")), json.loads(options.get("ranges", "[]"))

    def partitions(self) -> list[InputPartition]:
        """The ranges asked for, or those of each path: a file that cannot be counted is one range, which fails when it is read."""
        out = [PageRange(*r) for r in self.ranges]
        reader = _named(self.reader)
        for path in self.paths:
            try:
                total = reader.count(_bytes(path))
            except Exception:  # noqa: BLE001  told by the range
                out.append(PageRange(path, 1, 0, 0))
                continue
            out += [PageRange(path, k, min(k + self.size - 1, total), total) for k in range(1, total + 1, self.size)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        p = partition
        try:
            found = _named(self.reader).pages(_bytes(p.path), p.first, p.last)
            if not any(t.strip() for t in found):
                raise ValueError("no text in the range")
        except Exception as e:  # noqa: BLE001  the reject row says what happened
            yield p.path, p.first, p.last, p.total, None, None, f"{type(e).__name__}: {e}"
            return
        for k, text in enumerate(found):
            yield p.path, p.first, p.last, p.total, p.first + k, text, None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, paths: list[str], reader: str, size: int = RANGE_PAGES, ranges: list[tuple] | None = None) -> DataFrame:
    """(path, first, last, total, page, text, error): pages, and a row for each range that failed."""
    spark.dataSource.register(PagedSource)
    asked = {"paths": json.dumps(paths), "ranges": json.dumps(ranges or []), "reader": reader, "rangePages": str(size)}
    return spark.read.format("paged").options(**asked).load()


def extract(spark: SparkSession, paths: list[str], readers: tuple[str, ...] = ("quillmere.sources.paged:form_feed",), tries: int = 2, size: int = RANGE_PAGES) -> tuple[DataFrame, DataFrame]:
    """Documents (path, text, n_pages, n_failed) and rejects (path, first, last, total, error), the ranges that no try could read.

    Each reader has tries passes before the next one; every pass reads only what failed so far. A document's ranges are joined in order, each
    under a line that names its pages. The driver holds the failed ranges, not pages."""
    pages, failed = None, None
    for name in (n for n in readers for _ in range(tries)):
        if failed is not None and not failed:
            break
        found = stored(read_pages(spark, [] if failed is not None else paths, name, size, failed), "pages")
        good = found.where("error is null")
        pages = good if pages is None else pages.unionByName(good)
        rejects = found.where("error is not null").select("path", "first", "last", "total", "error")
        failed = [(r.path, r.first, r.last, r.total) for r in rejects.collect()]
    head = F.format_string("--- [batch trang %d-%d/%d] ---\n", "first", "last", "total")
    ranges = pages.groupBy("path", "first", "last", "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n"))
    whole = ranges.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(head, "text").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.sum("n").alias("n_pages"))
    lost = rejects.groupBy("path").agg(F.count("*").alias("n_failed"))
    out = whole.join(lost, "path", "full").select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
    return out, rejects

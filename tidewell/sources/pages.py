"""A paged interface as a Spark data source: folders whose pages all lie outside a date window are never read, and other
pages outside it give no rows.

Each page is a JSON document `{"meta": {"count": ..., "page": ...}, "data": [...]}` on a line, in a folder `page=N` (as Spark
writes partitions) that all executors mount, alone or with the next few pages (N is the first number that the folder may
hold); and `index` holds a JSON line a page: page, at (its folder's N), first, last (the earliest and latest start in it)
and n. Only the index is read to plan: a partition is some whole folders, ITEMS items about, but fewer as long as there are
less than SPREAD partitions. So tasks grow with the items, not with the pages, and a task holds one folder at a time. Rows are
(page, position, start, item), items as JSON text that Spark parses.

    spark.dataSource.register(Pages)
    spark.read.format("pages").option("maxPages", "30").load(folder).where("start >= '2024-01-05'")

A bound on `start` is pushed down; it needs spark.sql.python.filterPushdown.enabled. maxPages reads the first so many of
the pages left. A page that can't be read fails its task, which Spark tries again."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


ITEMS, SPREAD = 20_000, 48


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"pages are read from folders that all executors mount, not from {path}")
    return unquote(at.path)


def _lines(folder: str) -> Iterator[str]:
    for name in sorted(os.listdir(folder)):
        if not name.startswith((".", "_")):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                yield from f


@dataclass
class Folders(InputPartition):
    pages: dict[int, set[int]]  # by folder


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.start = _local(options["path"]), options.get("startfield", "start")
        self.most = int(options["maxpages"]) if "maxpages" in options else None
        self.low: tuple[str, bool] | None = None  # (bound, whether it belongs)
        self.high: tuple[str, bool] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    bound = (f.value, not isinstance(f, GreaterThan))
                    self.low = bound if self.low is None else max(self.low, bound, key=lambda b: (b[0], not b[1]))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    bound = (f.value, not isinstance(f, LessThan))
                    self.high = bound if self.high is None else min(self.high, bound, key=lambda b: (b[0], b[1]))
            yield f  # Spark applies them again: pages hold other rows, too

    def partitions(self) -> list[Folders]:
        def within(p: dict) -> bool:
            late = self.low is None or p["last"] > self.low[0] or (p["last"] == self.low[0] and self.low[1])
            early = self.high is None or p["first"] < self.high[0] or (p["first"] == self.high[0] and self.high[1])
            return late and early

        pages = sorted((p["page"], p.get("at", p["page"]), p["n"]) for p in map(json.loads, _lines(f"{self.folder}/index")) if p.get("first") is not None and within(p))
        pages = pages if self.most is None else pages[: self.most]
        most = min(ITEMS, sum(n for *_, n in pages) / SPREAD)
        out, items = [Folders({})], 0
        for page, at, n in sorted(pages, key=lambda p: p[1]):
            if items >= most and at not in out[-1].pages:
                out.append(Folders({}))
                items = 0
            out[-1].pages.setdefault(at, set()).add(page)
            items += n
        return out

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        for at, wanted in partition.pages.items():
            numbers, places, starts, items = [], [], [], []
            for page in map(json.loads, _lines(f"{self.folder}/page={at}")):
                number = page["meta"].get("page", at)
                if number in wanted:
                    numbers += [number] * len(page["data"])
                    places += range(len(page["data"]))
                    starts += [x.get(self.start) for x in page["data"]]
                    items += [json.dumps(x, ensure_ascii=False) for x in page["data"]]
            columns = [pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(starts, pa.string()), pa.array(items, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page", "position", "start", "item"])


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, position int, start string, item string"

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, folder: str, since: str | None = None, until: str | None = None, start_field: str = "start", most: int | None = None) -> DataFrame:
    """Items that start in a window [since, until); the bounds prune pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    reader = spark.read.format("pages").option("startField", start_field)
    rows = (reader if most is None else reader.option("maxPages", str(most))).load(folder)
    for bound, test in ((since, F.col("start") >= since), (until, F.col("start") < until)):
        rows = rows if bound is None else rows.where(test)
    return rows


def total(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many items there are, whatever a window or a limit of pages leaves out."""
    return spark.read.schema("page long, n long").json(f"{folder}/index").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def write_pages(rows: DataFrame, folder: str, page: str, start: str, together: int = 1) -> None:
    """rows as pages: page numbers, which the caller has dealt so that a page is small, and the items' other columns. Of numbers
    from a multiple of `together` on, so many share a folder: as many pages must be no large one, either."""
    item = F.struct(*(c for c in rows.columns if c != page))
    number = F.col(page)
    dealt = rows.select(number.alias("page"), (number - F.pmod(number, F.lit(together))).alias("at"), F.col(start).alias("start"), item.alias("item"))
    made = dealt.repartition("at").groupBy("at", "page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item")).alias("data"))
    body = F.to_json(F.struct(F.struct(F.col("n").alias("count"), "page").alias("meta"), F.col("data")))
    made.select(F.col("at").alias("page"), body.alias("value")).write.partitionBy("page").text(folder)
    index = dealt.groupBy("page", "at").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("n"))
    index.write.json(f"{folder}/index")

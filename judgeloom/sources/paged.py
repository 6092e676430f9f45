"""A paged search service as a Spark data source, and a stream of new hits: a partition is a page, or a stretch of pages where there are very many.

The service is a function (query, start, length) -> (total, hits). It is either named by the option ``service`` ("module:name"; a function of the
other options that returns the service), or given to ``source`` as it is. A page that fails is asked for again, alone, with growing
pauses; a task that fails asks for its pages again. A stream's offset is the number of hits seen, so a service whose hits only grow at the end is read once.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE, TRIES, PAUSE = 50, 4, 0.5
#: Partitions of a search, at most: beyond as many pages each has several, so that tasks don't grow in number with the hits.
TASKS = 100
Service = Callable[[str, int, int], tuple[int, list[dict]]]


class Page(InputPartition):
    def __init__(self, start: int, length: int):
        self.start, self.length = start, length


def asked(service: Service, query: str, start: int, length: int, tries: int = TRIES, pause: float = PAUSE) -> tuple[int, list[dict]]:
    """A page's answer; the last failure is raised."""
    for k in range(tries):
        try:
            return service(query, start, length)
        except Exception:  # noqa: BLE001 - a service fails in its own ways
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("no tries")


class _Reading:
    def __init__(self, options: dict, service: Service | None):
        self.options = dict(options)
        if service is None:
            module, name = options["service"].split(":")
            service = getattr(importlib.import_module(module), name)(self.options)
        self.service, self.query = service, options.get("query", "")
        self.page, self.tries, self.pause = int(options.get("page", PAGE)), int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))
        self.tasks = int(options.get("tasks", TASKS))

    def total(self) -> int:
        return asked(self.service, self.query, 0, 1, self.tries, self.pause)[0]

    def pages(self, start: int, end: int) -> list[Page]:
        stretch = self.page * max(1, -(-(end - start) // (self.page * self.tasks)))
        return [Page(s, min(stretch, end - s)) for s in range(start, end, stretch)]

    def read(self, partition: Page) -> Iterator:
        import pyarrow as pa

        end = partition.start + partition.length
        for start in range(partition.start, end, self.page):
            length = min(self.page, end - start)
            hits = asked(self.service, self.query, start, length, self.tries, self.pause)[1][:length]
            yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(hits)), pa.int64()), pa.array([json.dumps(h) for h in hits], pa.string())], ["place", "hit"])


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(0, self.total()) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator:
        if partition.length:
            yield from super().read(partition)


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"seen": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seen": self.total()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["seen"], end["seen"])

    def commit(self, end: dict) -> None:
        """Nothing is held for what was read."""


class PagedSearch(DataSource):
    """Options: service, query, page (hits asked for at once), tasks (partitions, at most), tries, pause; from (hits that a stream skips)."""

    service: Service | None = None

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "place long, hit string"

    def reader(self, schema) -> Reader:
        return Reader(self.options, type(self).service)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options, type(self).service)


def source(spark: SparkSession, service: Service | None = None, name: str = "paged_search") -> str:
    """Register the source, bound to a service if one is given; the name of its format."""

    class Bound(PagedSearch):
        @classmethod
        def name(cls) -> str:
            return name

    Bound.service = None if service is None else staticmethod(service)
    spark.dataSource.register(Bound)
    return name

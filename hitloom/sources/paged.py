"""A paged service as a Spark data source: pages are read by tasks, each from its own offset.

The fetch function (offset, limit) -> list of rows is given by the caller; no
address is built in.  Where the total isn't known, the end is found by doubling
and halving: the first page that is empty.  Failed requests are tried again,
and each task waits between its requests.
"""

from __future__ import annotations

import base64
import pickle
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FETCHERS: dict[str, Callable[[int, int], list[tuple]]] = {}


def register_fetcher(name: str, fetch: Callable[[int, int], list[tuple]]) -> None:
    FETCHERS[name] = fetch


def code_of(name: str) -> str:
    """A registered function as the source's option ``code``: the source runs in processes of its own, which don't see the registry."""
    from pyspark import cloudpickle

    return base64.b64encode(cloudpickle.dumps(FETCHERS[name])).decode()


class _Pages(InputPartition):
    def __init__(self, offsets: list[int]):
        self.offsets = offsets


class _Reader(DataSourceReader):
    def __init__(self, fetch, total: int | None = None, limit: int = 1000, start: int = 0, stop: int | None = None, tries: int = 3, pause: float = 0.0, each: int = 1):
        self.fetch, self.total, self.limit, self.start, self.stop = fetch, total, limit, start, stop
        self.tries, self.pause, self.each = tries, pause, each

    def page(self, offset: int) -> list[tuple]:
        """A page, after as many tries as are allowed; waits double from one try to the next."""
        for k in range(self.tries):
            try:
                return self.fetch(offset, self.limit)
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**k)
        return []

    def end(self) -> int:
        """The offset of the first empty page, in a number of requests that grows with the logarithm of the pages."""
        full, step = 0, 1
        while self.page(self.start + (full + step - 1) * self.limit):
            full += step
            step *= 2
        empty = full + step - 1
        while full < empty:
            half = (full + empty) // 2
            if self.page(self.start + half * self.limit):
                full = half + 1
            else:
                empty = half
        return self.start + full * self.limit

    def partitions(self):
        end = self.end() if self.total is None else self.total
        offsets = list(range(self.start, min(end, self.stop or end), self.limit))
        return [_Pages(offsets[k : k + self.each]) for k in range(0, len(offsets), self.each)] or [_Pages([])]

    def read(self, partition) -> Iterator[tuple]:
        for k, offset in enumerate(partition.offsets):
            if k and self.pause:
                time.sleep(self.pause)
            for row in self.page(offset):
                if row[0]:
                    yield (*row, offset)


def reader_of(options) -> _Reader:
    """A reader by the source's options, which are texts."""
    number = lambda k: int(options[k]) if options.get(k) else None
    fetch = pickle.loads(base64.b64decode(options["code"])) if options.get("code") else FETCHERS[options["fetcher"]]
    return _Reader(fetch, number("total"), number("limit") or 1000, number("start") or 0, number("stop"), number("tries") or 3, float(options.get("pause") or 0), number("pages_per_task") or 1)


class PagedSource(DataSource):
    """Options: code (``code_of``), limit, total, start, stop (offsets), tries, pause (seconds), pages_per_task.

    Rows without a structure are left out; page is the offset of a row's page.
    """

    @classmethod
    def name(cls) -> str:
        return "hitloom_paged"

    def schema(self) -> str:
        return "smiles string, value double, page long"

    def reader(self, schema) -> DataSourceReader:
        return reader_of(self.options)


def load_pages(spark: SparkSession, path: str, fetcher: str, pages: int = 100, limit: int = 1000, **options) -> DataFrame:
    """All pages as a table under path, fetched ``pages`` at a time; a second call goes on behind the last committed group.

    Groups are written in order, each by a job that commits as a whole, so the
    folder's names say where to go on.
    """
    from .store import finished

    spark.dataSource.register(PagedSource)
    root = path.rstrip("/")
    group = 1 + max(finished(spark, root), default=-1)
    while True:
        span = {"start": group * pages * limit, "stop": (group + 1) * pages * limit, "total": (group + 1) * pages * limit}
        given = {k: str(v) for k, v in ({"fetcher": fetcher, "limit": limit} | span | options).items()}
        if not reader_of(given).page(span["start"]):
            break
        spark.read.format("hitloom_paged").options(**given, code=code_of(fetcher)).load().write.mode("overwrite").parquet(f"{root}/block={group}")
        group += 1
    if not group:
        return spark.createDataFrame([], "smiles string, value double, page long")
    return spark.read.schema("smiles string, value double, page long").parquet(root).where(F.col("smiles").isNotNull())

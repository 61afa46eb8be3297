"""A source of pages: spark.read.format("pages") and readStream, over an address that gives {"total": n, "items": [...]} for an offset and a limit.

The address has {offset} and {limit} in it. Pages are dealt to tasks in ranges, so each is fetched by one task,
and only the first by the driver, for the total. As a stream, a batch goes from the offset that was read up to the total of now; offsets are in the checkpoint, so a
stream that is started again goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .archives import place


class Incomplete(RuntimeError):
    """A page doesn't have the items that the total promises."""


def fetched(address: str, offset: int, limit: int, seconds: float = 30.0) -> dict:
    """A page by its address: of a web server, or a file (or the one data file of a folder) that stands in for it."""
    where = address.format(offset=offset, limit=limit)
    if where.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(where, timeout=seconds) as answer:  # noqa: S310
            return json.load(answer)
    from pyarrow import fs

    system, path = place(where)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        path = next(f.path for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith(("_", ".")))
    elif info.type == fs.FileType.NotFound:
        return {"total": 0, "items": []}
    with system.open_input_stream(path) as stream:
        return json.loads(stream.readall())


@dataclass
class Pages(InputPartition):
    """Items from start to end, in pages."""

    start: int
    end: int


class Reading:
    def __init__(self, options: dict):
        self.address = options["address"]
        self.limit, self.pages = int(options.get("limit", 100)), int(options.get("pagesPerTask", 10))

    def total(self) -> int:
        return int(fetched(self.address, 0, self.limit)["total"])

    def ranges(self, start: int, end: int) -> list[Pages]:
        """Pages begin at multiples of the limit, wherever a batch begins."""
        step = self.limit * self.pages
        edges = [start, *range(start - start % step + step, end, step), end]
        return [Pages(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]

    def items(self, part: Pages) -> Iterator[tuple]:
        for offset in range(part.start - part.start % self.limit, part.end, self.limit):
            found = fetched(self.address, offset, self.limit)["items"]
            if len(found) < min(self.limit, part.end - offset):
                raise Incomplete(f"{len(found)} items at {offset}, where {min(self.limit, part.end - offset)} were expected")
            for k, item in enumerate(found[: self.limit], offset):
                if part.start <= k < part.end:
                    yield k, json.dumps(item, ensure_ascii=False, separators=(",", ":"))


class PageReader(Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return self.ranges(0, self.total()) or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.items(partition)


class PageStream(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": self.total()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.ranges(start["offset"], end["offset"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.items(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "position long, item string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(self.options)


def paged(spark: SparkSession, address: str, limit: int = 100, pages_per_task: int = 10, stream: bool = False) -> DataFrame:
    """position and item (JSON) of all items of a paged address. A page with fewer items than the total promises is an error, not a shorter result."""
    spark.dataSource.register(PagedSource)
    reader = (spark.readStream if stream else spark.read).format("pages")
    return reader.option("address", address).option("limit", limit).option("pagesPerTask", pages_per_task).load()

"""Timelines that a service hands out page by page, as a Spark source.

A service gives at most so many posts of one user at a time, newest first, below a given id.
``spark.read.format("timelines")`` reads the newest ``n`` posts of each user that way: one
task for each range of users, pages until ``n`` posts are there or the timeline ends, so no
page beyond that is asked for. ``spark.readStream.format("timelines")`` goes on from there:
an offset is the newest id that the service had when the batch began, and a batch asks for
the posts after one offset up to the next. A restarted stream reads the same range again,
which neither repeats nor skips a post.

Filters on ``user_id`` and ``id`` are pushed into the calls (with
``spark.sql.python.filterPushdown.enabled``): other users are not asked, and paging begins
below an upper bound and ends at a lower one.

The service is a client with three methods (``Client``); it is named by ``client``
(``module:class``) and made once in each task from the options. ``StoredPages`` serves
timelines stored as Parquet and is what the registered query reads.

Users come from ``client.ranges()``, not from the driver: a range is a small value that a
task resolves itself. A user is in one range; a timeline of any length costs its task a
batch of pages (and, from ``StoredPages``, a row group of each file of its range) in memory.
Ids must grow with time.
"""

from __future__ import annotations

import heapq
import importlib
import time
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

PAGE, LATEST, RETRIES = 200, 3240, 3
#: Pages go on together once they hold so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


class Client(Protocol):
    """What a service must offer. Ids grow with time."""

    def ranges(self) -> list[str]:
        """Names of the ranges of users, each read by one task."""

    def users(self, name: str) -> Iterable[int]:
        """Users of a range."""

    def page(self, user: int, count: int, below: int | None, above: int | None) -> pa.Table:
        """The newest ``count`` posts with ``above < id <= below``, newest first."""

    def newest(self) -> int | None:
        """Largest id of all posts that the service has."""


class Unavailable(Exception):
    """A call that may succeed when it is repeated."""


class _SortedFile:
    """Rows of a file sorted by user and descending id; one row group is held at a time."""

    NONE = -(1 << 63)

    def __init__(self, source):
        self.file = pq.ParquetFile(source)
        meta = self.file.metadata
        columns = self.file.schema_arrow.names
        at = {name: columns.index(name) for name in ("user_id", "id")}
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]

        def bounds(name, which):
            found = [group.column(at[name]).statistics for group in groups]
            return [getattr(s, which) if s is not None and s.has_min_max else self.NONE for s in found]

        # Null users come first and null ids last, as the lowest values do.
        self.first, self.last, self.lowest = bounds("user_id", "min"), bounds("user_id", "max"), bounds("id", "min")
        self.held: tuple[int, pa.Table, np.ndarray, np.ndarray] | None = None

    def users(self) -> Iterator[int]:
        """Each user once, ascending."""
        before = None
        for g in range(len(self.first)):
            found = self.file.read_row_group(g, columns=["user_id"]).column(0).unique().to_pylist()
            yield from (u for u in found if u is not None and u != before)
            before = found[-1] if found else before

    def _group(self, g: int) -> tuple[int, pa.Table, np.ndarray, np.ndarray]:
        if self.held is None or self.held[0] != g:
            self.held = None
            rows = self.file.read_row_group(g)
            rows = rows.filter(rows["user_id"].is_valid())
            users, ids = (pc.fill_null(rows[c].cast(pa.int64()), self.NONE).to_numpy() for c in ("user_id", "id"))
            self.held = g, rows, users, ids
        return self.held

    def page(self, user: int, count: int, below: int | None, above: int | None) -> list[pa.Table]:
        """The first ``count`` rows of a user within the bounds; a null id is within none."""
        g, end = bisect_left(self.last, user), bisect_right(self.first, user)
        if below is not None and end - g > 2:
            # Row groups inside hold nobody else; those wholly above the bound are not read.
            inside = bisect_left(range(g + 1, end - 1), -below, key=lambda k: -self.lowest[k])
            g += 1 + inside if inside else 0
        out = []
        while count > 0 and g < end:
            _, rows, users, ids = self._group(g)
            low, high = np.searchsorted(users, user, "left"), np.searchsorted(users, user, "right")
            down = ~ids[low:high]
            high = low + (np.searchsorted(down, ~above, "left") if above is not None else len(down))
            if below is not None:
                if above is None:
                    high = low + np.searchsorted(down, ~self.NONE, "left")
                low += np.searchsorted(down, ~below, "left")
            part = rows.slice(int(low), int(max(0, min(high - low, count))))
            out.append(part)
            count -= part.num_rows
            g += 1
        return out


class StoredPages:
    """Posts stored by ``store_pages``: a folder for each range, sorted by user and id.

    A page is found by search in a row group, which serves its users one after another, so
    the users of a range, asked in order, read it once.
    """

    def __init__(self, options: dict):
        self.files, root = pyarrow.fs.FileSystem.from_uri(_uri(options["path"]))
        self.root, self._open = root, {}

    def _range(self, name: str) -> list[_SortedFile]:
        if name not in self._open:
            paths = ds.dataset(f"{self.root}/range={name}", filesystem=self.files, format="parquet").files
            self._open = {name: [_SortedFile(self.files.open_input_file(p)) for p in paths]}
        return self._open[name]

    def ranges(self) -> list[str]:
        found = self.files.get_file_info(pyarrow.fs.FileSelector(self.root))
        return sorted(f.base_name.removeprefix("range=") for f in found if f.base_name.startswith("range="))

    def users(self, name: str) -> Iterable[int]:
        return (user for user, _ in groupby(heapq.merge(*[f.users() for f in self._range(name)])))

    def page(self, user: int, count: int, below: int | None, above: int | None) -> pa.Table:
        (parts,) = self._open.values()
        found = [p.page(user, count, below, above) for p in parts]
        newest = pa.concat_tables([t for one in found for t in one] or [parts[0].file.schema_arrow.empty_table()])
        if sum(map(bool, found)) > 1:
            newest = newest.sort_by([("id", "descending")])
        return newest.slice(0, count)

    def newest(self) -> int | None:
        whole = ds.dataset(self.root, filesystem=self.files, format="parquet", partitioning="hive")
        tops = [
            g.statistics["id"]["max"] for f in whole.get_fragments() for g in f.row_groups if "id" in (g.statistics or {})
        ]
        return max(tops, default=None)


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def store_pages(posts: DataFrame, path: str, ranges: int) -> None:
    """Store ``posts(user_id, id, …)`` for ``StoredPages``; appends to what is there."""
    part = F.pmod(F.xxhash64("user_id"), F.lit(ranges)).cast("string").alias("range")
    rows = posts.select("*", part).repartition(ranges, "range").sortWithinPartitions("range", "user_id", F.desc("id"))
    rows.write.mode("append").partitionBy("range").option("parquet.block.size", 1 << 20).parquet(path)


class Range(InputPartition):
    def __init__(self, name: str, below: int | None, above: int | None):
        self.name, self.below, self.above = name, below, above


def _client(options: dict) -> Client:
    module, _, name = options.get("client", f"{__name__}:StoredPages").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def asked(call, *arguments):
    """Result of a call that is repeated a bounded number of times, then fails the task."""
    for attempt in range(RETRIES):
        try:
            return call(*arguments)
        except Unavailable:
            if attempt == RETRIES - 1:
                raise
            time.sleep(0.1 * 2**attempt)


def timeline(client: Client, user: int, n: int | None, page: int, below: int | None, above: int | None) -> Iterator[pa.Table]:
    """Pages of one user until ``n`` posts are there or the timeline ends."""
    left = n
    while left is None or left > 0:
        count = page if left is None else min(page, left)
        got = asked(client.page, user, count, below, above)
        if got.num_rows:
            yield got
        last = got.column("id")[got.num_rows - 1].as_py() if got.num_rows == count else None
        if last is None:
            return
        below = last - 1
        left = None if left is None else left - got.num_rows


class _Pages:
    """What both readers do with a range."""

    def __init__(self, options: dict, schema, n: int | None):
        self.options, self.names, self.n = options, schema.names, n
        self.page = int(options.get("page", PAGE))
        self.users: set[int] | None = None

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        client = _client(self.options)
        held, rows, size = [], 0, 0
        for user in client.users(part.name):
            if self.users is None or user in self.users:
                for page in timeline(client, user, self.n, self.page, part.below, part.above):
                    held.append(page.select(self.names))
                    rows, size = rows + page.num_rows, size + held[-1].nbytes
                    if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield from pa.concat_tables(held).combine_chunks().to_batches()
                        held, rows, size = [], 0, 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()


class TimelineReader(_Pages, DataSourceReader):
    def __init__(self, options: dict, schema):
        super().__init__(options, schema, int(options.get("n", LATEST)))
        self.below: int | None = None
        self.above: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality on users and upper bounds of the id.

        A lower bound is pushed, too, but tested again by Spark. An upper bound changes
        which posts are the newest ``n``, so it is taken as "the newest of those".
        """
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("user_id",) and isinstance(f, EqualTo | In):
                users = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.users = users if self.users is None else self.users & users
            elif column == ("id",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                above = f.value - isinstance(f, GreaterThanOrEqual)
                self.above = above if self.above is None else max(self.above, above)
                yield f
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(name, self.below, self.above) for name in _client(self.options).ranges()]


class TimelineStream(_Pages, DataSourceStreamReader):
    """Posts after one offset up to the next; ``n`` bounds nothing here, as nothing may be lost."""

    def __init__(self, options: dict, schema):
        super().__init__(options, schema, None)
        self.begin = int(options["after"]) if "after" in options else None

    def initialOffset(self) -> dict:
        return {"id": self.begin}

    def latestOffset(self) -> dict:
        return {"id": asked(_client(self.options).newest)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["id"] is None or start["id"] == end["id"]:
            return []
        return [Range(name, end["id"], start["id"]) for name in _client(self.options).ranges()]


class Timelines(DataSource):
    """Options: ``client``, ``n``, ``page``, ``after`` (streams), and those of the client."""

    @classmethod
    def name(cls) -> str:
        return "timelines"

    def schema(self) -> str:
        return "user_id bigint, id bigint, created_ts timestamp, text string"

    def reader(self, schema) -> TimelineReader:
        return TimelineReader(dict(self.options), schema)

    def streamReader(self, schema) -> TimelineStream:
        return TimelineStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Timelines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_timelines(spark: SparkSession, schema: str, n: int = LATEST, page: int = PAGE, **options) -> DataFrame:
    """The newest ``n`` posts of each user."""
    register(spark)
    return spark.read.format("timelines").schema(schema).options(n=n, page=page, **options).load()


def stream_timelines(spark: SparkSession, schema: str, page: int = PAGE, **options) -> DataFrame:
    """New posts of all users, batch by batch."""
    register(spark)
    return spark.readStream.format("timelines").schema(schema).options(page=page, **options).load()

"""The paged source: pages asked for, pushed filters, restarts."""

import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kohorta.session import scratch_path
from kohorta.sources import paged as S

SCHEMA = "user_id bigint, id bigint, text string"


class Logged(S.StoredPages):
    """Writes a file for each page that is asked for."""

    def __init__(self, options):
        super().__init__(options)
        self.log = options.get("log")

    def page(self, user, count, below, above):
        got = super().page(user, count, below, above)
        if self.log:
            os.makedirs(self.log, exist_ok=True)
            name = f"{user}_{count}_{below}_{above}_{got.num_rows}_{uuid.uuid4().hex}"
            open(f"{self.log}/{name}", "w").close()
        return got


class Shaky(S.StoredPages):
    """Every second call fails in a way that may pass."""

    calls = 0

    def page(self, *arguments):
        Shaky.calls += 1
        if Shaky.calls % 2:
            raise S.Unavailable
        return super().page(*arguments)


class Down(S.StoredPages):
    def page(self, *arguments):
        raise S.Unavailable


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    """Tasks import the clients of this module by name."""
    spark.sparkContext.addPyFile(__file__)


def stored(spark, rows, path=None, ranges=3):
    path = path or scratch_path(spark, "service")
    S.store_pages(spark.createDataFrame(rows, SCHEMA), path, ranges)
    return path.removeprefix("file:")


def sample(users=7, posts=23, first=0):
    return [(u, first + i * 100 + u, f"{u}:{i}") for u in range(users) for i in range(posts + u)]


def calls(log):
    return [tuple(None if x == "None" else int(x) for x in n.split("_")[:5]) for n in os.listdir(log)]


def newest(rows, n):
    return sorted(r for u in {r[0] for r in rows} for r in sorted((x for x in rows if x[0] == u), key=lambda x: -x[1])[:n])


@pytest.mark.parametrize(("n", "page"), [(10, 4), (10, 10), (10, 200), (24, 5), (1000, 7), (1, 1)])
def test_newest_posts_of_each_user(spark, n, page):
    rows = sample()
    got = S.read_timelines(spark, SCHEMA, n, page, path=stored(spark, rows))
    assert sorted(map(tuple, got.collect())) == newest(rows, n)


def test_no_page_beyond_n_is_asked_for(spark, tmp_path):
    rows, log = sample(), f"{tmp_path}/log"
    got = S.read_timelines(spark, SCHEMA, 10, 4, path=stored(spark, rows), client="test_paged:Logged", log=log)
    assert got.count() == 70
    asked = calls(log)
    assert len(asked) == 7 * 3 and sorted({a[1] for a in asked}) == [2, 4]
    assert all(sum(a[4] for a in asked if a[0] == u) == 10 for u in range(7))


def test_filters_reach_the_calls(spark, tmp_path):
    rows, path = sample(), stored(spark, sample())
    log = f"{tmp_path}/log"
    got = S.read_timelines(spark, SCHEMA, 50, 5, path=path, client="test_paged:Logged", log=log)
    got = got.filter((F.col("user_id") == 3) & (F.col("id") > 1500)).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] == 3 and r[1] > 1500)
    assert {a[0] for a in calls(log)} == {3} and {a[3] for a in calls(log)} == {1500}


def test_calls_are_repeated_and_then_fail(spark):
    rows = sample(2, 5)
    path = stored(spark, rows, ranges=1)
    got = S.read_timelines(spark, SCHEMA, 4, 2, path=path, client="test_paged:Shaky").collect()
    assert sorted(map(tuple, got)) == newest(rows, 4)
    with pytest.raises(Exception, match="Unavailable"):
        S.read_timelines(spark, SCHEMA, 4, 2, path=path, client="test_paged:Down").collect()


def run_stream(spark, path, target, progress, **options):
    stream = S.stream_timelines(spark, SCHEMA, 3, path=path, **options)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
    query = query.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_restarted_stream_neither_repeats_nor_skips(spark, tmp_path):
    target, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    first, second = sample(4, 6), sample(5, 6, first=10_000)
    path = stored(spark, first)
    read = lambda: sorted(map(tuple, spark.read.schema(SCHEMA).parquet(target).collect()))
    run_stream(spark, path, target, progress)
    assert read() == sorted(first)
    run_stream(spark, path, target, progress)
    assert read() == sorted(first)
    stored(spark, second, path)
    run_stream(spark, path, target, progress)
    assert read() == sorted(first + second)


def test_a_stream_asks_only_for_new_posts(spark, tmp_path):
    path = stored(spark, sample(3, 9))
    reader = S.TimelineStream({"path": path, "after": "600"}, spark.createDataFrame([], SCHEMA).schema)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert (start, end) == ({"id": 600}, {"id": 1002}) and reader.partitions(end, end) == []
    assert {(p.below, p.above) for p in reader.partitions(start, end)} == {(1002, 600)}
    run_stream(spark, path, f"{tmp_path}/out", f"{tmp_path}/p", after=600)
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in sample(3, 9) if r[1] > 600)


def test_stored_pages(spark):
    client = S.StoredPages({"path": stored(spark, sample(3, 4), ranges=1)})
    (name,) = client.ranges()
    assert sorted(client.users(name)) == [0, 1, 2] and client.newest() == 502
    page = client.page(1, 2, 250, None)
    assert isinstance(page, pa.Table) and page.column("id").to_pylist() == [201, 101]
    assert client.page(1, 9, None, 300).column("id").to_pylist() == [401, 301]


def test_a_row_group_is_read_once_for_all_its_users(spark, monkeypatch):
    """Calls for users in order read each row group once, however many users it holds."""
    rows = [(None, 7, "nobody"), *sample(300, 40)]
    client = S.StoredPages({"path": stored(spark, rows, ranges=1)})
    files = client._range("0")
    read, plain = [], S.pq.ParquetFile.read_row_group
    monkeypatch.setattr(
        S.pq.ParquetFile, "read_row_group", lambda self, g, *a, **k: read.append((id(self), g)) or plain(self, g, *a, **k)
    )
    got = [r for u in client.users("0") for page in S.timeline(client, u, 30, 8, None, None) for r in page.to_pylist()]
    assert sorted(map(tuple, (r.values() for r in got))) == newest(sample(300, 40), 30)
    assert len(read) <= 2 * sum(len(f.first) for f in files)


def test_pages_of_a_user_of_many_row_groups(spark, tmp_path):
    """A long timeline over small row groups, from two files, with null ids at its end."""
    import pyarrow.parquet as pq

    (tmp_path / "range=0").mkdir()
    for k in (0, 1):
        ids = [(1, 5), (1, 4)] + [(2, i) for i in range(98 + k, -1, -2)] + [(2, None)] + [(3, 8)]
        users, numbers = zip(*ids, strict=True)
        table = pa.table({"user_id": pa.array(users, pa.int64()), "id": pa.array(numbers, pa.int64())})
        pq.write_table(table, tmp_path / "range=0" / f"{k}.parquet", row_group_size=5)
    client = S.StoredPages({"path": str(tmp_path)})
    assert list(client.users("0")) == [1, 2, 3]
    page = lambda *a: client.page(*a).column("id").to_pylist()
    assert [page(2, 4, below, None) for below in (None, 50, 2, -1)] == [[99, 98, 97, 96], [50, 49, 48, 47], [2, 1, 0], []]
    assert page(2, 9, 60, 55) == [60, 59, 58, 57, 56] and page(2, 200, None, 97) == [99, 98]
    assert page(2, 200, None, None) == [*range(99, -1, -1), None, None] and page(9, 5, None, None) == []
    walked = [i for t in S.timeline(client, 2, None, 7, None, None) for i in t.column("id").to_pylist()]
    assert walked == list(range(99, -1, -1))

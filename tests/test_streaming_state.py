"""Keyed state for first copies, and rejected messages."""

import json
import time

import pytest
from pyspark.sql import functions as F

from kohorta.session import scratch_path
from kohorta.sources import tables
from kohorta.streaming import first_copies as C
from kohorta.streaming import rejects as R

DAY = "Mon Jan 0{} 10:00:00 +0000 2024"


def message(number, day=DAY.format(1), text="a view", user=1):
    return json.dumps({"id": number, "created_at": day, "text": text, "user": {"id": user}, "lang": "en"})


def drop(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    (folder / f".{name}").rename(folder / name)


def posts_stream(spark, folder):
    return tables.parse_messages(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)))


def run(spark, folder, out, progress, **rule):
    query = C.start_first_copies(posts_stream(spark, folder), out, progress, block=100, once=True, **rule)
    assert query.awaitTermination(60)


def stored(spark, out):
    rows = spark.read.schema("id bigint, text string, late boolean, user struct<id: bigint>, id_block bigint").parquet(out)
    return sorted((r.id, r.text, r.late) for r in rows.collect())


def test_late_copies_go_and_late_posts_stay_over_a_restart(spark, tmp_path):
    folder, out, progress = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/progress"
    far = "Mon Jan 06 10:00:00 +0000 2098"
    drop(folder, "1", [message(1, DAY.format(5)), message(2, DAY.format(5)), message(2, DAY.format(4), "earlier copy"), message(3, far)])
    run(spark, folder, out, progress)
    drop(folder, "2", [message(1, DAY.format(1), "late copy"), message(4, "Mon Jan 05 10:00:00 +0000 2015", "late post")])
    run(spark, folder, out, progress)
    want = [(1, "a view", False), (2, "earlier copy", True), (3, "a view", False), (4, "late post", True)]
    got = stored(spark, out)
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    assert dict((r[0], r[2]) for r in got)[4] is True
    drop(folder, "3", [message(4, text="copy after the restart"), message(205), message(2), message(3)])
    run(spark, folder, out, progress)
    assert stored(spark, out) == sorted([*got, (205, "a view", False)])
    rows = spark.read.parquet(out).select("id", "user.id", "id_block").collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {(i, 1, i // 100) for i in (1, 2, 3, 4, 205)}


def test_ids_are_forgotten_after_the_horizon(spark, tmp_path):
    folder, out, progress = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/progress"
    drop(folder, "1", [message(7), message(8)])
    run(spark, folder, out, progress, horizon=3_000)
    time.sleep(4)
    drop(folder, "2", [message(7)])
    run(spark, folder, out, progress, horizon=3_000)
    assert [r[0] for r in stored(spark, out)] == [7, 7, 8]


LINES = [
    (message(1), None), ("", "empty"), ("   ", "empty"), ("{", "malformed"), ('{"id": 1', "malformed"), ("[1, 2]", "malformed"),
    ('{"id": "x", "text": "t"}', "malformed"), ('{"text": "t", "user": {"id": 1}}', "no id"),
    ('{"id": 9, "text": "t", "created_at": "Mon Jan 01 10:00:00 +0000 2024"}', "no author"), (message(2, "yesterday"), "no time"),
    ('{"id": 9, "user": {"id": 1}, "created_at": "Mon Jan 01 10:00:00 +0000 2024"}', "no text"),
]


@pytest.mark.parametrize(("line", "reason"), LINES)
def test_reasons(spark, line, reason):
    frame = spark.createDataFrame([(line,)], "value string")
    assert R.with_reason(frame).first().reason == reason


def test_null_lines_are_empty(spark):
    assert R.with_reason(spark.createDataFrame([(None,)], "value string")).first().reason == "empty"


def test_a_repeated_batch_writes_nothing_twice(spark):
    store, rejects = scratch_path(spark, "store"), scratch_path(spark, "rejects")
    batch = spark.createDataFrame([(x,) for x, _ in LINES], "value string")
    for _ in range(2):
        R.split_batch(batch, 5, store, rejects)
    R.split_batch(batch, 6, store, rejects, ["view"])
    assert [r.id for r in tables.read_collection(spark, store).collect()] == [1]
    kept = R.read_rejected(spark, rejects).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in kept} == {5: len(LINES) - 1, 6: len(LINES) - 1}


def test_posts_and_rejects_add_up_over_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    store, rejects, progress = (f"{tmp_path}/{n}" for n in ("store", "rejects", "progress"))
    drop(folder, "1", [message(i) for i in range(5)] + ["{", message(9, "never")])

    def go():
        R.start_ingest_with_rejects(spark, str(folder), store, rejects, progress, ["VIEW"], 1, 100, True).awaitTermination()

    go()
    drop(folder, "2", [message(i) for i in range(3, 8)] + ["}"])
    go()
    go()
    assert sorted(r.id for r in tables.read_collection(spark, store).collect()) == list(range(8))
    assert sorted((r.reason, r.line) for r in R.read_rejected(spark, rejects).collect()) == sorted(
        [("malformed", "{"), ("malformed", "}"), ("no time", message(9, "never"))]
    )
    assert R.read_rejected(spark, rejects).filter(F.col("batch") == 0).count() == 2

"""First copies of posts by keyed state: a late copy is told from a late post.

State is kept for each block of ids (``with_id_block``): the ids seen there with the time at
which the first copy arrived, as one packed value, and the newest time of a post there. A
post whose id is in the state is a copy and goes; one whose id is not is new however old its
own time is, and ``late`` says whether it lies more than ``late`` behind the newest post of
its block. A clock that runs ahead moves nothing: times count up to the arrival.

The state is bounded by rule. An id is forgotten ``horizon`` after its first copy arrived;
a block that nothing reaches for that long is dropped by a timer, and by its time to live
should the timer be missed. So a block holds at most the ids that arrived in it within the
horizon, 16 bytes each, and the number of blocks is that of the blocks reached within it.

Of copies in one batch the one with the earliest time stays. Posts without id are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from kohorta.streaming.ingest import DAY_OF_IDS, with_id_block

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


class FirstCopies(StatefulProcessor):
    """Passes on the first copy of each id of a block; times are milliseconds."""

    def __init__(self, columns: list[str], horizon: int, late: int):
        self.columns, self.horizon, self.late = columns, horizon, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = "ids binary, arrived binary, newest bigint"
        self.seen = handle.getValueState("seen", packed, ttlDurationMs=2 * self.horizon)

    def _known(self, now: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids that are still known, ascending, their arrivals, and the newest time."""
        state = self.seen.get()
        if state is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), -(1 << 62)
        ids, arrived = (np.frombuffer(bytes(state[k]), np.int64) for k in (0, 1))
        alive = arrived > now - self.horizon
        return ids[alive], arrived[alive], state[2]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        ids, arrived, newest = self._known(now)
        posts = pd.concat(list(rows)).sort_values(["id", "created_ts"], kind="stable").drop_duplicates("id")
        new = posts[~np.isin(posts["id"].to_numpy(), ids)].copy()
        if len(new):
            times = new["created_ts"].astype("datetime64[ms]").astype("int64").to_numpy()
            newest = max(newest, int(np.minimum(times, now).max()))
            new["late"] = times < newest - self.late
            ids = np.concatenate([ids, new["id"].to_numpy(np.int64)])
            arrived = np.concatenate([arrived, np.full(len(new), now)])
            order = np.argsort(ids, kind="stable")
            self.seen.update((ids[order].tobytes(), arrived[order].tobytes(), newest))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.horizon)
            yield new[[*self.columns, "late"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not len(self._known(timerValues.getCurrentProcessingTimeInMs())[0]):
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_copies(posts: DataFrame, horizon: int = 7 * DAY, late: int = DAY, block: int = DAY_OF_IDS) -> DataFrame:
    """``posts(id, created_ts, …)``, a stream, without copies, and whether each is ``late``.

    ``horizon`` and ``late`` are milliseconds. Structs travel as JSON, since state operators
    take flat columns.
    """
    nested = {f.name: f.dataType for f in posts.schema if isinstance(f.dataType, StructType)}
    flat = posts.withColumns({n: F.to_json(n) for n in nested}) if nested else posts
    keyed = with_id_block(flat.filter("id IS NOT NULL"), block)
    out = StructType([*flat.schema.fields, StructField("late", BooleanType())])
    unique = keyed.groupBy("id_block").transformWithStateInPandas(
        FirstCopies(flat.columns, horizon, late), out, outputMode="Append", timeMode="ProcessingTime"
    )
    return unique.withColumns({n: F.from_json(n, kind) for n, kind in nested.items()}) if nested else unique


def start_first_copies(
    posts: DataFrame, path: str, checkpoint: str, block: int = DAY_OF_IDS, once: bool = False, **rule
) -> StreamingQuery:
    """Write the first copies of ``posts`` to a store partitioned by block of ids.

    Values of blocks live in RocksDB on the executors and as changes in ``checkpoint``, so
    neither a restart nor a lost executor forgets an id. ``once`` takes what is there as one
    batch and ends; a run of several batches would not end, as timers may always be due.
    """
    spark = posts.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        unique = with_id_block(first_copies(posts, block=block, **rule), block)
        writer = unique.writeStream.format("parquet").outputMode("append").partitionBy("id_block")
        writer = writer.option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(once=True) if once else writer).start()
    finally:
        spark.conf.set(name, before)

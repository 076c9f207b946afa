"""Stops of a photo stream in the order of the photos' own times, however late they arrive.

Photos wait in an owner's state until the watermark has passed them; a timer set to the
first waiting photo then takes all that are due, in time order. So the labels are those
of the batch fold, whatever the arrival order within the allowed lateness. An owner
without photos for longer than ``idle`` is forgotten by a second use of the timer.

Defined results: photos without a position or a time are left out (no watermark ever
passes the latter); photos later than the allowed lateness are dropped, as in every
watermarked operator; equal times go by photo_id; of an owner who returns after being
forgotten, stops are numbered from 0 again; photos that the last watermark has not
passed still wait when the stream ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from itinera.operators.clusters import PhotoFold

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers and lists need; others are left as they were."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Labels(StatefulProcessor):
    """owner, photo_id, cluster of the photos that the watermark has passed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "k int, n long, lat double, lon double, before long")
        self.waiting = handle.getListState("waiting", "us long, photo_id long, lat double, lon double")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """Have one timer: the earliest that is asked for."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is not None and held <= at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            held = list(zip(*(part[c].tolist() for c in ("us", "photo_id", "lat", "lon")), strict=True))
            self.waiting.appendList([(int(us), int(photo), lat, lon) for us, photo, lat, lon in held])
            first = min([first, *(int(x[0]) for x in held)], key=lambda x: (x is None, x))
        if first is not None:
            self._wake(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] // 1000 < passed], [r for r in rows if r[0] // 1000 >= passed]
        state = self.fold.get() if self.fold.exists() else (-1, 0, 0.0, 0.0, None)
        if not due and not later and state[4] is not None and state[4] // 1000 + self.idle_ms < passed:
            self.fold.clear()
            return
        fold = PhotoFold(*state)
        labels = [fold(us, lat, lon) for us, _, lat, lon in due]
        if due:
            self.fold.update((fold.k, fold.n, fold.lat, fold.lon, fold.before))
            self.waiting.put(later) if later else self.waiting.clear()
        self._wake(later[0][0] // 1000 + 1 if later else (fold.before // 1000 + self.idle_ms + 1))
        if due:
            yield pd.DataFrame({"owner": [key[0]] * len(due), "photo_id": [r[1] for r in due], "cluster": labels})

    def close(self) -> None:
        pass


def label_in_order(photos: DataFrame, late: str = "1 hour", idle_days: int = 400) -> DataFrame:
    """owner, photo_id, cluster of a stream of photos (owner, photo_id, ts, lat, lon). Start it within ``keyed_state``."""
    placed = photos.filter("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = placed.select("owner", "photo_id", "ts", "lat", "lon", F.unix_micros("ts").alias("us"))
    return rows.groupBy("owner").transformWithStateInPandas(
        Labels(idle_days * 86_400_000), "owner long, photo_id long, cluster int", "append", "eventTime"
    )

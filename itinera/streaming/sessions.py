"""Streaming forms of the photo operators: sessions, clusters, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.operators.clusters import GAP_HOURS, PhotoFold


def session_stream(photos: DataFrame, late: str = "1 hour", hours: int = GAP_HOURS) -> DataFrame:
    """Sessions of a stream of photos (owner, ts): owner, start, last, n, closed by a gap of ``hours``.

    Sessions are told when the watermark has passed their end; open ones wait.
    """
    marked = photos.withWatermark("ts", late)
    window = F.session_window("ts", f"{hours} hours")
    grouped = marked.groupBy("owner", window.alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return grouped.select("owner", "start", "last", "n")


def daily_counts(photos: DataFrame, late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Photos of each owner by tumbling or sliding windows: owner, start, n."""
    marked = photos.withWatermark("ts", late)
    grouped = marked.groupBy("owner", F.window("ts", window, slide or window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("owner", F.col("w.start").alias("start"), "n")


def label_stream(photos: DataFrame) -> DataFrame:
    """Each photo of a stream with its stop: owner, photo_id, cluster, as it arrives.

    The state of an owner is that of the batch fold: cluster, photos in it, sums of
    positions and the time before, if there was one. It must outlive any gap, for the
    next cluster's number follows from it; an owner costs these few numbers. Photos of
    one batch are taken in time order, undated ones last; a photo older than those of
    an earlier batch joins where it arrives.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        k, n, lat, lon, dated, before = state.get if state.exists else (-1, 0, 0.0, 0.0, False, 0)
        fold = PhotoFold(k, n, lat, lon, before if dated else None)
        rows = pd.concat(list(parts)).sort_values(["us", "photo_id"], na_position="last")
        us = [None if pd.isna(t) else int(t) for t in rows["us"]]
        labels = [fold(*x) for x in zip(us, rows["lat"].tolist(), rows["lon"].tolist(), strict=True)]
        state.update((fold.k, fold.n, fold.lat, fold.lon, fold.before is not None, fold.before or 0))
        yield pd.DataFrame({"owner": key[0], "photo_id": rows["photo_id"].to_numpy(), "cluster": labels})

    placed = photos.filter("lat IS NOT NULL AND lon IS NOT NULL").select("owner", "photo_id", "lat", "lon", F.unix_micros("ts").alias("us"))
    return placed.groupBy("owner").applyInPandasWithState(
        run, "owner long, photo_id long, cluster int", "k int, n long, lat double, lon double, dated boolean, before long", "append", "NoTimeout"
    )

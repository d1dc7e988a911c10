"""Debouncing in event time: changes of a key that follow each other closely make one burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bursts(events: DataFrame, quiet: str, keys: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """(keys, first_ts, last_ts, n_events): a burst ends when nothing comes for ``quiet``.

    Runs on batches and on streams alike; a stream needs ``late``, how long to wait for late events, and emits each burst
    once, after the watermark has passed its end.
    """
    if late is not None:
        events = events.withWatermark(ts, late)
    return events.groupBy(*keys, F.session_window(ts, quiet)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events")).drop("session_window")

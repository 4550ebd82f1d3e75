"""Streaming twins of batch train operators: tumbling counts, session collapse, keyed carry-forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, time: str, by: list[str], window: str, late: str) -> DataFrame:
    """Counts per window of event time; rows later than the watermark are dropped (WN10)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))


def session_starts(stream: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """First event of each run whose gaps stay below ``gap``, as session windows (WN2)."""
    sessions = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(*by, F.col("session_window.start").alias("start"), "n")


def running_rates(stream: DataFrame, by: str, frame: str, idle: str | None = None) -> DataFrame:
    """Per key and batch: events so far and the last frame, from state kept between batches (IT2's keyed fold).

    With ``idle`` (processing time, as ``7 days``) a key without events for that long is forgotten and counts anew after
    it, so state is bounded by the keys at work; a stream with timeouts never runs out of batches. Without, every key stays.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, -1)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf[frame].max()))
        state.update((n, last))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({by: [key[0]], "n": [n], "last": [last]})

    shape = f"{by} long, n long, last long"
    return stream.groupBy(by).applyInPandasWithState(fold, shape, "n long, last long", "update", "ProcessingTimeTimeout" if wait else "NoTimeout")

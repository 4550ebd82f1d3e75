"""Templates carried forward over the windows of a recording, with new units founded on the way (IT2, IT3).

Windows are an ordered fold on the driver, whose state is a table of templates per window; a window's matching
and averaging are spread over its blocks. Each window's tables are written before the next begins, so a run that
was killed goes on after the last window that it finished.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.arrays import max_shift_cosine
from chronoweave.operators.matcher import match_recording
from chronoweave.plans.storage import exists, own_path

EVENTS = "grp long, win long, frame long, unit long, shift double, scale double, r double"
BIRTHS = "grp long, win long, unit long, n long, snr double, likeness double"
BANK = "grp long, unit long, wf array<double>"


class Fold(NamedTuple):
    """events ``(grp, win, frame, unit, shift, scale, r)``, births ``(grp, win, unit, n, snr, likeness)`` and the last bank ``(grp, unit, wf)``."""

    events: DataFrame
    births: DataFrame
    bank: DataFrame


def mean_templates(trace: DataFrame, train: DataFrame, samples: int, channels: int) -> DataFrame:
    """``(grp, unit, wf, n, snr)``: mean of the trace where a unit's templates start, sample by sample, of whole snippets only.

    snr: the mean's largest value against the root mean variance of the snippets about it (null without variance).
    """
    frames = train.select("grp", "unit", F.col("frame").alias("start"))
    inside = trace.groupBy("grp").agg(F.min("frame").alias("_first"), F.max("frame").alias("_last"))
    frames = frames.join(inside, "grp").where((F.col("start") >= F.col("_first")) & (F.col("start") + (samples - 1) <= F.col("_last")))
    places = frames.select("grp", "unit", F.posexplode(F.sequence(F.col("start"), F.col("start") + (samples - 1))).alias("at", "frame"))
    met = places.join(trace, ["grp", "frame"]).groupBy("grp", "unit", "at", "channel")
    met = met.agg(F.avg("value").alias("x"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n"))
    out = met.groupBy("grp", "unit").agg(
        F.array_sort(F.collect_list(F.struct("at", "channel", "x"))).alias("_w"), F.max("n").alias("n"), F.max(F.abs("x")).alias("_peak"), F.avg("v").alias("_v")
    )
    out = out.where(F.size("_w") == samples * channels)
    return out.select("grp", "unit", F.transform("_w", lambda s: s["x"]).alias("wf"), "n", F.when(F.col("_v") > 0, F.col("_peak") / F.sqrt("_v")).alias("snr"))


def _likeness(x: np.ndarray, y: np.ndarray, shifts: int) -> float:
    """Largest cosine of two templates (samples, channels) over shifts; -1 where none is defined."""
    best = -1.0
    for s in range(-shifts, shifts + 1):
        size = len(x) - abs(s)
        a, b = x[max(0, s) :][: max(0, size)], y[max(0, -s) :][: max(0, size)]
        scale = float(np.linalg.norm(a) * np.linalg.norm(b))
        best = max(best, float((a * b).sum()) / scale) if scale > 0 else best
    return best


def admitted(candidates: DataFrame, bank: DataFrame, samples: int, shifts: int, new_below: float) -> DataFrame:
    """``(grp, unit, n, snr, likeness, wf)`` of candidates that no template of their group is like, those just admitted included.

    The largest come first; a group's templates are few. Units so founded have negative numbers, each its own.
    """
    columns = ["grp", "unit", "n", "snr", "likeness", "wf"]

    def run(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        shape = lambda w: np.asarray(w, float).reshape(samples, -1)
        shown = [shape(w) for w in known.wf]
        next_, out = min([0, *known.unit.tolist()]) - 1, []
        for c in mine.sort_values(["n", "unit"], ascending=[False, True]).itertuples():
            like = max((_likeness(shape(c.wf), t, shifts) for t in shown), default=-1.0)
            if like < new_below:
                shown.append(shape(c.wf))
                out.append((c.grp, next_, c.n, c.snr, like, c.wf))
                next_ -= 1
        return pd.DataFrame(out, columns=columns)

    pairs = candidates.groupBy("grp").cogroup(bank.withColumnRenamed("grp", "of_grp").groupBy("of_grp"))
    return pairs.applyInPandas(run, "grp long, unit long, n long, snr double, likeness double, wf array<double>")


def carry_forward(
    trace: DataFrame, bank: DataFrame, window: int, samples: int, channels: int, *, threshold: float | None = None, factor: float | None = None,
    gate: float | None = None, least: int = 100, cap: float | None = None, shifts: int = 0, every: int = 0,
    sorter: Callable[[DataFrame], DataFrame] | None = None, born: tuple[int, float] = (100, 5.0), new_below: float = 0.8,
    store: str | None = None, block: int = 1 << 15, **given,
) -> Fold:
    """Matches a recording window by window; what matched becomes the next window's templates.

    trace: ``(grp, channel, frame, value)``; bank: ``(grp, unit, wf)``. A unit with at least ``least`` events in a
    window takes their mean as its template, unless that is less like the old one (over ``shifts``) than ``cap``;
    others keep theirs. Every ``every`` windows the ``sorter`` gives trains ``(grp, unit, frame)`` of the window, frames
    where templates start; a unit of born[0] events and a peak of born[1] times its spread that is unlike all
    templates of its group joins the bank from the next window on. The rest goes to
    :func:`chronoweave.operators.matcher.match_recording`.

    ``store``: a folder; windows that a former run finished there with the same settings are not done again.
    """
    if every and sorter is None:
        raise ValueError("founding units takes a sorter")
    spark = trace.sparkSession
    store = store or own_path(spark, "carry-forward")
    first, last = trace.agg(F.min("frame"), F.max("frame")).first()
    now = bank.select(F.col("grp").cast("long"), F.col("unit").cast("long"), F.col("wf").cast("array<double>"))
    events, births = [], []
    windows = 0 if first is None else (last - first) // window + 1
    for win in range(windows):
        path = f"{store}/window-{win:06d}"
        founding = bool(every) and (win + 1) % every == 0
        if not exists(spark, f"{path}/bank/_SUCCESS"):
            part = trace.where((F.col("frame") >= first + win * window) & (F.col("frame") < first + (win + 1) * window))
            matched = match_recording(part, now, threshold, factor=factor, gate=gate, samples=samples, block=block, **given)
            matched.select("grp", F.lit(win).cast("long").alias("win"), "frame", "unit", "shift", "scale", "r").write.mode("overwrite").parquet(f"{path}/events")
            seen = spark.read.schema(EVENTS).parquet(f"{path}/events")
            new = mean_templates(part, seen, samples, channels).where(F.col("n") >= least).select("grp", "unit", F.col("wf").alias("_new"))
            both = now.join(new, ["grp", "unit"], "left")
            like = max_shift_cosine(F.col("wf"), F.col("_new"), samples, channels, shifts) >= (-2.0 if cap is None else cap)
            then = both.select("grp", "unit", F.when(F.col("_new").isNotNull() & like, F.col("_new")).otherwise(F.col("wf")).alias("wf"))
            if founding:
                then.write.mode("overwrite").parquet(f"{path}/kept")
                then = spark.read.schema(BANK).parquet(f"{path}/kept")
                found = mean_templates(part, sorter(part), samples, channels).where((F.col("n") >= born[0]) & (F.coalesce("snr", F.lit(float("inf"))) >= born[1]))
                admitted(found, then, samples, shifts, new_below).write.mode("overwrite").parquet(f"{path}/founded")
                new = spark.read.parquet(f"{path}/founded")
                rows = new.select("grp", F.lit(win).cast("long").alias("win"), "unit", "n", "snr", "likeness")
                rows.write.mode("overwrite").parquet(f"{path}/births")
                then = then.unionByName(new.select("grp", "unit", "wf"))
            then.write.mode("overwrite").parquet(f"{path}/bank")  # the last of a window's tables: with it the window is done
        now = spark.read.schema(BANK).parquet(f"{path}/bank")
        events.append(f"{path}/events")
        births += [f"{path}/births"] if founding else []
    read = lambda shape, paths: spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
    return Fold(read(EVENTS, events), read(BIRTHS, births), now)


def window_counts(events: DataFrame) -> DataFrame:
    """``(grp, win, unit, n)``: the matrix of events per window and unit, zeros left out (IT2)."""
    return events.groupBy("grp", "win", "unit").agg(F.count(F.lit(1)).alias("n"))

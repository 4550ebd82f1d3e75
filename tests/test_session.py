"""Chunked tracking from raw traces, state-driven windows, and traces with names."""

import numpy as np
import pandas as pd
import pytest

from chronoweave.operators import session as N
from chronoweave.operators import signal as G
from chronoweave.operators import trains as T
from chronoweave.plans.storage import own_path
from chronoweave.sources import stores
from tests.test_matcher import CHANNELS, LENGTH, long_trace, made_bank


def test_units_are_tracked_across_chunks_and_runs_resume(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = made_bank()
    trace = rng.normal(size=(4000, CHANNELS)) * 0.03
    planted = {0: range(20, 3950, 90), 2: range(60, 3950, 130)}
    for u, at in planted.items():
        for a in at:
            trace[a : a + LENGTH] += made[u]
    table = long_trace(spark, trace)
    chunks = T.plan_chunks(spark, 4000, 2000, 0.5)

    def sorter(part):
        """Units named by chance, anew in each chunk."""
        first = part.agg({"frame": "min"}).first()[0]
        last = part.agg({"frame": "max"}).first()[0]
        rows = [(0, (u + first) % 7, a) for u, at in planted.items() for a in at if first <= a and a + LENGTH <= last]
        return spark.createDataFrame(rows, "grp long, unit long, frame long")

    store, real, calls = own_path(spark, "session"), N.match_recording, []
    given = {"factor": 0.3, "gate": 0.8, "store": store, "block": 700}

    def dies(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*args, **kwargs)

    monkeypatch.setattr(N, "match_recording", dies)
    with pytest.raises(RuntimeError, match="killed"):
        N.track_recording(table, chunks, sorter, LENGTH, CHANNELS, 2, **given)
    assert N.load_chunks(spark, store, "bank", N.BANK).select("chunk").distinct().count() == 2
    done = N.track_recording(table, chunks, sorter, LENGTH, CHANNELS, 2, **given)
    assert len(calls) == 3 + chunks.count() - 2
    out = done.train.toPandas()
    assert out.global_id.nunique() == 2
    want = {u: set(at) for u, at in planted.items()}
    for _, part in out.groupby("global_id"):
        u = 0 if len(part) > 35 else 2
        near = {a for a in want[u] if (abs(part.frame - a) <= 1).any()}
        assert len(near) >= len(want[u]) - 5 and len(part) == len(near)  # where both overlap, the gate may leave one out
    edges = done.edges.collect()
    assert len(edges) == 2 * (chunks.count() - 1) and all(r.jaccard > 0.9 and r.cos > 0.99 for r in edges)
    assert N.load_chunks(spark, own_path(spark, "none"), "events", N.EVENTS).count() == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_state_windows(spark, block):
    rng = np.random.default_rng(5)
    rows = {c: np.cumsum(rng.normal(size=700)) for c in (1, 2)}
    df = spark.createDataFrame([(0, c, f, float(v)) for c, x in rows.items() for f, v in enumerate(x)], "grp long, channel long, frame long, value double")
    apart = spark.createDataFrame([(100, 250), (600, 610)], "start long, end long")
    got = {(r.channel, r.label, r.centre) for r in G.state_windows(df, 30, apart, block).collect()}
    want = set()
    for c, x in rows.items():
        y = np.array([x[max(0, i - 15) : i + 15].mean() for i in range(700)])
        open_ = np.ones(700, bool)
        open_[100:251] = open_[600:611] = False
        want |= {(c, "low", float(np.flatnonzero(open_)[y[open_].argmin()])), (c, "high", float(np.flatnonzero(open_)[y[open_].argmax()])), (c, "interval", 175.0), (c, "interval", 605.0)}
    assert got == want
    assert G.state_windows(df, 1, None, block).count() == 4 and G.state_windows(df.limit(0), 5, apart, block).count() == 0


def test_channel_names_fall_back(spark, tmp_path):
    base = pd.DataFrame({"channel": [3, 4], "value": [1.0, 2.0]})
    names = lambda df, **more: (spark.createDataFrame(df.assign(**more)).write.parquet(p := f"{tmp_path}/{len(more)}{'-'.join(more)}"), [r.channel_name for r in stores.open_traces(spark, p).orderBy("channel").collect()])[1]
    assert names(base) == ["3", "4"]
    assert names(base, channel_names=["a", "b"]) == ["a", "b"]
    assert names(base, channel_names=["a", "b"], channel_name=["x", None]) == ["x", "b"]
    spark.range(2).write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no channels"):
        stores.open_traces(spark, f"{tmp_path}/none")

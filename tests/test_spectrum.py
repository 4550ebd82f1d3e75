"""Spectra of event trains against direct sums."""

import numpy as np
import pytest

from chronoweave.operators import spectrum as P


def direct(frames, n, low, high):
    k = np.arange(low, high + 1)
    turn = np.exp(-2j * np.pi * ((k[:, None] * frames[None, :].astype(object)) % n).astype(float) / n)
    return np.abs(turn.sum(axis=1)) ** 2 / len(frames)


@pytest.mark.parametrize(("n", "low", "high"), [(1000, 0, 40), (99_991, 300, 1500), (5_000_000_000, 70_000, 70_300), (600, 5, 5)])
def test_spectra_equal_direct_sums(spark, n, low, high):
    rng = np.random.default_rng(2)
    trains = {1: rng.integers(0, n, 400), 2: np.unique((np.arange(300) * (n / 300)).astype(np.int64)), 3: np.array([0]), 4: np.array([n - 1, 0, n // 3])}
    rows = [(u, int(f) + 77) for u, x in trains.items() for f in x] + [(1, 76), (1, 77 + n), (9, 3)]
    df = spark.createDataFrame(rows, "unit long, frame long").repartition(3)
    got = P.event_spectrum(df, 77, n, low, high).toPandas()
    assert set(got.unit) == set(trains)
    for u, x in trains.items():
        one = got[got.unit == u].sort_values("k")
        want = direct(x, n, low, high)
        assert one.k.tolist() == list(range(low, high + 1)) and np.abs(one.power - want).max() < 1e-6 * max(1.0, want.max())


def test_the_rate_of_a_jittered_train_is_found(spark):
    rng = np.random.default_rng(3)
    n, period = 1_000_000, 3021.7
    x = np.rint(np.arange(0, n, period) + rng.normal(size=len(np.arange(0, n, period))) * 60).astype(np.int64)
    df = spark.createDataFrame([(5, int(f)) for f in x if 0 <= f < n], "unit long, frame long")
    r = P.event_rate(df, 0, n, 200, 600).first()
    assert abs(n / r.cycles - period) < 5 and r.snr > 20
    power = direct(x[(x >= 0) & (x < n)], n, 200, 600)
    assert r.k == 200 + int(power.argmax()) and r.power == pytest.approx(power.max()) and r.snr == pytest.approx(power.max() / np.median(power))
    assert P.event_rate(df.limit(0), 0, n, 200, 600).collect() == []
    with pytest.raises(ValueError, match="band"):
        P.event_rate(df, 0, n, 5, 4)

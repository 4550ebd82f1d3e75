"""Recursive filters in blocks against whole-channel loops."""

import numpy as np
import pandas as pd
import pytest

from chronoweave.operators import recursive as R


def plain(x, sections):
    """Forwards and backwards, a sample at a time, with reflected ends."""
    cascade = R.Cascade(sections)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for _ in range(2):
        z, out = cascade.settled * y[0], []
        for v in y:
            o, z = cascade.step(z, v)
            out.append(o)
        y = np.array(out)[::-1]
    return y[pad : pad + len(x)]


def response(sections, f):
    z = np.exp(-2j * np.pi * f)
    return np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, a1, a2 in sections])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_responses(order):
    low, high, band = R.butterworth(order, high=0.1), R.butterworth(order, low=0.1), R.butterworth(order, 0.05, 0.2)
    half = pytest.approx(np.sqrt(0.5))
    assert abs(response(low, 0)) == pytest.approx(1) and abs(response(low, 0.1)) == half and abs(response(low, 0.4999)) < 1e-2
    assert abs(response(high, 0.5)) == pytest.approx(1) and abs(response(high, 0.1)) == half and abs(response(high, 1e-5)) < 1e-2
    assert abs(response(band, 0.05)) == half and abs(response(band, 0.2)) == half and abs(response(band, 1e-6)) < 1e-2
    # maximally flat: the law of the prototype at every frequency, by the bilinear map
    for f in (0.02, 0.08, 0.15, 0.3):
        assert abs(response(low, f)) ** 2 == pytest.approx(1 / (1 + (np.tan(np.pi * f) / np.tan(np.pi * 0.1)) ** (2 * order)))


def test_known_sections():
    """The textbook second-order low pass at a quarter of the rate."""
    b0, b1, b2, a1, a2 = R.butterworth(2, high=0.25)[0]
    assert (b0, b1, b2) == pytest.approx((0.2928932188, 0.5857864376, 0.2928932188)) and a1 == pytest.approx(0, abs=1e-12) and a2 == pytest.approx(0.1715728753)
    for bad in ({}, {"low": 0.6}, {"high": 0.0}):
        with pytest.raises(ValueError, match="bound"):
            R.butterworth(2, **bad)


def test_blocks_run_like_samples():
    rng = np.random.default_rng(0)
    cascade = R.Cascade(R.butterworth(3, 0.02, 0.11))
    for n in (0, 1, R.STEP - 1, R.STEP, 3 * R.STEP + 17):
        x, z = rng.normal(size=n), rng.normal(size=len(cascade.c))
        y, end = cascade.run(x, z)
        out = []
        for v in x:
            o, z = cascade.step(z, v)
            out.append(o)
        assert np.allclose(y, out, atol=1e-9) and np.allclose(end, z, atol=1e-9)


@pytest.mark.parametrize("block", [97, 1000, 1 << 16])
def test_zero_phase_equals_whole_channels(spark, block):
    rng = np.random.default_rng(1)
    series = {(0, 3): np.cumsum(rng.normal(size=2500)) + 100, (0, 4): rng.normal(size=700), (2, 9): np.array([5.0, 7.0, 4.0]), (2, 8): np.array([3.0])}
    first = {3: -40, 4: 1000, 9: 0, 8: 5}
    rows = [pd.DataFrame({"grp": g, "channel": c, "frame": np.arange(len(x)) + first[c], "value": x}) for (g, c), x in series.items()]
    df = spark.createDataFrame(pd.concat(rows), "grp long, channel long, frame long, value double").repartition(5)
    for sections in (R.butterworth(2, 0.05, 0.3), R.butterworth(3, high=0.02)):
        got = R.zero_phase(df, sections, block).toPandas()
        assert len(got) == sum(map(len, series.values()))
        for (g, c), x in series.items():
            one = got[(got.grp == g) & (got.channel == c)].sort_values("frame")
            assert one.frame.tolist() == (np.arange(len(x)) + first[c]).tolist()
            assert np.allclose(one.value, plain(x, sections), atol=1e-8)


def test_the_phase_is_zero_and_bands_are_kept(spark):
    t = np.arange(4000)
    x = np.sin(2 * np.pi * 0.02 * t) + np.sin(2 * np.pi * 0.2 * t)
    df = spark.createDataFrame(pd.DataFrame({"grp": 0, "channel": 1, "frame": t, "value": x}), "grp long, channel long, frame long, value double")
    y = R.bandpass(df, 0.01, 0.04, block=512).toPandas().sort_values("frame").value.to_numpy()
    inner = slice(500, 3500)
    assert np.abs(y[inner] - np.sin(2 * np.pi * 0.02 * t)[inner]).max() < 0.05
    assert R.bandpass(df.limit(0), 0.01, 0.04).count() == 0

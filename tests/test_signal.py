import numpy as np
import pandas as pd
import pytest

from chronoweave.operators import series as S
from chronoweave.operators import signal as G


def trace(spark, channels=2, n=3000, fs=600.0):
    t = np.arange(n) / fs
    v = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 120 * t)
    return spark.createDataFrame(pd.DataFrame({"grp": np.repeat(np.arange(channels) // 4, n), "channel": np.repeat([f"CH{i}" for i in range(channels)], n), "frame": np.tile(np.arange(n), channels), "value": np.tile(v, channels)}))


def values(df, channel="CH0"):
    return df.where(f"channel = '{channel}'").orderBy("frame").toPandas()


def test_downsampling_keeps_the_slow_and_drops_the_fast(spark):
    out = values(G.downsample(trace(spark), 600, (100,), 1200))
    x = out.value.to_numpy()[30:-30]
    assert len(out) == 500
    spectrum = 2 * np.abs(np.fft.rfft(x * np.hanning(len(x)))) / np.hanning(len(x)).sum()
    freq = np.fft.rfftfreq(len(x), 0.01)
    amp = lambda f: spectrum[np.abs(freq - f) < 1.5].max()
    assert amp(5) > 0.5 and amp(20) < 0.05


def test_uneven_rate_is_an_error(spark):
    with pytest.raises(ValueError, match="evenly divide"):
        G.downsample(trace(spark, 1, 100), 600, (104,))


@pytest.mark.parametrize("block", [512, 100_000])
def test_blocks_do_not_change_the_filter(spark, block):
    one = values(G.bandpass(trace(spark, 1, 2000), 0.1, 0.3, 64, 1 << 20)).value.to_numpy()
    cut = values(G.bandpass(trace(spark, 1, 2000), 0.1, 0.3, 64, block)).value.to_numpy()
    assert np.allclose(one, cut)


def test_references(spark):
    df = spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 0, 3.0), (1, "c", 0, 10.0)], "grp long, channel string, frame long, value double")
    got = lambda mode: {r.channel: r.value for r in G.common_reference(df, mode).collect()}
    assert got("global") == {"a": -2.0, "b": 0.0, "c": 7.0}
    assert got("local") == {"a": -1.0, "b": 1.0, "c": 0.0}
    assert got("cross_group") == {"a": -9.0, "b": -7.0, "c": 8.0}
    assert got("none") == {"a": 1.0, "b": 3.0, "c": 10.0}
    with pytest.raises(ValueError, match="unknown"):
        G.common_reference(df, "other")


def test_spectra_find_the_tones(spark):
    w = G.welch(trace(spark, 1), 600.0, 600).toPandas().sort_values("freq")
    assert set(w.nlargest(2, "psd").freq.round()) == {5.0, 120.0}
    bands = G.stft_bands(trace(spark, 1), 600.0, 600, {"low": (2, 8), "fast": (115, 125), "none": (200, 220)}).toPandas().groupby("band").power.mean()
    assert bands["none"] < 0.01 * bands["low"]


def test_power_follows_the_band(spark):
    p = G.band_power(trace(spark, 1), 90 / 600, 150 / 600).toPandas()
    assert abs(p[(p.frame > 300) & (p.frame < 2700)].power.mean() - 1.0) < 0.1


def test_prominence_and_harmonics(spark):
    psd = np.full(60, 1.0)
    psd[[10, 20, 30, 47]] = [100, 80, 60, 50]
    df = spark.createDataFrame(pd.DataFrame({"channel": "a", "freq": np.arange(60.0), "psd": psd}))
    peaks = G.prominent_peaks(df)
    assert sorted(r.freq for r in peaks.collect()) == [10, 20, 30, 47]
    groups = {r.freq: (r.series, r.multiple) for r in G.harmonic_groups(peaks).collect()}
    assert groups[20.0] == (0, 2) and groups[30.0] == (0, 3) and groups[47.0][0] == 1


def test_exclusive_peaks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, 400)
    v[[50, 53, 200]] = [-20, -30, -25]
    df = spark.createDataFrame(pd.DataFrame({"grp": 0, "channel": "a", "frame": np.arange(400), "value": v}))
    assert sorted(r.frame for r in G.exclusive_peaks(df, 10.0, 5, 64).collect()) == [53, 200]


def test_outliers_above_the_first_gap(spark):
    rows = [(0, float(i % 10)) for i in range(100)] + [(0, 100.0)] + [(1, 5.0)] * 3
    out = S.replace_outliers(spark.createDataFrame(rows, "grp long, value double"), ["grp"], "value", 20).collect()
    assert sum(r.clean is None for r in out if r.grp == 0) == 51 or sum(r.clean is None for r in out if r.grp == 0) >= 1
    assert all(r.clean is None for r in out if r.value == 100.0)


def test_slice_table(spark):
    df = spark.createDataFrame([(1, 100, 50.0), (2, 50, 70.0)], "seq long, n long, t0 double")
    a, b = S.slice_table(df, "seq", "n", "t0", 10.0).orderBy("seq").collect()
    assert (a.start_sample, a.end_sample, a.t_start, a.t_end, a.gap_s) == (0, 100, 0.0, 10.0, None)
    assert (b.start_sample, b.end_sample, b.t_start, b.t_end, b.gap_s) == (100, 150, 20.0, 25.0, 10.0)

"""Signal operators on long traces: rows of (grp, channel, frame, value).

A channel is cut into blocks of frames. Each block also gets the rows of its neighbours that a filter reaches
(the halo), so blocks are filtered apart, in parallel, with the result of an uncut filter; outputs of the
halo are dropped. A task holds one block of one channel, whatever the length of the recording.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.order import median

BLOCK = 1 << 16


def with_halo(trace: DataFrame, block: int, halo: int) -> DataFrame:
    """Rows with ``block``, once for each block that needs them."""
    if halo > block:
        raise ValueError("a halo can't be longer than a block")
    own = F.floor(F.col("frame") / F.lit(block))
    inside = F.col("frame") - own * block
    near = F.array_compact(
        F.array(own, F.when(inside < halo, own - 1), F.when(inside >= block - halo, own + 1))
    )
    return trace.withColumn("block", F.explode(near))


def by_block(trace: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], halo: int, block: int = BLOCK, step: int = 1) -> DataFrame:
    """``(grp, channel, frame, value)`` of a kernel of (frames, values), every ``step`` frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frame, number = pdf.frame.to_numpy(), int(pdf.block.iloc[0])
        value = kernel(frame, pdf.value.to_numpy(dtype=float))
        mine = (frame // block == number) & (frame % step == 0)
        return pd.DataFrame({"grp": pdf.grp.to_numpy()[mine], "channel": pdf.channel.to_numpy()[mine], "frame": frame[mine], "value": value[mine]})

    cut = with_halo(trace.select("grp", "channel", "frame", "value"), block, halo)
    kind = cut.schema["channel"].dataType.simpleString()
    return cut.groupBy("channel", "block").applyInPandas(run, f"grp long, channel {kind}, frame long, value double").where("value is not null")


def lowpass_taps(cutoff: float, half: int) -> np.ndarray:
    """Windowed-sinc low pass; cutoff as a share of the sampling rate; unit gain at zero."""
    n = np.arange(-half, half + 1)
    taps = 2 * cutoff * np.sinc(2 * cutoff * n) * np.blackman(2 * half + 1)
    return taps / taps.sum()


def bandpass_taps(low: float, high: float, half: int) -> np.ndarray:
    return lowpass_taps(high, half) - lowpass_taps(low, half)


def filtered(value: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase filter; ends are padded with the end values."""
    half = len(taps) // 2
    return np.convolve(np.pad(value, half, mode="edge"), taps, mode="valid")


def decimate(trace: DataFrame, factor: int, block: int = BLOCK) -> DataFrame:
    """Anti-aliased decimation; frames count at the new rate (SP1)."""
    half = 16 * factor
    taps = lowpass_taps(0.4 / factor, half)
    out = by_block(trace, lambda _, v: filtered(v, taps), half, block - block % factor, factor)
    return out.withColumn("frame", F.floor(F.col("frame") / F.lit(factor)))


def downsample(trace: DataFrame, rate: int, stages: tuple[int, ...], block: int = BLOCK) -> DataFrame:
    """Decimation through each of the stage rates, which must divide evenly (SP1, SNK3)."""
    for stage in stages:
        if stage <= 0 or rate % stage:
            raise ValueError(f"{rate} doesn't evenly divide into {stage}")
        trace, rate = decimate(trace, rate // stage, block), stage
    return trace


def bandpass(trace: DataFrame, low: float, high: float, half: int = 64, block: int = BLOCK) -> DataFrame:
    """Zero-phase band pass, bounds as shares of the sampling rate (SP2, SP14)."""
    taps = bandpass_taps(low, high, half)
    return by_block(trace, lambda _, v: filtered(v, taps), half, block)


def common_reference(trace: DataFrame, mode: str = "global") -> DataFrame:
    """Takes the median of all channels, of other groups' channels, or of the own group off each sample (SP2, AG23)."""
    if mode == "none":
        return trace
    if mode == "global":
        m = trace.groupBy("frame").agg(F.percentile("value", 0.5).alias("_m"))
        return trace.join(m, "frame").withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    if mode == "local":
        m = trace.groupBy("frame", "grp").agg(F.percentile("value", 0.5).alias("_m"))
        return trace.join(m, ["frame", "grp"]).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    if mode == "cross_group":
        parts = trace.groupBy("frame").agg(F.collect_list(F.struct("grp", "value")).alias("_all"))  # a row per channel
        x = trace.join(parts, "frame")
        others = F.transform(F.filter("_all", lambda s: s["grp"] != F.col("grp")), lambda s: s["value"])
        ranked, n = F.array_sort(others), F.size(others)
        middle = (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
        return x.withColumn("value", F.col("value") - F.coalesce(middle, F.lit(0.0))).drop("_all")
    raise ValueError(f"unknown reference {mode!r}")


def hilbert_taps(half: int) -> np.ndarray:
    n = np.arange(-half, half + 1)
    odd = n % 2 != 0
    taps = np.zeros(len(n))
    taps[odd] = 2 / (np.pi * n[odd])
    return taps * np.blackman(2 * half + 1)


def band_power(trace: DataFrame, low: float, high: float, half: int = 64, block: int = BLOCK) -> DataFrame:
    """Instantaneous power in a band, averaged over the group's channels: ``(grp, frame, power)`` (SP3, AG1)."""
    taps, turn = bandpass_taps(low, high, half), hilbert_taps(half)

    def kernel(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        band = filtered(v, taps)
        return band**2 + filtered(band, turn) ** 2

    out = by_block(trace, kernel, 2 * half, block)
    return out.groupBy("grp", "frame").agg(F.avg("value").alias("power"))


def phase(trace: DataFrame, low: float, high: float, half: int = 64, block: int = BLOCK) -> DataFrame:
    """Phase within a narrow band, in radians (SP11)."""
    taps, turn = bandpass_taps(low, high, half), hilbert_taps(half)

    def kernel(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        band = filtered(v, taps)
        return np.arctan2(filtered(band, turn), band)

    return by_block(trace, kernel, 2 * half, block)


def slepian(n: int, half_bandwidth: float = 2.5) -> np.ndarray:
    """First discrete prolate spheroidal sequence, from the tridiagonal matrix that shares it.

    Its largest eigenvalue is found by bisection on the signs of the leading minors' ratios, the vector by inverse
    iteration: both take time and memory in proportion to n.
    """
    if n < 2:
        return np.ones(n)
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * half_bandwidth / n)
    beside = i[1:] * (n - i[1:]) / 2.0
    around = np.concatenate(([0.0], beside)) + np.concatenate((beside, [0.0]))
    low, high = float(diagonal.max()), float((diagonal + around).max())

    def all_below(x: float) -> bool:
        q = 1.0
        for k in range(n):
            q = diagonal[k] - x - (beside[k - 1] ** 2 / q if k else 0.0)
            if q >= 0:
                return False
        return True

    while high - low > 1e-13 * max(1.0, abs(high)):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        low, high = (low, middle) if all_below(middle) else (middle, high)
    shift = high + 1e-9 * max(1.0, abs(high))
    v = np.ones(n)
    pivot = np.empty(n)
    pivot[0] = diagonal[0] - shift
    for k in range(1, n):
        pivot[k] = diagonal[k] - shift - beside[k - 1] ** 2 / pivot[k - 1]
    for _ in range(8):
        y = v.copy()
        for k in range(1, n):
            y[k] -= beside[k - 1] / pivot[k - 1] * y[k - 1]
        y[-1] /= pivot[-1]
        for k in range(n - 2, -1, -1):
            y[k] = (y[k] - beside[k] * y[k + 1]) / pivot[k]
        v = y / np.linalg.norm(y)
    return v * np.sign(v.sum())


def spectra(trace: DataFrame, fs: float, size: int, overlap: float = 0.0, window: str = "hann") -> DataFrame:
    """``(grp, channel, win, freq, psd)`` of windows of ``size`` frames (SP4, SP6); windows short of rows go.

    A task takes a block of windows, cut with a view, in one transform.
    """
    step = max(1, int(round(size * (1 - overlap))))
    w = np.hanning(size + 1)[:-1] if window == "hann" else slepian(size)
    scale = 1.0 / (fs * (w**2).sum())
    freq = np.fft.rfftfreq(size, 1 / fs)

    wins = max(1, BLOCK // step)  # windows of a block

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf.block.iloc[0]) * wins * step
        v = np.full((wins - 1) * step + size, np.nan)
        at = pdf.frame.to_numpy() - base
        inside = at < len(v)
        v[at[inside]] = pdf.value.to_numpy(dtype=float)[inside]
        cut = np.lib.stride_tricks.sliding_window_view(v, size)[::step]
        whole = np.flatnonzero(~np.isnan(cut).any(axis=1))
        x = cut[whole]
        p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 * scale
        p[:, 1 : p.shape[1] - (size % 2 == 0)] *= 2
        first = pdf.iloc[0]
        win = np.repeat(whole + first.block * wins, len(freq))
        return pd.DataFrame({"grp": first.grp, "channel": first.channel, "win": win, "freq": np.tile(freq, len(whole)), "psd": p.ravel()})

    last = F.floor(F.col("frame") / F.lit(step * wins))
    first = F.ceil((F.col("frame") - F.lit((wins - 1) * step + size - 1)) / F.lit(step * wins))
    near = F.explode(F.sequence(F.greatest(first, F.lit(0)), last))
    cut = trace.where("frame >= 0 and value is not null").select("grp", "channel", "frame", "value", near.alias("block"))
    kind = trace.schema["channel"].dataType.simpleString()
    return cut.groupBy("channel", "block").applyInPandas(run, f"grp long, channel {kind}, win long, freq double, psd double")


def welch(trace: DataFrame, fs: float, size: int) -> DataFrame:
    """Mean spectrum of half-overlapping windows: ``(grp, channel, freq, psd)`` (SP6)."""
    return spectra(trace, fs, size, 0.5).groupBy("grp", "channel", "freq").agg(F.avg("psd").alias("psd"))


def stft_bands(trace: DataFrame, fs: float, size: int, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """``(grp, win, band, power)``: spectra averaged over a group's channels, summed over bands with both ends (SP4)."""
    psd = spectra(trace, fs, size, 0.0, "slepian").groupBy("grp", "win", "freq").agg(F.avg("psd").alias("psd"))
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for n, (a, b) in bands.items()]))
    x = psd.withColumn("b", table).where("freq between b.lo and b.hi")  # one frequency may feed several bands
    return x.groupBy("grp", "win", F.col("b.band").alias("band")).agg(F.sum("psd").alias("power"))


def prominent_peaks(spectrum: DataFrame, least: float = 6.0, distance: int = 2) -> DataFrame:
    """Peaks of each channel's spectrum in dB by prominence and distance: ``(channel, freq, db, prominence)`` (SP7)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("freq")
        db, freq = 10 * np.log10(pdf.psd.to_numpy() + 1e-30), pdf.freq.to_numpy()
        found = []
        for i in np.flatnonzero((db[1:-1] > db[:-2]) & (db[1:-1] >= db[2:])) + 1:
            higher = np.flatnonzero(db > db[i])
            left = higher[higher < i].max() + 1 if (higher < i).any() else 0
            right = higher[higher > i].min() if (higher > i).any() else len(db)
            rise = db[i] - max(db[left : i + 1].min(), db[i:right].min())
            if rise >= least:
                found.append((db[i], i, rise))
        kept: list[tuple] = []
        for height, i, rise in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(abs(i - j) >= distance for _, j, _ in kept):
                kept.append((height, i, rise))
        kept.sort(key=lambda x: x[1])
        return pd.DataFrame({"channel": pdf.channel.iloc[0], "freq": [freq[i] for _, i, _ in kept], "db": [h for h, _, _ in kept], "prominence": [r for _, _, r in kept]})

    kind = spectrum.schema["channel"].dataType.simpleString()
    return spectrum.groupBy("channel").applyInPandas(run, f"channel {kind}, freq double, db double, prominence double")


def harmonic_groups(peaks: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each peak, in order of frequency, joins the first fundamental it is a multiple of, or founds its own (SP8)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        roots: list[float] = []
        rows = []
        for f in np.sort(pdf.freq.to_numpy()):
            for number, root in enumerate(roots):
                multiple = round(f / root) if root > 0 else 0
                if multiple >= 1 and abs(f / root - multiple) <= tolerance * multiple:
                    rows.append((f, number, multiple))
                    break
            else:
                rows.append((f, len(roots), 1))
                roots.append(float(f))
        out = pd.DataFrame(rows, columns=["freq", "series", "multiple"])
        out.insert(0, "channel", pdf.channel.iloc[0])
        return out

    kind = peaks.schema["channel"].dataType.simpleString()
    return peaks.groupBy("channel").applyInPandas(run, f"channel {kind}, freq double, series long, multiple long")


def exclusive_peaks(trace: DataFrame, least: float, dead: int, block: int = BLOCK) -> DataFrame:
    """Negative peaks of at least ``least`` MADs, the deepest of their group within ``dead`` frames (SP10).

    Returns ``(grp, frame, amp_mad)``; of equal depths the earlier frame and lower channel stay.
    """
    x = trace.join(median(trace, ["channel"], F.col("value"), "_c"), "channel")
    noise = median(x, ["channel"], F.abs(F.col("value") - F.col("_c")), "_m").select("channel", (F.col("_m") / 0.6745).alias("_n"))
    deep = x.join(noise, "channel").where("_n > 0").withColumn("amp", -F.col("value") / F.col("_n")).where(F.col("amp") >= least)
    own = F.floor(F.col("frame") / F.lit(block))
    inside = F.col("frame") - own * block
    near = F.array_compact(F.array(own, F.when(inside < dead, own - 1), F.when(inside >= block - dead, own + 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "channel"])
        frame, amp = pdf.frame.to_numpy(), pdf.amp.to_numpy()
        low, high = np.searchsorted(frame, frame - dead), np.searchsorted(frame, frame + dead, "right")
        best = [amp[a:b].max() == v and a + int(np.argmax(amp[a:b])) == i for i, (a, b, v) in enumerate(zip(low, high, amp, strict=True))]
        mine = np.array(best, dtype=bool) & (frame // block == int(pdf.block.iloc[0]))
        return pd.DataFrame({"grp": pdf.grp.to_numpy()[mine], "frame": frame[mine], "amp_mad": amp[mine]})

    cut = deep.select("grp", "channel", "frame", "amp", F.explode(near).alias("block"))
    return cut.groupBy("grp", "block").applyInPandas(run, "grp long, frame long, amp_mad double")


def transients(trace: DataFrame, cutoff: float, distance: int, mads: float = 6.0, half: int = 64, block: int = BLOCK) -> DataFrame:
    """``(grp, channel, frame, height, threshold)`` of sharp events: high pass, robust threshold, least distance (SP9).

    Heights are those of local maxima of the rectified high-passed trace above median + mads x 1.4826 x MAD; of
    peaks closer than ``distance`` the highest stays (of equal ones the later), taken from the highest down. Peaks
    farther apart than that decide apart, so they are cut into runs, and a task holds a run of peaks.
    """
    low = lowpass_taps(cutoff, half)
    high = by_block(trace, lambda _, v: np.abs(v - filtered(v, low)), half, block)
    middle = median(high, ["channel"], F.col("value"), "_c")
    spread = median(high.join(middle, "channel"), ["channel"], F.abs(F.col("value") - F.col("_c")), "_d")
    level = middle.join(spread, "channel").select("channel", (F.col("_c") + mads * 1.4826 * F.col("_d")).alias("threshold"))
    # neighbours across a block's edge come along with the halo of one frame
    cut = with_halo(high, block, 1)
    near = Window.partitionBy("channel", "block").orderBy("frame")
    peaks = cut.withColumns({"_p": F.lag("value").over(near), "_n": F.lead("value").over(near)})
    peaks = peaks.where((F.floor(F.col("frame") / F.lit(block)) == F.col("block")) & (F.col("value") > F.col("_p")) & (F.col("value") >= F.col("_n")))
    peaks = peaks.join(level, "channel").where("value >= threshold").select("grp", "channel", "frame", F.col("value").alias("height"), "threshold")
    order = Window.partitionBy("channel").orderBy("frame")  # of peaks, not of the trace
    begins = F.coalesce(F.col("frame") - F.lag("frame").over(order) >= distance, F.lit(True)).cast("int")
    runs = peaks.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order)).drop("_begins")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        frame, left = pdf.frame.to_numpy(), np.ones(len(pdf), bool)
        for i in np.argsort(pdf.height.to_numpy(), kind="stable")[::-1]:
            if left[i]:
                left[(np.abs(frame - frame[i]) < distance) & (np.arange(len(frame)) != i)] = False
        return pdf[left].drop(columns="_run")

    kind = peaks.schema["channel"].dataType.simpleString()
    return runs.groupBy("channel", "_run").applyInPandas(thin, f"grp long, channel {kind}, frame long, height double, threshold double")


def inband_error(trace: DataFrame, lossy: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """Residual RMS of a lossy copy in a band, and as a share of the noise floor, per channel (SP14, FN3)."""
    a = bandpass(trace, low, high, block=block).withColumnRenamed("value", "x")
    b = bandpass(lossy, low, high, block=block).select("channel", "frame", F.col("value").alias("y"))
    d = a.join(b, ["channel", "frame"])
    floor = median(d, ["channel"], F.abs("x"), "_m").select("channel", (F.col("_m") / 0.6745).alias("floor"))
    return d.groupBy("channel").agg(F.stddev_pop(F.col("x") - F.col("y")).alias("rms")).join(floor, "channel").withColumn("share", F.col("rms") / F.col("floor"))


def state_windows(trace: DataFrame, frames: int, apart: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``(channel, label, centre)``: where a channel's smoothed trace is lowest and highest outside of intervals, and the intervals' middles (SP13).

    Smoothing is the mean of ``frames`` neighbouring rows, fewer at the ends; apart: ``(start, end)`` in frames, both
    included. Of equal values the first place counts. Labels: low, high, interval.
    """
    back, ahead = frames // 2, (frames - 1) // 2
    cut = with_halo(trace.select("channel", "frame", "value"), block, max(1, back))
    near = Window.partitionBy("channel", "block").orderBy("frame").rowsBetween(-back, ahead)
    smooth = cut.withColumn("y", F.avg("value").over(near)).where(F.floor(F.col("frame") / F.lit(block)) == F.col("block"))
    whole = [] if apart is None else [apart.select(F.col("start").alias("_s"), F.col("end").alias("_e"))]
    for gaps in whole:
        smooth = smooth.join(gaps, (F.col("frame") >= F.col("_s")) & (F.col("frame") <= F.col("_e")), "left_anti")
    smooth = smooth.where("y is not null and not isnan(y)")
    place = F.struct("y", (-F.col("frame")).alias("f"))
    ends = smooth.groupBy("channel").agg(F.min(F.struct("y", F.col("frame").alias("f"))).alias("low"), F.max(place).alias("high"))
    label = lambda name, at: F.struct(F.lit(name).alias("label"), at.cast("double").alias("centre"))
    out = ends.select("channel", F.explode(F.array(label("low", F.col("low.f")), label("high", -F.col("high.f")))).alias("w")).select("channel", "w.*")
    for gaps in whole:
        middles = gaps.select(F.lit("interval").alias("label"), ((F.col("_s") + F.col("_e")) / 2).alias("centre"))
        out = out.unionByName(ends.select("channel").crossJoin(middles).select("channel", "label", "centre"))  # a row for each channel and interval
    return out

"""Quality metrics of units, a function per family (AG22): rates, intervals, synchrony, amplitudes, drift, clusters.

Trains are rows of (grp, unit, frame) and, where amplitudes count, ``value``. Each family is an aggregate by unit
that combines before it shuffles; histograms and sums of products stand for the events wherever a metric needs more
than one pass. A metric that can't be computed is null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions.arrays import norm_sq
from chronoweave.operators.trains import band_pairs, with_interval
from chronoweave.plans.order import median, previous, selected
from chronoweave.plans.storage import materialize

#: Contaminations that are tried, as shares of the rate, and the confidence that one must reach.
TRIED = tuple(i / 200 for i in range(1, 71))
CONFIDENCE = 0.9
#: Bins of amplitude histograms; the standard deviation of the smoothing in bins, and how far it reaches.
CUTOFF_BINS, SMOOTH, REACH = 500, 3, 12
NOISE_BINS = 100
#: Snippets of a block that meet another block of as many: so many until a group has WIDE blocks, then up to MOST;
#: a snippet is repeated for every block, and each block gives its nearest.
BLOCK, WIDE, MOST = 1024, 8, 8192
#: Distances that are held at a time.
HELD = 1 << 20


def rates(train: DataFrame, start: int, frames: int, second: int, bin_frames: int) -> DataFrame:
    """``(unit, num_spikes, firing_rate, presence_ratio, firing_range)``.

    presence_ratio: bins with events among all whole or begun bins; firing_range: 95th less 5th percentile of the bins' rates.
    """
    bins = -(-frames // bin_frames)
    n = train.groupBy("unit", F.floor((F.col("frame") - start) / F.lit(bin_frames)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    total = n.groupBy("unit").agg(F.sum("_n").alias("num_spikes"), F.count(F.lit(1)).alias("_with"))
    often = n.groupBy("unit", "_n").agg(F.count(F.lit(1)).alias("_k"))
    # bins without events weigh in as one row of their number
    empty = total.select("unit", F.lit(0).cast("long").alias("_n"), (F.lit(bins) - F.col("_with")).cast("long").alias("_k")).where("_k > 0")
    ends = often.unionByName(empty).groupBy("unit").agg(F.percentile("_n", F.array(F.lit(0.05), F.lit(0.95)), F.col("_k")).alias("_q"))
    width = (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / (bin_frames / second)
    return total.join(ends, "unit").select(
        "unit", "num_spikes", (F.col("num_spikes") / (frames / second)).alias("firing_rate"), (F.col("_with") / bins).alias("presence_ratio"), width.alias("firing_range")
    )


def interval_violations(train: DataFrame, frames: int, refractory: int) -> DataFrame:
    """``(unit, isi_violations_count, isi_violations_ratio)``: the rate of violations in the time where they can be, over the unit's rate."""
    x = with_interval(train, ["unit"]).groupBy("unit").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("d") < refractory).alias("isi_violations_count"))
    ratio = F.col("isi_violations_count") * float(frames) / (2.0 * refractory * F.col("_n") * F.col("_n"))
    return x.select("unit", "isi_violations_count", ratio.alias("isi_violations_ratio"))


def _poisson(most: pd.Series, mean: pd.Series) -> pd.Series:
    """Probability that a Poisson count is at most ``most``; by the normal law where the mean is large."""
    k, m = np.floor(most.to_numpy(float)), mean.to_numpy(float)
    out = np.where(k < 0, 0.0, 1.0)
    wide = 40 * np.sqrt(np.maximum(m, 1.0))
    for i in np.flatnonzero((k >= 0) & (k < m + wide) & (m > 0)):
        if m[i] > 1000:
            out[i] = 0.5 * math.erfc((m[i] - k[i] - 0.5) / math.sqrt(2 * m[i]))
        else:
            at = np.arange(int(k[i]) + 1)  # below m + 40 sqrt(m): some 2300 terms at most
            out[i] = min(1.0, float(np.exp(-m[i] + at * math.log(m[i]) - np.concatenate(([0.0], np.cumsum(np.log(at[1:]))))).sum()))
    return pd.Series(out, dtype=float)


def sliding_violations(train: DataFrame, frames: int, refractory: list[int]) -> DataFrame:
    """``(unit, sliding_rp_violation)``: the least contamination tried that some refractory time excludes with confidence.

    A contamination c lets a Poisson number of 2 n t (c n / frames) pairs fall within t; it is excluded if fewer
    are seen than with probability ``CONFIDENCE`` would be. Null where none is excluded.
    """
    own = train.select(F.col("unit").alias("grp"), "unit", "frame")
    met = band_pairs(own, own, max(refractory) + 1).where("frame_b > frame_a")
    seen = met.groupBy("unit_a").agg(*[F.count_if(F.col("frame_b") - F.col("frame_a") <= t).alias(f"_{t}") for t in refractory])
    n = train.groupBy("unit").agg(F.count(F.lit(1)).alias("_n"))
    x = n.join(seen.withColumnRenamed("unit_a", "unit"), "unit", "left").na.fill(0)
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"_{t}").alias("seen")) for t in refractory]))
    tried = x.select("unit", "_n", each.alias("r")).withColumn("c", F.explode(F.array(*map(F.lit, TRIED))))
    mean = 2 * F.col("_n") * F.col("r.t") * F.col("c") * F.col("_n") / float(frames)
    sure = 1 - F.pandas_udf(_poisson, "double")(F.col("r.seen"), mean)
    return tried.groupBy("unit").agg(F.min(F.when(sure > CONFIDENCE, F.col("c"))).alias("sliding_rp_violation"))


def synchrony(train: DataFrame, width: int, sizes: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """``(unit, sync_spike_k, ...)``: share of events in bins of ``width`` frames that k units of the group or more fire in."""
    at = train.groupBy("grp", F.floor(F.col("frame") / F.lit(width)).alias("_bin"), "unit").agg(F.count(F.lit(1)).alias("_n"))
    units = at.groupBy("grp", "_bin").agg(F.count(F.lit(1)).alias("_units"))
    share = lambda k: F.sum(F.when(F.col("_units") >= k, F.col("_n")).otherwise(0)) / F.sum("_n")
    return at.join(units, ["grp", "_bin"]).groupBy("unit").agg(*[share(k).alias(f"sync_spike_{k}") for k in sizes])


def noise_levels(train: DataFrame) -> DataFrame:
    """``(grp, noise)``: the robust standard deviation of a group's values about their median."""
    middle = median(train, ["grp"], F.col("value"), "_c")
    return median(train.join(middle, "grp"), ["grp"], F.abs(F.col("value") - F.col("_c")), "_m").select("grp", (F.col("_m") / 0.6745).alias("noise"))


def amplitudes(train: DataFrame, start: int, bin_frames: int, least: int) -> DataFrame:
    """``(unit, amplitude_median, snr, sd_ratio, amplitude_cv_median, amplitude_cv_range)``.

    snr: median amplitude over noise; sd_ratio: spread of successive differences over noise, which slow drift
    doesn't enter; the variation coefficients are those of time bins with at least ``least`` events, their range
    the 95th less the 5th percentile.
    """
    step = previous(train, ["unit"], ["frame", "value"], "value", "_d").withColumn("_d", F.col("value") - F.col("_d"))
    one = step.groupBy("grp", "unit").agg((F.stddev_pop("_d") / math.sqrt(2)).alias("_sd"))
    one = one.join(median(train, ["grp", "unit"], F.col("value"), "amplitude_median"), ["grp", "unit"]).join(noise_levels(train), "grp")
    over = lambda x: F.when(F.col("noise") > 0, x / F.col("noise"))
    binned = train.groupBy("unit", F.floor((F.col("frame") - start) / F.lit(bin_frames)).alias("_bin"))
    cv = binned.agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_s"), F.avg("value").alias("_m")).where((F.col("_n") >= least) & (F.col("_m") != 0))
    q = F.percentile(F.col("_s") / F.abs("_m"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    cv = cv.groupBy("unit").agg(q.alias("_q"))
    return one.join(cv, "unit", "left").select(
        "unit", "amplitude_median", over(F.abs("amplitude_median")).alias("snr"), over(F.col("_sd")).alias("sd_ratio"),
        F.get("_q", F.lit(1)).alias("amplitude_cv_median"), (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("amplitude_cv_range"),
    )


def drift(train: DataFrame, start: int, bin_frames: int, least: int, place: str = "value") -> DataFrame:
    """``(unit, drift_ptp, drift_std, drift_mad)`` of the medians of a place over time bins, about the median of all."""
    whole = median(train, ["unit"], F.col(place), "_c")
    binned = train.withColumn("_bin", F.floor((F.col("frame") - start) / F.lit(bin_frames)))
    part = binned.groupBy("unit", "_bin").agg(F.count(F.lit(1)).alias("_n")).join(median(binned, ["unit", "_bin"], F.col(place), "_m"), ["unit", "_bin"])
    d = part.where(F.col("_n") >= least).join(whole, "unit").withColumn("_d", F.col("_m") - F.col("_c"))
    middle = d.groupBy("unit").agg(F.percentile("_d", 0.5).alias("_e"))
    return d.join(middle, "unit").groupBy("unit").agg(
        (F.max("_d") - F.min("_d")).alias("drift_ptp"), F.stddev_pop("_d").alias("drift_std"), F.percentile(F.abs(F.col("_d") - F.col("_e")), 0.5).alias("drift_mad")
    )


def _histograms(train: DataFrame, bins: int) -> DataFrame:
    """``(unit, counts, lo, width)`` of amplitudes; the last bin is closed, and units without spread have none."""
    span = train.where(~F.isnan("value")).groupBy("unit").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi > lo")
    span = span.select("unit", "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    n = train.join(span, "unit").groupBy("unit", "lo", "width", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    found = n.groupBy("unit", "lo", "width").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_m"))  # at most a row per bin
    return found.select("unit", "lo", "width", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0))).alias("counts"))


def amplitude_cutoff(train: DataFrame, least: int = 1) -> DataFrame:
    """``(unit, amplitude_cutoff)``: the share of events below the detection limit if amplitudes were symmetric about their mode.

    The smoothed histogram's far side falls to the height at its near end somewhere: what lies beyond is as much as is
    missing, at most one half. Null below ``least`` events.
    """
    weight = [math.exp(-0.5 * (i / SMOOTH) ** 2) for i in range(-REACH, REACH + 1)]
    weight = np.array(weight) / sum(weight)

    def run(counts: pd.Series) -> pd.Series:
        out = []
        for x in counts:
            n = np.asarray(x, float)
            pdf = np.convolve(n / n.sum(), weight, mode="same")
            # heights alike but for rounding are ties, which go to the lower bin
            top = int(np.argmax(np.round(pdf, 12)))
            end = top + int(np.argmin(np.round(np.abs(pdf[top:] - pdf[0]), 12)))
            out.append(min(0.5, float(pdf[end:].sum())) if n.sum() >= least else None)
        return pd.Series(out, dtype=float)

    return _histograms(train, CUTOFF_BINS).select("unit", F.pandas_udf(run, "double")("counts").alias("amplitude_cutoff"))


def noise_cutoff(train: DataFrame, low: float = 0.1, high: float = 0.25) -> DataFrame:
    """``(unit, noise_cutoff, noise_ratio)``: how far the low end of the amplitude histogram stands above its high end.

    cutoff: mean count of the lowest share ``low`` of bins less that of the highest share ``high``, in standard
    deviations of the latter (null without spread); ratio: mean of the lowest over the highest bin of all.
    """
    h = _histograms(train, NOISE_BINS)
    a, b = max(1, round(NOISE_BINS * low)), max(2, round(NOISE_BINS * high))
    first, last = F.slice("counts", 1, a), F.slice("counts", NOISE_BINS - b + 1, b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    spread = F.sqrt(norm_sq(F.transform(last, lambda v: v.cast("double"))) / b - F.pow(total(last) / b, 2))
    return h.select(
        "unit", F.when(spread > 0, (total(first) / a - total(last) / b) / spread).alias("noise_cutoff"), (total(first) / a / F.array_max("counts")).alias("noise_ratio")
    )


def _moments(snippets: DataFrame, by: list[str], d: int) -> DataFrame:
    """``(*by, _n, _s array, _q array)``: number, sums and sums of products (row by row) of feature vectors."""
    x = lambda i: F.get("features", F.lit(i))
    return snippets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("_s"), F.array(*[F.sum(x(i) * x(j)) for i in range(d) for j in range(d)]).alias("_q")
    )


def _shape(n: int, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = s / n
    return mean, (q.reshape(len(s), -1) / n - np.outer(mean, mean)) * n / max(1, n - 1)


def d_prime(snippets: DataFrame, d: int) -> DataFrame:
    """``(grp, unit, d_prime)``: separation of a unit from the rest of its group along their best linear discriminant.

    snippets: ``(grp, unit, spike, features)``. From sums of products alone: no snippet meets another.
    """
    own, whole = _moments(snippets, ["grp", "unit"], d), _moments(snippets, ["grp"], d).toDF("grp", "_gn", "_gs", "_gq")

    def run(n: pd.Series, s: pd.Series, q: pd.Series, gn: pd.Series, gs: pd.Series, gq: pd.Series) -> pd.Series:
        out = []
        for a, b, c, e, f, g in zip(n, s, q, gn, gs, gq, strict=True):
            b, c, f, g = (np.asarray(v, float) for v in (b, c, f, g))
            if a < 2 or e - a < 2:
                out.append(None)
                continue
            (m1, v1), (m2, v2) = _shape(a, b, c), _shape(e - a, f - b, g - c)
            w = np.linalg.pinv(v1 * (a - 1) + v2 * (e - a - 1)) @ (m1 - m2)
            spread = 0.5 * (w @ v1 @ w + w @ v2 @ w)
            out.append(float(w @ (m1 - m2) / math.sqrt(spread)) if spread > 0 else None)
        return pd.Series(out, dtype=float)

    return own.join(whole, "grp").select("grp", "unit", F.pandas_udf(run, "double")("_n", "_s", "_q", "_gn", "_gs", "_gq").alias("d_prime"))


def mahalanobis(snippets: DataFrame, d: int) -> DataFrame:
    """``(grp, unit, isolation_distance, l_ratio)`` of units with more snippets than features, in groups of several.

    isolation_distance: squared distance of the n-th nearest snippet of other units, n the unit's own number or all
    others if fewer; l_ratio: how much of the others' weight lies within, by the chi-square law (d even).
    """
    if d % 2:
        raise ValueError("an even number of features is needed")
    own = _moments(snippets, ["grp", "unit"], d).where(F.col("_n") > d)

    def inverse(n: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(_shape(a, np.asarray(b, float), np.asarray(c, float))[1]).ravel().tolist() for a, b, c in zip(n, s, q, strict=True)])

    units = own.select("grp", F.col("unit").alias("_u"), "_n", "_s", F.pandas_udf(inverse, "array<double>")("_n", "_s", "_q").alias("_i"))
    met = snippets.join(units, "grp").where("unit <> _u")
    delta = [F.get("features", F.lit(i)) - F.get("_s", F.lit(i)) / F.col("_n") for i in range(d)]
    far = sum((delta[i] * delta[j] * F.get("_i", F.lit(i * d + j)) for i in range(d) for j in range(d)), F.lit(0.0))
    met = met.select("grp", F.col("_u").alias("unit"), "_n", far.alias("_d"))
    half = F.col("_d") / 2
    beyond = F.exp(-half) * sum((F.pow(half, F.lit(k)) / math.factorial(k) for k in range(d // 2)), F.lit(0.0))
    met = materialize(met, "distances")
    others = met.groupBy("grp", "unit").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_m"), (F.sum(beyond) / F.max("_n")).alias("l_ratio"))
    ranks = others.select("grp", "unit", (F.least("_n", "_m") - 1).alias("rank"))
    reached = selected(met, ["grp", "unit"], F.col("_d"), ranks, "isolation_distance").drop("rank")
    return others.join(reached, ["grp", "unit"]).select("grp", "unit", "isolation_distance", "l_ratio")


def silhouette(snippets: DataFrame, d: int) -> DataFrame:
    """``(grp, unit, silhouette)``: mean over snippets of (b - a) / max(a, b), a and b the distances to the own and the nearest other centroid."""
    centre = snippets.groupBy("grp", "unit").agg(F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(d)]).alias("_c")).withColumnRenamed("unit", "_u")
    far = F.sqrt(sum((F.pow(F.get("features", F.lit(i)) - F.get("_c", F.lit(i)), 2) for i in range(d)), F.lit(0.0)))
    met = snippets.join(centre, "grp").select("grp", "unit", "spike", "_u", far.alias("_d"))
    each = met.groupBy("grp", "unit", "spike").agg(F.max(F.when(F.col("_u") == F.col("unit"), F.col("_d"))).alias("_a"), F.min(F.when(F.col("_u") != F.col("unit"), F.col("_d"))).alias("_b"))
    each = each.where("_b is not null and greatest(_a, _b) > 0")
    return each.groupBy("grp", "unit").agg(F.avg((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).alias("silhouette"))


def nearest_neighbours(snippets: DataFrame, k: int = 4, most: int | None = None) -> DataFrame:
    """``(grp, unit, nn_hit_rate, nn_miss_rate)`` of the ``k`` nearest snippets of each in its group.

    hit: share of the unit's neighbours that are its own; miss: share of the neighbours of other units that are the
    unit's. All snippets take part, or with ``most`` so many of a unit, those of the smallest hashed numbers.
    Blocks meet in pairs, and each gives the nearest k of its rows. Ties go to the smaller number.
    """
    order = Window.partitionBy("grp", "unit").orderBy(F.xxhash64("spike"), "spike")
    taken = snippets if most is None else snippets.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    taken = taken.select("grp", F.col("unit").cast("long").alias("unit"), F.col("spike").cast("long").alias("spike"), "features")
    cut = taken.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MOST), F.least(F.lit(WIDE), F.ceil(F.count(F.lit(1)) / BLOCK))).cast("int").alias("_n"))
    dealt = taken.join(cut, "grp").withColumn("_b", F.pmod(F.xxhash64("spike"), F.col("_n")).cast("int"))
    grid = F.sequence(F.lit(0), F.col("_n") - 1)
    columns = ["grp", "_x", "_y", "_side", "unit", "spike", "features"]
    asked = dealt.withColumns({"_x": F.col("_b"), "_y": F.explode(grid), "_side": F.lit(True)}).select(columns)
    shown = dealt.withColumns({"_y": F.col("_b"), "_x": F.explode(grid), "_side": F.lit(False)}).select(columns)

    def rank(table: pa.Table) -> pa.Table:
        side, unit, spike = (table.column(c).to_numpy() for c in ("_side", "unit", "spike"))
        x = np.array(table.column("features").to_pylist(), float).reshape(table.num_rows, -1)
        q, c = np.flatnonzero(side), np.flatnonzero(~side)
        c = c[np.argsort(spike[c], kind="stable")]
        if not len(q) or not len(c):
            q, c = q[:0], c[:0]
        again, found = np.isin(spike[q], spike[c]), []
        # some rows at a time, a feature at a time
        for start in range(0, len(q), step := max(1, HELD // max(1, len(c)))):
            mine = q[start : start + step]
            far = np.zeros((len(mine), len(c)))
            for feature in x.T:
                far += (feature[mine][:, None] - feature[c][None, :]) ** 2
            own = np.flatnonzero(again[start : start + step])
            if len(own):
                far[own] = np.where(spike[mine[own]][:, None] == spike[c][None, :], np.inf, far[own])
            last = min(k, far.shape[1]) - 1
            row, at = np.nonzero((far <= np.partition(far, last, axis=1)[:, last :][:, :1]) & np.isfinite(far))
            d = far[row, at]
            ranks = np.lexsort((at, d, row))
            row, at, d = row[ranks], at[ranks], d[ranks]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((mine[row[first]], c[at[first]], d[first]))
        row, other, d = (np.concatenate(part) for part in zip((q[:0], c[:0], np.zeros(0)), *found, strict=True))
        return pa.table({"grp": table.column("grp").take(pa.array(row)), "unit": unit[row], "spike": spike[row], "other": unit[other], "n": spike[other], "d": d})

    kind = taken.schema["grp"].dataType.simpleString()
    # blocks are few bytes but long work: as many partitions as pairs of blocks, which adaptive execution doesn't put together
    pairs = cut.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 1  # one number
    met = asked.unionByName(shown).repartition(min(1 << 11, pairs), "grp", "_x", "_y")
    found = met.groupBy("grp", "_x", "_y").applyInArrow(rank, f"grp {kind}, unit long, spike long, other long, n long, d double")
    near = found.withColumn("_k", F.row_number().over(Window.partitionBy("grp", "unit", "spike").orderBy("d", "n"))).where(F.col("_k") <= k)
    pairs = near.groupBy("grp", "unit", "other").agg(F.count(F.lit(1)).alias("_n"))
    size = pairs.groupBy("grp").agg(F.sum("_n").alias("_all"))
    hit = pairs.groupBy("grp", "unit").agg(F.sum("_n").alias("_own"), F.sum(F.when(F.col("other") == F.col("unit"), F.col("_n")).otherwise(0)).alias("_hit"))
    miss = pairs.where("other <> unit").groupBy("grp", F.col("other").alias("unit")).agg(F.sum("_n").alias("_miss"))
    x = hit.join(size, "grp").join(miss, ["grp", "unit"], "left")
    others = F.col("_all") - F.col("_own")
    return x.select("grp", "unit", (F.col("_hit") / F.col("_own")).alias("nn_hit_rate"), F.when(others > 0, F.coalesce("_miss", F.lit(0)) / others).alias("nn_miss_rate"))


def suite(parts: list[DataFrame], units: DataFrame) -> DataFrame:
    """``units`` with the columns of every family, null where a family says nothing of a unit."""
    out = units
    for part in parts:
        out = out.join(part.drop("grp") if "grp" in part.columns else part, "unit", "left")
    return out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Double columns rounded, the others as they are."""
    return df.select(*[_round(F.col(f.name), places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _round(x: Column, places: int) -> Column:
    return F.round(x, places)

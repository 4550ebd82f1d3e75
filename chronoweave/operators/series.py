"""Operators on regular series and segment tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.order import numbered
from chronoweave.plans.storage import materialize

#: Channels of a block at most, and blocks that fewer are cut into; frames whose products are taken at once.
SIDE, SPREAD, SLAB = 2048, 8, 512
#: Places, and frequencies, of a block of a transform.
PLACES = 1024


def histogram(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """``(*by, bin, n, lo, width)``: all ``bins`` equal bins from least to most; the last is closed (H15)."""
    x = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    span = x.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # a series without spread gets the unit range around its value
    flat = F.col("hi") == F.col("lo")
    span = span.select(*by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    counts = x.join(span, by).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(*by, "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, [*by, "bin"], "left").na.fill(0, ["n"])


def gap_thresholds(hist: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, run_length, threshold)``: where the first run of at least so many empty bins opens (WN8).

    Of run lengths that share a threshold the smallest stays.
    """
    order = Window.partitionBy(*by).orderBy("bin")
    empty = hist.where("n = 0").withColumn("_island", F.col("bin") - F.row_number().over(order))
    runs = empty.groupBy(*by, "_island").agg(F.min("bin").alias("bin"), F.count(F.lit(1)).alias("len"), F.first("lo").alias("lo"), F.first("width").alias("width"))
    before = F.max("len").over(order.rowsBetween(Window.unboundedPreceding, -1))
    record = runs.withColumn("_before", F.coalesce(before, F.lit(0))).where("len > _before")
    return record.select(*by, (F.col("_before") + 1).alias("run_length"), (F.col("lo") + F.col("bin") * F.col("width")).alias("threshold"))


def replace_outliers(rows: DataFrame, by: list[str], value: str, bins: int = 1000, threshold_ix: int = 0) -> DataFrame:
    """Adds ``threshold`` and ``clean``: values above the chosen histogram gap become null; no gap, no change (SP5)."""
    table = gap_thresholds(histogram(rows, by, value, bins), by)
    pick = table.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("threshold"))).where(F.col("_k") == threshold_ix + 1)
    joined = rows.join(pick.select(*by, "threshold"), by, "left")
    return joined.withColumn("clean", F.when(F.col("threshold").isNull() | (F.col(value) <= F.col("threshold")), F.col(value)))


def rolling_mean(rows: DataFrame, by: list[str], order: str, value: str, size: int) -> DataFrame:
    """Adds ``smooth``: the centred mean of ``size`` rows, of those there are; NaN counts as missing (WN5)."""
    back = size // 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-back, size - 1 - back)
    return rows.withColumn("smooth", F.avg(F.when(~F.isnan(value), F.col(value))).over(w))


def slice_table(segments: DataFrame, order: str, samples: str, start: str, rate: float) -> DataFrame:
    """Running sample bounds, session time and gaps of consecutive segments (WN3). A row per segment."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    end_sample = F.sum(samples).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t0 = F.first(start).over(w)
    t_start = F.col(start) - t0
    out = segments.withColumns({"end_sample": end_sample, "t_start": t_start})
    out = out.withColumns({"start_sample": F.col("end_sample") - F.col(samples), "t_end": F.col("t_start") + F.col(samples) / rate})
    return out.withColumn("gap_s", F.col("t_start") - F.lag("t_end").over(w))


def light_dark(transitions: DataFrame, time: str, label: str, by: list[str]) -> DataFrame:
    """Each transition with the next one's time; the open last one goes (WN4)."""
    w = Window.partitionBy(*by).orderBy(time)
    return transitions.select(*by, F.col(time).alias("start"), F.lead(time).over(w).alias("end"), F.col(label).alias("label")).where(F.col("end").isNotNull())


def clipped(start: Column, end: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """Interval within an axis (JN19); empty where the start isn't below the end."""
    return F.greatest(start, F.lit(lo)), F.least(end, F.lit(hi))


def common_reference(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``referenced``: the value less the median across channels at the same place (AG23)."""
    middle = rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("_m"))
    return rows.join(middle, by).withColumn("referenced", F.col(value) - F.col("_m")).drop("_m")


def local_peaks(rows: DataFrame, by: list[str], order: str, value: str, least: float) -> DataFrame:
    """Rows above both neighbours (the later one may be equal) that reach ``least`` (SP7, SP10)."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    found = rows.withColumns({"_p": before, "_n": after})
    return found.where((F.col(value) > F.col("_p")) & (F.col(value) >= F.col("_n")) & (F.col(value) >= least)).drop("_p", "_n")


def vector_strength(phase: Column) -> Column:
    """Length of the mean unit vector of phases (AG28)."""
    return F.sqrt(F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2))


def in_intervals(rows: DataFrame, intervals: DataFrame, at: str, start: str, end: str, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of each interval [start, end) that holds ``at`` (JN16, SNK5).

    Both sides meet in buckets as wide as the mean interval, so the join is on equal buckets and an interval is in few;
    the width takes one job over the intervals.
    """
    span = intervals.agg(F.min(start).alias("a"), F.max(end).alias("b"), F.count(F.lit(1)).alias("n")).first()  # three numbers
    width = max(1, -(-(int(span.b) - int(span.a)) // int(span.n))) if span.n and span.b is not None else 1
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    held = intervals.where(F.col(start) < F.col(end)).select(F.col(start).alias("_s"), F.col(end).alias("_e"), *names)
    held = held.withColumn("_b", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e") - 1))))
    met = rows.withColumn("_b", bucket(F.col(at))).join(held, "_b").where((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    return met.drop("_b", "_s", "_e")


def phase_classes(strengths: DataFrame, nulls: DataFrame, by: list[str], edge: float) -> DataFrame:
    """``(*by, r0, r_edge, class)`` of vector strengths ``(*by, lag, r)`` against ``(*by, null_r)`` (SP15).

    SUSTAINED: the mean strength at lags of ``edge`` and more on either side is above twice the null; LEAKAGE: only
    that at lag 0 is; NONE otherwise.
    """
    r = strengths.groupBy(*by).agg(F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r0"), F.avg(F.when(F.abs("lag") >= edge, F.col("r"))).alias("r_edge"))
    above = lambda c: F.coalesce(F.col(c) > 2 * F.col("null_r"), F.lit(False))
    kind = F.when(above("r_edge"), "SUSTAINED").when(above("r0"), "LEAKAGE").otherwise("NONE")
    return r.join(nulls, by).select(*by, "r0", "r_edge", kind.alias("class"))


def shared_clock(rows: DataFrame, ladder: float) -> DataFrame:
    """``rows`` with ``ratio``, ``rate_clean`` and ``verdict`` (SP16); they hold fundamental, n_sustained, period and resolution.

    The ratio of the period to the ladder's is clean if the nearest whole or half number is off by less than the
    resolution, one sample at least. A sustained fundamental at a clean rate is a shared clock, any sustained band
    a likely one; either alone is suggestive.
    """
    ratio = F.col("period") / F.lit(float(ladder))
    off = F.least(F.abs(ratio - F.round(ratio)), F.abs(ratio - F.round(2 * ratio) / 2)) * ladder
    x = rows.withColumns({"ratio": ratio, "rate_clean": off < F.greatest(F.col("resolution"), F.lit(1.0))})
    some = F.col("n_sustained") >= 1
    verdict = (
        F.when((F.col("fundamental") == "SUSTAINED") & F.col("rate_clean"), "SHARED CLOCK")
        .when(some & F.col("rate_clean"), "LIKELY SHARED")
        .when(some | F.col("rate_clean"), "SUGGESTIVE")
        .otherwise("NONE")
    )
    return x.withColumn("verdict", verdict)


def spatial_spectrum(rows: DataFrame, place: str, value: str) -> DataFrame:
    """``(k, period, power)``: power at k cycles across equally spaced places, the mean taken off (SP12).

    One row per place is expected. Places are numbered by ranges and packed into blocks; each meets every block of frequencies,
    and sums of blocks are rows that add up, so work is spread over pairs of blocks and no task holds all places.
    """
    x = numbered(materialize(rows.select(F.col(place).alias("_p"), F.col(value).cast("double").alias("_v")), "places"), ["_p"], "_i")
    whole = x.agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"))  # one row
    block = F.floor(F.col("_i") / PLACES)
    packed = x.join(F.broadcast(whole)).where(F.col("_v").isNotNull()).groupBy(block.alias("_b"), "_n")
    packed = packed.agg(F.collect_list("_i").alias("_i"), F.collect_list(F.col("_v") - F.col("_m")).alias("_v"))
    last = F.floor(F.floor(F.col("_n") / 2) / PLACES)
    met = packed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pairs = -(-x.count() // PLACES)
    met = met.repartition(min(1 << 10, max(1, pairs * pairs // 2)), "_b", "_k")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k = np.arange(row["_k"] * PLACES, min((row["_k"] + 1) * PLACES, row["_n"] // 2 + 1))
                i, v = np.array(row["_i"], np.float64), np.array(row["_v"])
                re, im = np.zeros((2, len(k)))
                for at in range(0, len(k), 64):  # fits a cache
                    turn = (2 * np.pi * k[at : at + 64])[:, None] * i / row["_n"]
                    re[at : at + 64], im[at : at + 64] = np.cos(turn) @ v, np.sin(turn) @ v
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), row["_n"])), pa.array(re), pa.array(im)], ["k", "_n", "_re", "_im"])

    parts = met.select("_n", "_k", "_i", "_v").mapInArrow(transform, "k long, _n long, _re double, _im double")
    out = parts.groupBy("k").agg(F.max("_n").alias("_n"), (F.pow(F.sum("_re"), 2) + F.pow(F.sum("_im"), 2)).alias("power"))
    return out.select("k", F.when(F.col("k") > 0, F.col("_n") / F.col("k")).alias("period"), "power")


def triggered_sums(triggers: DataFrame, rows: DataFrame, by: str, at: str, value: str, width: int, lags: int) -> DataFrame:
    """``(lag, n, mean)``: over all rows, ``lag`` to ``lag + 1`` times ``width`` after a trigger of the same group, at or above zero (SP12).

    A pair of trigger and row is never a row: triggers are counted where rows lie, 0 to ``lags`` widths earlier. In buckets of a
    width each, the triggers in a span that ends at a place are those up to it in its bucket and those beyond in the bucket before.
    """
    bucket, rest = F.floor(F.col(at) / F.lit(width)), F.pmod(F.col(at), F.lit(width))
    a = triggers.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(by).alias("_g"), bucket.alias("_b"), rest.alias("_r")).agg(F.count(F.lit(1)).alias("_t"))
    b = rows.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(by).alias("_g"), bucket.alias("_b"), rest.alias("_r"))
    b = b.agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_k"), F.sum(F.col(value).cast("double")).alias("_s"))
    b = b.select("_g", "_b", "_r", "_n", "_k", "_s", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("_lag")).withColumn("_b", F.col("_b") - F.col("_lag"))
    w = Window.partitionBy("_g", "_b")
    met = a.unionByName(b, allowMissingColumns=True).withColumns({
        "_before": F.coalesce(F.sum("_t").over(w.orderBy("_r").rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        "_all": F.coalesce(F.sum("_t").over(w), F.lit(0)),
    }).where("_lag is not null and _all > 0")
    one = lambda lag, count: F.struct((F.col("_lag") + lag).cast("long").alias("lag"), count.alias("c"))
    parts = met.select("_n", "_k", "_s", F.explode(F.array(one(0, F.col("_before")), one(-1, F.col("_all") - F.col("_before")))).alias("_p"))
    parts = parts.select("_n", "_k", "_s", "_p.*").where(F.col("c") > 0).where(F.col("lag").between(0, lags - 1))
    return parts.groupBy("lag").agg(F.sum(F.col("c") * F.col("_n")).alias("n"), F.try_divide(F.sum(F.col("c") * F.col("_s")), F.sum(F.col("c") * F.col("_k"))).alias("mean"))


def _pair_sums(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], sums: np.ndarray) -> None:
    """Adds what two blocks of channels share in a slab of frames: rows, values, their sums, squares and products, values that aren't finite."""
    (px, qx, vx, ox), (py, qy, vy, oy) = x, y
    for i, (left, right) in enumerate(((px, py), (qx, qy), (vx, qy), (qx, vy), (vx * vx, qy), (qx, vy * vy), (vx, vy))):
        sums[i] += left @ right.T
    if ox.any() or oy.any():
        sums[7] += ox @ qy.T + qx @ oy.T


def _correlations(sums: np.ndarray) -> np.ndarray:
    """Correlations from :func:`_pair_sums`; NaN where they aren't defined, a spread below 1e-13 of the squares being none."""
    _, n, sx, sy, xx, yy, xy, odd = sums
    dx, dy = n * xx - sx * sx, n * yy - sy * sy
    some = (n > 1) & (odd == 0) & (dx > 1e-13 * n * xx) & (dy > 1e-13 * n * yy)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(some, (n * xy - sx * sy) / (np.sqrt(dx) * np.sqrt(dy)), np.nan)


def pairwise_correlation(rows: DataFrame, channel: str, at: str, value: str, least: int) -> DataFrame:
    """``(a, b, n, r)``: the correlation of every two channels, a < b, over their common frames, where there are ``least`` or more (SP13).

    A row per channel and frame is expected, frames being whole numbers. Channels are numbered and cut into blocks; two blocks
    meet slab by slab of frames as products of matrices, so a task holds sums of two blocks and a slab, and no pair is a row
    before its result. Values are taken from the channel's rounded mean. Null values count in n alone; r is NaN where undefined.
    """
    held = rows.select(F.col(channel).alias("_c"), F.col(at).cast("long").alias("_t"), F.col(value).cast("double").alias("_v")).where("_c is not null and _t is not null")
    held = materialize(held, "series")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    names = numbered(held.groupBy("_c").agg(F.coalesce(F.round(F.avg(finite)), F.lit(0.0)).alias("_m")), ["_c"], "_i")
    count = max(1, names.count())
    side = -(-count // max(-(-count // SIDE), min(SPREAD, -(-count // 128))))
    blocks = -(-count // side)
    entry = F.struct(F.pmod("_t", F.lit(SLAB)).cast("int").alias("t"), (F.col("_v") - F.col("_m")).alias("v"))
    packed = held.join(names, "_c").groupBy("_c", "_i", F.floor(F.col("_t") / SLAB).alias("_slab")).agg(F.collect_list(entry).alias("_x"))
    own, place = F.floor(F.col("_i") / side).cast("int").alias("_own"), (F.col("_i") % side).cast("int").alias("_place")
    dealt = packed.select("_slab", own, place, "_c", F.col("_x.t").alias("_t"), F.col("_x.v").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    dealt = dealt.select(F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_slab", "_own", "_place", "_c", "_t", "_v")
    dealt = dealt.repartition(min(1 << 11, blocks * (blocks + 1) // 2), "_a", "_b").sortWithinPartitions("_a", "_b", "_slab")
    kind = rows.schema[channel].dataType.simpleString()

    def slab(parts: list[pa.RecordBatch], block: int, names: dict[int, object]) -> tuple[np.ndarray, ...]:
        """Rows, values that count, these values and those that aren't finite, of the channels of a block."""
        rows, counts, values = np.zeros((3, side, SLAB))
        for part in parts:
            mine = part.filter(pa.array(part.column("_own").to_numpy() == block))
            place = mine.column("_place").to_numpy()
            names.update(zip(place.tolist(), mine.column("_c").to_pylist(), strict=True))
            at, found = mine.column("_t"), mine.column("_v").flatten()
            where = np.repeat(place, np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()
            rows[where] = 1
            counts[where] = ~found.is_null().to_numpy(zero_copy_only=False)
            values[where] = found.fill_null(0).to_numpy()
        odd = ~np.isfinite(values)
        values[odd] = 0
        return rows, counts, values, odd.astype(np.float64)

    def result(a: int, b: int, sums: np.ndarray, left: dict[int, object], right: dict[int, object]) -> Iterator[pa.RecordBatch]:
        r, x, y = _correlations(sums), np.array(sorted(left)), np.array(sorted(right))
        ends = pa.array([right[j] for j in y.tolist()])
        for i in x.tolist():
            here = np.flatnonzero((sums[0][i, y] >= least) & ((a < b) | (y > i)))
            if len(here):
                columns = [pa.array([left[i]] * len(here)), ends.take(pa.array(here)), pa.array(sums[0][i, y[here]].astype(np.int64)), pa.array(r[i, y[here]], mask=sums[1][i, y[here]] == 0)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "r"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
            for batch in batches:
                keys = np.column_stack([batch.column(c).to_numpy() for c in ("_a", "_b", "_slab")])
                cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
                for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    if end > start:
                        yield tuple(keys[start].tolist()), batch.slice(start, end - start)

        for (a, b), of_pair in groupby(pieces(), lambda p: p[0][:2]):
            sums, left, right = np.zeros((8, side, side)), {}, {}
            for _, of_slab in groupby(of_pair, lambda p: p[0]):
                parts = [p for _, p in of_slab]
                x = slab(parts, a, left)
                _pair_sums(x, x if a == b else slab(parts, b, right), sums)
            yield from result(a, b, sums, left, left if a == b else right)

    return dealt.mapInArrow(meet, f"a {kind}, b {kind}, n long, r double")


def synthetic_emg(rows: DataFrame, window: int, channel: str = "channel", at: str = "frame", value: str = "value", frames: DataFrame | None = None) -> DataFrame:
    """``(win, per_window, global)``: mean correlation of all pairs of channels in windows of ``window`` frames (SP13).

    per_window standardises each channel within the window, global over the whole recording. Then the mean over
    pairs is ((sum z)^2 - sum z^2) / (n (n - 1)), averaged over frames, so no pair of channels is formed. Channels that
    don't vary in a window take no part in it. Every channel is expected at every frame; with ``frames`` (a column ``at``: all frames
    of the recording) a channel is 0 where it has no value. These zeros follow from counts and are no rows.
    """
    x = rows.select(F.col(channel).alias("_c"), F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"), F.floor(F.col(at) / F.lit(window)).alias("win"))
    v, m, s, gm, gs = (F.col(c) for c in ("_v", "_m", "_s", "_gm", "_gs"))
    local = x.groupBy("win", "_c").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    whole = x.groupBy("_c").agg(F.avg("_v").alias("_gm"), F.stddev_pop("_v").alias("_gs"))
    mean = lambda a, aa, n: F.avg(F.when(F.col(n) > 1, (F.col(a) * F.col(a) - F.col(aa)) / (F.col(n) * (F.col(n) - 1))))
    means = (mean("_a", "_aa", "_n").alias("per_window"), mean("_b", "_bb", "_k").alias("global"))
    if frames is None:
        z, g = F.when(s > 0, (v - m) / s), F.when(gs > 0, (v - gm) / gs)
        each = x.join(local.join(whole, "_c"), ["win", "_c"]).groupBy("win", "_t").agg(
            F.sum(z).alias("_a"), F.sum(z * z).alias("_aa"), F.count(z).alias("_n"), F.sum(g).alias("_b"), F.sum(g * g).alias("_bb"), F.count(g).alias("_k")
        )
        return each.groupBy("win").agg(*means)
    x = x.where(F.col("_c").isNotNull() & F.col("_t").isNotNull()).withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    span = frames.select(F.col(at).alias("_t"), F.floor(F.col(at) / F.lit(window)).alias("win"))

    def moments(by: list[str], sizes: DataFrame, m: str, s: str) -> DataFrame:
        found = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_has"), F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var"))
        found = found.join(F.broadcast(sizes), "win") if "win" in by else found.crossJoin(F.broadcast(sizes))  # a row a window, or one
        share = F.col("_has") / F.col("_size")
        spread = share * F.col("_var") + F.col("_mean") * F.col("_mean") * share * (1 - share)
        return found.select(*by, (F.col("_mean") * share).alias(m), F.sqrt(spread).alias(s))

    size = F.count(F.lit(1)).alias("_size")
    local, whole = moments(["win", "_c"], span.groupBy("win").agg(size), "_m", "_s"), moments(["_c"], span.agg(size), "_gm", "_gs")
    # where all channels have no value, and what the values that they have change of it
    total = lambda m, s, a, aa, n: (F.sum(F.when(s > 0, -m / s)).alias(a), F.sum(F.when(s > 0, m * m / (s * s))).alias(aa), F.count_if(s > 0).alias(n))
    change = lambda m, s, a, aa: (F.sum(F.when(s > 0, v / s)).alias(a), F.sum(F.when(s > 0, v * (v - 2 * m) / (s * s))).alias(aa))
    own = x.join(local.join(whole, "_c"), ["win", "_c"]).groupBy("win", "_t").agg(*change(m, s, "_pa", "_paa"), *change(gm, gs, "_pb", "_pbb"))
    none = local.groupBy("win").agg(*total(m, s, "_oa", "_oaa", "_n"))
    never = whole.agg(*total(gm, gs, "_ob", "_obb", "_k"))
    each = span.join(own, ["win", "_t"], "left").join(F.broadcast(none), "win", "left").crossJoin(F.broadcast(never)).na.fill(0)
    each = each.withColumns({f"_{c}": F.col(f"_o{c}") + F.col(f"_p{c}") for c in ("a", "aa", "b", "bb")})
    return each.groupBy("win").agg(*means)

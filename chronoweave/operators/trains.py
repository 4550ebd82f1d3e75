"""Operators on event trains: rows of (grp, unit, frame), frames 64-bit, everything within a group.

Tolerance joins take one shuffle: both sides are united, and a window over a bucket of the group's frames looks
up the nearest reference on either side, so a busy group costs sorts rather than a product of its sides. Band
joins meet in buckets as wide as the band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.order import previous


def nearest_gap(query: DataFrame, ref: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``query`` with ``gap``: distance from its frame to the nearest of ``ref`` in the group (null: none)."""
    by = by or ["grp"]
    names = query.columns
    q = query.select(*names, F.lit(1).alias("_side"))
    r = ref.select(*by, "frame").select(*[F.col(n) if n in by or n == "frame" else F.lit(None).cast(query.schema[n].dataType).alias(n) for n in names], F.lit(0).alias("_side"))
    both = q.unionByName(r).withColumn("_ref", F.when(F.col("_side") == 0, F.col("frame")))
    # references of an equal frame sort before the query in the one window and after it in the other
    back = Window.partitionBy(*by).orderBy("frame", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col("frame").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_ref", True).over(back)).withColumn("_after", F.last("_ref", True).over(ahead))
    gap = F.least(F.col("frame") - F.col("_before"), F.col("_after") - F.col("frame"))
    return both.where("_side = 1").select(*names, gap.alias("gap"))


#: Event pairs that a correlogram looks at one by one together; units and events of a block; windows of a span.
SWEPT = 1 << 20
UNITS, EVENTS, SPAN = 1024, 1 << 21, 64
#: Bins to a lag; bins that are multiplied together; products of a bin that cost as much as looking at an event pair.
BINS, STRIP, WORTH = 120, 1024, 512
#: Buckets of a tolerance join are this many tolerances wide: few references are repeated at their edges, and
#: a group's frames still spread over many tasks.
BUCKET_TOLERANCES = 256


def within_tol(query: DataFrame, ref: DataFrame, tol: int, by: list[str] | None = None) -> DataFrame:
    """``query`` with ``hit``: whether a reference lies within the tolerance, both ends included (JN1).

    Frames are cut into buckets; references within the tolerance of an edge also go to the bucket beyond it.
    So neither a busy group nor a long recording ends in one task.
    """
    by = by or ["grp"]
    width = BUCKET_TOLERANCES * (tol + 1)
    bucket = F.floor(F.col("frame") / F.lit(width))
    inside = F.col("frame") - bucket * width
    near = F.array(bucket, F.when(inside < tol, bucket - 1), F.when(inside >= width - tol, bucket + 1))
    r = ref.select(*by, "frame", F.explode(F.array_compact(near)).alias("_bucket"))
    found = nearest_gap(query.withColumn("_bucket", bucket), r, [*by, "_bucket"])
    return found.withColumn("hit", F.coalesce(F.col("gap") <= tol, F.lit(False))).drop("gap", "_bucket")


def outside_tol(query: DataFrame, ref: DataFrame, tol: int, by: list[str] | None = None) -> DataFrame:
    """Rows of ``query`` with no reference within the tolerance (JN2, SET4)."""
    return within_tol(query, ref, tol, by).where(~F.col("hit")).drop("hit")


def with_interval(train: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``d``, the frames since the previous event (WN1); see :func:`chronoweave.plans.order.previous` for busy units."""
    return previous(train, by or ["unit"], ["frame"], "frame", "d").withColumn("d", F.col("frame") - F.col("d"))


def collapse(train: DataFrame, tol: int, by: list[str] | None = None) -> DataFrame:
    """First event of each run whose successive gaps are at most ``tol``; gaps chain over dropped events (WN2).

    An event stays if none comes within ``tol`` before it, so frames are cut into buckets, and events within ``tol`` of a
    bucket's end also go to the next: a busy group spreads over tasks.
    """
    by = by or ["unit"]
    width = BUCKET_TOLERANCES * (tol + 1)
    bucket = F.floor(F.col("frame") / F.lit(width))
    near = F.array(bucket, F.when(F.col("frame") - bucket * width >= width - tol, bucket + 1))
    cut = train.withColumns({"_own": bucket, "_bucket": F.explode(F.array_compact(near))})
    d = F.col("frame") - F.lag("frame").over(Window.partitionBy(*by, "_bucket").orderBy("frame"))
    return cut.withColumn("_d", d).where("_own = _bucket").where(F.col("_d").isNull() | (F.col("_d") > tol)).drop("_own", "_bucket", "_d")


def nearest_within(query: DataFrame, ref: DataFrame, tol: int, carry: str, by: list[str] | None = None) -> DataFrame:
    """``query`` with ``gap``, ``at`` and ``carry`` of the nearest reference within the tolerance, null where there is none (JN18).

    Of equally near ones the earlier counts, of those at one frame the one of the smallest ``carry``. As in
    :func:`within_tol`, both sides are united in buckets; no pair is formed.
    """
    by = by or ["grp"]
    width = BUCKET_TOLERANCES * (tol + 1)
    bucket = F.floor(F.col("frame") / F.lit(width))
    inside = F.col("frame") - bucket * width
    near = F.array(bucket, F.when(inside < tol, bucket - 1), F.when(inside >= width - tol, bucket + 1))
    r = ref.select(*by, "frame", F.col(carry).alias("_c"), F.explode(F.array_compact(near)).alias("_bucket"), F.lit(0).alias("_side"))
    q = query.withColumns({"_row": F.struct(*query.columns), "_bucket": bucket, "_side": F.lit(1), "_c": F.lit(None).cast(ref.schema[carry].dataType)})
    both = q.select(*by, "frame", "_c", "_bucket", "_side", "_row").unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_ref", F.when(F.col("_side") == 0, F.struct(F.col("frame").alias("at"), F.col("_c").alias(carry))))
    last = lambda order: F.last("_ref", True).over(Window.partitionBy(*by, "_bucket").orderBy(order, "_side", F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_before": last(F.col("frame")), "_after": last(F.col("frame").desc())}).where("_side = 1")
    away = lambda side: F.when(F.abs(F.col(f"{side}.at") - F.col("frame")) <= tol, F.struct(F.abs(F.col(f"{side}.at") - F.col("frame")).alias("gap"), f"{side}.at", f"{side}.{carry}"))
    best = F.least(away("_before"), away("_after")).alias("_best")
    return both.select("_row", best).select("_row.*", "_best.gap", "_best.at", F.col(f"_best.{carry}").alias(f"near_{carry}"))


def isi_violation(train: DataFrame, refractory: int, by: list[str] | None = None) -> DataFrame:
    """Per unit: events, intervals below the refractory time and their share (null below two events) (AG4)."""
    by = by or ["unit"]
    return (
        with_interval(train, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.coalesce(F.sum((F.col("d") < refractory).cast("long")), F.lit(0)).alias("n_violations"),
            F.round(F.avg((F.col("d") < refractory).cast("double")), 6).alias("violation_rate"),
        )
    )


def band_pairs(a: DataFrame, b: DataFrame, lag: int, by: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, unit_a, unit_b, frame_a, frame_b)`` with -lag <= frame_b - frame_a < lag (JN3).

    Sides meet in buckets of ``lag`` frames and their neighbours, so a group's product never forms. Columns
    named in ``extra`` come along from both sides, with the same endings.
    """
    by = by or ["grp"]
    bucket = lambda f: F.floor(f / F.lit(lag))
    side = lambda df, end: df.select(*by, *[F.col(c).alias(f"{c}_{end}") for c in ("unit", "frame", *extra)])
    left = side(a, "a")
    left = left.withColumn("_b", F.explode(F.array(*[bucket(F.col("frame_a")) + i for i in (-1, 0, 1)])))
    right = side(b, "b").withColumn("_b", bucket(F.col("frame_b")))
    d = F.col("frame_b") - F.col("frame_a")
    return left.join(right, [*by, "_b"]).where((d >= -lag) & (d < lag)).drop("_b")


def co_active(train: DataFrame, window: int, least: int) -> DataFrame:
    """Windows where a unit has at least ``least`` events: ``(grp, unit, win)``."""
    win = F.floor(F.col("frame") / F.lit(window)).alias("win")
    return train.groupBy("grp", "unit", win).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def verdict(ratio: Column, n_co: Column, dip: float = 0.30, fill: float = 0.70, least: int = 2) -> Column:
    """What a central/flank ratio says of a pair (FN6)."""
    return (
        F.when((n_co < least) | ratio.isNull() | F.isnan(ratio), "SEGREGATED")
        .when(ratio < dip, "duplicate")
        .when(ratio > fill, "distinct")
        .otherwise("ambiguous")
    )


class _Counter:
    """Central and flank counts of the units of two blocks, from lists of events ``(unit, frame)``, units as places in their block.

    Frames are binned. Where the bins of two events alone say that their distance counts, pairs of units are counted by
    products of matrices (units by bins, bins by units); only event pairs at an edge of what counts are looked at one by one.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, refractory: float, flank: tuple[float, float], lag: int, limits: tuple[int, int, int, int]) -> None:
        self.swept, bins, self.strip, self.worth = limits
        self.x, self.y, self.refractory, self.flank, self.lag = x, y, refractory, flank, lag
        self.central, self.side = np.zeros(len(x) * len(y), np.int64), np.zeros(len(x) * len(y), np.int64)
        self.bin = max(1, lag // bins)
        self.reach = lag // self.bin + 1
        d = np.arange(-self.reach, self.reach + 1)
        # distances of events whose bins are d apart
        least, most = np.maximum(0, (np.abs(d) - 1) * self.bin + 1), (np.abs(d) + 1) * self.bin - 1
        near, beside = (most <= refractory) & (most < lag), (least >= flank[0]) & (most <= flank[1]) & (most < lag)
        never = (least > lag) | ((least > refractory) & ((most < flank[0]) | (least > flank[1])))
        sure = never | ((near | (least > refractory)) & (beside | (most < flank[0]) | (least > flank[1])) & (most < lag))
        runs = lambda on: [(int(r[0]), int(r[-1])) for r in np.split(d[on], np.flatnonzero(np.diff(d[on]) > 1) + 1) if len(r)]
        self.near, self.beside, self.open = runs(near & sure), runs(beside & sure), runs(~sure)

    def meet(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> None:
        (ux, fx), (uy, fy) = ([v[np.argsort(side[1], kind="stable")] for v in side] for side in (x, y))
        kx, ky = fx // self.bin, fy // self.bin
        if len(ky):
            # of neighbouring windows only what lies about their border can meet
            a, b = np.searchsorted(kx, ky[0] - self.reach), np.searchsorted(kx, ky[-1] + self.reach, "right")
            ux, fx, kx = ux[a:b], fx[a:b], kx[a:b]
        at = 0
        while at < len(kx) and len(ky):
            to = int(np.searchsorted(kx, kx[at] + self.strip))
            lo, hi = np.searchsorted(ky, kx[at] - self.reach), np.searchsorted(ky, kx[to - 1] + self.reach, "right")
            if lo < hi:
                self._strip((ux[at:to], fx[at:to], kx[at:to]), (uy[lo:hi], fy[lo:hi], ky[lo:hi]))
            at = to

    def _strip(self, x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> None:
        (ux, _, kx), (uy, _, ky) = x, y
        first, bins = int(kx[0]), int(kx[-1] - kx[0]) + 1
        nx, ny = len(self.x), len(self.y)
        met = (np.searchsorted(ky, kx + self.reach, "right") - np.searchsorted(ky, kx - self.reach)).sum()
        if met * self.worth < nx * ny * bins:
            return self._look(x, y, [(-self.reach, self.reach)])
        # products and sums stay below what a float of four bytes counts exactly
        most = float(np.bincount(ux).max()) * float(np.bincount(uy).max())
        kind = np.float32 if most < 1 << 24 else np.float64
        own = np.bincount(ux * bins + (kx - first), minlength=nx * bins).reshape(nx, bins).astype(kind)
        base = first - self.reach
        theirs = np.bincount((ky - base + 1) * ny + uy, minlength=(bins + 2 * self.reach + 1) * ny)
        before = theirs.reshape(-1, ny).astype(kind).cumsum(axis=0)
        seen = lambda runs: sum(before[b + self.reach + 1 :][:bins] - before[a + self.reach :][:bins] for a, b in runs)
        if self.near and self.beside and most < 1 << 12:
            # both counts are below 4096, so one product holds them as two digits
            both = (own @ (seen(self.near) + seen(self.beside) * kind(1 << 12))).ravel().astype(np.int32)
            self.central += both & 4095
            self.side += both >> 12
        else:
            for runs, total in ((self.near, self.central), (self.beside, self.side)):
                if runs:
                    total += (own @ seen(runs)).ravel().astype(np.int64)
        self._look(x, y, self.open)

    def _look(self, x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], runs: list[tuple[int, int]]) -> None:
        (ux, fx, kx), (uy, fy, ky) = x, y
        for a, b in runs:
            start = np.searchsorted(ky, kx + a)
            met = np.searchsorted(ky, kx + b, "right") - start
            ends, at = np.cumsum(met), 0
            while at < len(kx):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.swept, "right")))
                times = met[at:to]
                i = np.repeat(np.arange(at, to), times)
                j = np.repeat(start[at:to] - (np.cumsum(times) - times), times) + np.arange(len(i))
                at, ahead = to, fy[j] - fx[i]
                d = np.abs(ahead)
                # a pair at the lag itself counts if the earlier event is of the smaller unit
                last = d == self.lag
                if last.any():
                    last[last] = (self.x[ux[i[last]]] < self.y[uy[j[last]]]) == (ahead[last] > 0)
                within = (d < self.lag) | last
                pair = ux[i] * len(self.y) + uy[j]
                for total, on in ((self.central, d <= self.refractory), (self.side, (d >= self.flank[0]) & (d <= self.flank[1]))):
                    found = pair[on & within]
                    if len(found) * 16 > len(total):
                        total += np.bincount(found, minlength=len(total))
                    else:
                        np.add.at(total, found, 1)


def _counted(
    key: tuple[pa.Scalar, ...], table: pa.Table, wanted: pa.Table | None, limits: tuple[int, int, int, int], refractory: float, flank: tuple[float, float], lag: int,
    tally: tuple[int, int, int] | None = None,
) -> pa.Table:
    """The pairs of units of two blocks (of one, where they are the same) within a span of windows; see :func:`ccg_counts`.

    With ``tally`` the numbers of pairs that are alike instead; see :func:`ccg_tally`.
    """
    table = table.combine_chunks()
    _, mine, theirs, span = (k.as_py() for k in key)
    block, unit, span_of = (table.column(c).to_numpy() for c in ("block", "unit", "span"))
    win = table.column("win").fill_null(0).to_numpy()
    size = table.column("frames").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    ends, frame = np.cumsum(size), table.column("frames").combine_chunks().flatten().to_numpy()
    shown = {True: table.column("ahead").to_numpy(), False: table.column("back").to_numpy()}
    x, y = np.unique(unit[block == mine]), np.unique(unit[block == theirs])
    counter, shared = _Counter(x, y, refractory, flank, lag, limits), np.zeros((len(x), len(y)), np.int64)

    def taken(names: np.ndarray, of: int, w: int, flag: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero((block == of) & (win == w) & (size > 0) & (True if flag is None else shown[flag]))
        inside = np.arange(size[rows].sum()) + np.repeat(ends[rows] - np.cumsum(size[rows]), size[rows])
        return np.repeat(np.searchsorted(names, unit[rows]), size[rows]), frame[inside]

    for w in np.unique(win[(span_of == span) & (size > 0)]):
        a, b = taken(x, mine, w), taken(y, theirs, w)
        counter.meet(a, b)
        shared[np.ix_(np.unique(a[0]), np.unique(b[0]))] += 1
        # of neighbouring windows count the events of units that are active in both
        counter.meet(taken(x, mine, w, True), taken(y, theirs, w + 1, False))
        counter.meet(taken(x, mine, w + 1, False), taken(y, theirs, w, True))
    central, side = (t.reshape(shared.shape) for t in (counter.central, counter.side))
    if wanted is not None:
        wa, wb = (wanted.column(c).to_numpy() for c in ("unit_a", "unit_b"))
        there = (np.isin(wa, x) & np.isin(wb, y)) if len(x) and len(y) else np.zeros(len(wa), bool)
        turned = (np.isin(wa, y) & np.isin(wb, x) & ~there) if len(x) and len(y) else there
        p, q = np.where(turned, wb, wa)[there | turned], np.where(turned, wa, wb)[there | turned]
        i, j = np.searchsorted(x, p), np.searchsorted(y, q)
    else:
        different = x[:, None] < y[None, :] if mine == theirs else np.ones(shared.shape, bool)
        # the first span has every unit of the blocks, so it gives every pair
        i, j = np.nonzero(different if (span_of == span)[size == 0].any() else different & (shared > 0))
    if tally is not None:
        u, v = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
        digits = [np.fmod(tally[0] * u + tally[1] * v, tally[2]), shared[i, j], central[i, j], side[i, j]]
        least = [int(d.min(initial=0)) for d in digits]
        shape = [int(d.max(initial=0)) - a + 1 for d, a in zip(digits, least, strict=True)]
        alike, n = np.unique(np.ravel_multi_index([d - a for d, a in zip(digits, least, strict=True)], shape), return_counts=True)
        found = [d + a for d, a in zip(np.unravel_index(alike, shape), least, strict=True)]
        return pa.table(dict(zip(("mix", "n_co", "central", "flank", "n"), (*found, n), strict=True)))
    return pa.table({
        "grp": pa.repeat(key[0], len(i)), "unit_a": np.minimum(x[i], y[j]), "unit_b": np.maximum(x[i], y[j]),
        "n_co": shared[i, j], "central": central[i, j], "flank": side[i, j],
    })


def ccg_counts(
    train: DataFrame, window: int, refractory: float, flank: tuple[float, float], lag: int, least_events: int, pairs: DataFrame | None = None,
    tally: tuple[int, int, int] | None = None,
) -> DataFrame:
    """``(grp, unit_a, unit_b, n_co, central, flank)`` of every pair of units of a group, unit_a < unit_b, or of those in ``pairs`` alone.

    With ``tally`` (not with ``pairs``) ``(mix, n_co, central, flank, n)`` instead; see :func:`ccg_tally`.

    Units of a group are cut into blocks by hash, and windows into spans; a task has two blocks in a span. No pair of events is a
    row, and no pair of units is shuffled unless there are several spans, whose counts are added up.
    """
    if lag > window:
        raise ValueError("lags may not exceed the window")
    train = train.where("grp is not null and unit is not null")
    if pairs is not None:
        grp, unit = (train.schema[c].dataType for c in ("grp", "unit"))
        ends = [f("unit_a", "unit_b").cast(unit).alias(c) for f, c in ((F.least, "unit_a"), (F.greatest, "unit_b"))]
        pairs = pairs.select(F.col("grp").cast(grp).alias("grp"), *ends).distinct()
        named = pairs.select("grp", F.explode(F.array("unit_a", "unit_b")).alias("unit")).distinct()
        train = train.join(named, ["grp", "unit"], "left_semi")
    win = F.floor(F.col("frame") / F.lit(window)).alias("win")
    by_window = train.groupBy("grp", "unit", win).agg(F.count("frame").alias("n"), F.collect_list("frame").alias("frames"))
    active = by_window.where((F.col("n") >= least_events) & F.col("win").isNotNull())
    order = Window.partitionBy("grp", "unit").orderBy("win")
    beside = lambda f, i: F.coalesce(f("win").over(order) == F.col("win") + i, F.lit(False))
    units = train.groupBy("grp", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    sizes = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("events"), F.min("a").alias("a"), F.max("b").alias("b"))
    ends = sizes.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()  # two numbers
    first = (ends.a or 0) // window
    spans = 1 + ((ends.b or 0) // window - first) // SPAN
    sizes = sizes.select("grp", F.greatest(F.ceil(F.col("n") / UNITS), F.ceil(F.col("events") / spans / EVENTS)).cast("int").alias("blocks"))
    tasks = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1  # one number
    block = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    span = F.floor((F.col("win") - first) / F.lit(SPAN))
    # a span also sees the first window after it
    seen = F.array_compact(F.array(span, F.when(((F.col("win") - first) % SPAN == 0) & (span > 0), span - 1)))
    shown = active.select("grp", "unit", "win", "frames", beside(F.lag, -1).alias("back"), beside(F.lead, 1).alias("ahead"), span.alias("span"), seen.alias("seen"))
    no = F.lit(False)
    bare = units.select("grp", "unit", F.lit(None).cast("long").alias("win"), F.array().cast("array<long>").alias("frames"), no.alias("back"), no.alias("ahead"), F.lit(0).cast("long").alias("span"), F.array(F.lit(0).cast("long")).alias("seen"))
    placed = shown.withColumn("frames", F.col("frames").cast("array<long>")).unionByName(bare).join(sizes, "grp").withColumn("block", block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.explode("seen"))
    placed = placed.select("grp", F.least("block", "other").alias("_x"), F.greatest("block", "other").alias("_y"), "part", "block", "unit", "win", "frames", "back", "ahead", "span")
    keys = ["grp", "_x", "_y", "part"]
    dealt = placed.repartition(int(min(max(1, tasks * spans), 4096)), *keys)
    grp, unit = (train.schema[c].dataType.simpleString() for c in ("grp", "unit"))
    limits = SWEPT, BINS, STRIP, WORTH
    out = f"grp {grp}, unit_a {unit}, unit_b {unit}, n_co long, central long, flank long"
    if pairs is None and tally is not None and spans == 1:
        alike = dealt.groupBy(*keys).applyInArrow(lambda key, table: _counted(key, table, None, limits, refractory, flank, lag, tally), "mix long, n_co long, central long, flank long, n long")
        return alike.groupBy("mix", "n_co", "central", "flank").agg(F.sum("n").alias("n"))
    if pairs is None:
        counts = dealt.groupBy(*keys).applyInArrow(lambda key, table: _counted(key, table, None, limits, refractory, flank, lag), out)
    else:
        of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
        wanted = pairs.join(sizes, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
        wanted = wanted.select("grp", F.least(of("unit_a"), of("unit_b")).alias("_x"), F.greatest(of("unit_a"), of("unit_b")).alias("_y"), "part", "unit_a", "unit_b")
        nothing = pa.table({"unit_a": pa.array([], pa.int64()), "unit_b": pa.array([], pa.int64())})
        run = lambda key, table, asked: _counted(key, table if asked.num_rows else table.slice(0, 0), asked if asked.num_rows else nothing, limits, refractory, flank, lag)
        counts = dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, out)
    if spans > 1:
        counts = counts.groupBy("grp", "unit_a", "unit_b").agg(*[F.sum(c).alias(c) for c in ("n_co", "central", "flank")])
    if tally is None:
        return counts
    mix = (F.col("unit_a") * tally[0] + F.col("unit_b") * tally[1]) % tally[2]
    return counts.groupBy(mix.cast("long").alias("mix"), "n_co", "central", "flank").agg(F.count(F.lit(1)).alias("n"))


def ccg_verdicts(
    train: DataFrame, window: int, refractory: float, flank: tuple[float, float], lag: int, least_events: int = 5, least_flank: int = 30,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Per pair of units of a group (those of ``pairs``, where given): co-active windows, central and flank counts, ratio and verdict (JN4).

    Only windows where both units have ``least_events`` count; the counts see nothing else.
    """
    return _judged(ccg_counts(train, window, refractory, flank, lag, least_events, pairs), refractory, flank, least_flank)


def ccg_tally(
    train: DataFrame, window: int, refractory: float, flank: tuple[float, float], lag: int, least_events: int = 5, least_flank: int = 30,
    mix: tuple[int, int, int] = (0, 0, 1),
) -> DataFrame:
    """``(verdict, mix, n)``: numbers of pairs by verdict and by ``(p * unit_a + q * unit_b) % m``, ``mix`` being (p, q, m) (AG24, AG30, JN22).

    A task gives how many of its pairs have the same counts, unless there are several spans: no pair is a row.
    """
    alike = _judged(ccg_counts(train, window, refractory, flank, lag, least_events, tally=mix), refractory, flank, least_flank)
    return alike.groupBy("verdict", "mix").agg(F.sum("n").alias("n"))


def _judged(out: DataFrame, refractory: float, flank: tuple[float, float], least_flank: int) -> DataFrame:
    ratio = F.when(F.col("flank") >= least_flank, (F.col("central") / (2 * refractory)) / (F.col("flank") / (2 * (flank[1] - flank[0]))))
    out = out.withColumn("ratio", F.round(ratio, 6))
    return out.withColumn("verdict", verdict(F.col("ratio"), F.col("n_co")))


def rp_contamination(train: DataFrame, total_frames: int, refractory: int) -> DataFrame:
    """Contamination per unit from pairs within the refractory time (AG5); null below two events."""
    later = train.select("unit", "frame")
    pairs = band_pairs(
        later.withColumn("grp", F.col("unit")), later.withColumn("grp", F.col("unit")), refractory + 1
    ).where(F.col("frame_b") > F.col("frame_a"))
    found = pairs.groupBy(F.col("grp").alias("unit")).agg(F.count(F.lit(1)).alias("n_v"))
    n = train.groupBy("unit").agg(F.count(F.lit(1)).alias("n_events")).join(found, "unit", "left").na.fill(0, ["n_v"])
    inside = 1 - F.col("n_v") * F.lit(float(total_frames)) / (F.col("n_events") * F.col("n_events") * F.lit(float(refractory)))
    value = F.when(F.col("n_events") < 2, None).when(inside < 0, 1.0).otherwise(1 - F.sqrt(inside))
    return n.select("unit", "n_events", "n_v", F.round(value, 6).alias("contamination"))


def amplitude_band(amplitude: Column, edges: list[float]) -> Column:
    """Label of the half-open band that holds an amplitude: ``5.5-7``, and ``>24`` for the last (AG9, FN1)."""
    out = None
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        label = f">{lo:g}" if hi is None else f"{lo:g}-{hi:g}"
        test = amplitude >= lo if hi is None else (amplitude >= lo) & (amplitude < hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def coverage_by_band(peaks: DataFrame, train: DataFrame, tol: int, edges: list[float]) -> DataFrame:
    """Percent of peaks claimed by an event in tolerance, per amplitude band and overall, in one pass (AG9)."""
    claimed = within_tol(peaks, train, tol).withColumn("band", amplitude_band(F.col("value"), edges)).where("band is not null")
    total = claimed.groupingSets([[F.col("band")], []], F.col("band")).agg(
        F.grouping(F.col("band")).alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")) * 100, 6).alias("pct")
    )
    return total.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("band")).alias("band"), "n", "pct")


def plan_chunks(spark, n_frames: int, chunk: int, overlap: float, start: int = 0, end: int | None = None, least_tail: float = 0.5) -> DataFrame:
    """``(chunk, start_frame, end_frame)``: overlapping tiles; a runt tail goes to the tile before it (IT4)."""
    if not 0.0 <= overlap < 1.0:
        raise ValueError(f"overlap must be in [0, 1), not {overlap}")
    stride = int(round(chunk * (1.0 - overlap)))
    if stride < 1:
        raise ValueError("overlap leaves no stride")
    stop = n_frames if end is None else min(end, n_frames)
    if stop <= start:
        return spark.createDataFrame([], "chunk long, start_frame long, end_frame long")
    last = max(0, -(-(stop - start - chunk) // stride))  # tiles after the first, until one reaches the end
    tail = stop - (start + last * stride)
    dropped = last >= 1 and tail < int(least_tail * chunk)
    tiles = spark.range(last + 1 - dropped).select(
        F.col("id").alias("chunk"),
        (F.col("id") * stride + start).alias("start_frame"),
        F.least(F.col("id") * stride + start + chunk, F.lit(stop)).alias("end_frame"),
    )
    if dropped:
        tiles = tiles.withColumn("end_frame", F.when(F.col("chunk") == last - 1, F.lit(stop)).otherwise(F.col("end_frame")))
    return tiles


def ownership(chunks: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``hi``: each frame belongs to one chunk, split at the middle of overlaps (WN12)."""
    w = Window.partitionBy(F.lit(0)).orderBy("chunk")  # the chunk plan: a row per chunk, not per event
    lo = F.floor((F.col("start_frame") + F.lag("end_frame").over(w)) / 2)
    hi = F.floor((F.lead("start_frame").over(w) + F.col("end_frame")) / 2)
    return chunks.withColumns({"lo": F.coalesce(lo, "start_frame"), "hi": F.coalesce(hi, "end_frame")})

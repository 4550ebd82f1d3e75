"""Flows and verdicts on small made-up cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import quality as Q
from chronoweave.operators import series as S
from chronoweave.operators import signal as G
from chronoweave.operators import templates as T
from chronoweave.operators import tracking as K


def matching(a, b, tol):
    """The largest one-to-one matching, by augmenting paths."""
    owner = {}

    def place(i, seen):
        for j, y in enumerate(b):
            if abs(a[i] - y) <= tol and j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def test_agreement_is_one_to_one_on_crowded_trains(spark):
    rng = np.random.default_rng(0)
    trains = {(side, u): sorted(set(rng.integers(0, 120, 40).tolist())) for side in "ab" for u in range(3)}
    trains["a", 7], trains["b", 7] = [0, 2, 100], [1, 99, 101]
    side = lambda s: spark.createDataFrame([(0, u, f) for (x, u), t in trains.items() if x == s for f in [*t, t[0]]], "grp long, unit long, frame long")
    got = {(r.unit_a, r.unit_b): (r.n_match, r.jaccard) for r in Q.agreement(side("a"), side("b"), 1).collect()}
    for (u, v), (n, j) in got.items():
        a, b = trains["a", u], trains["b", v]
        assert n == matching(a, b, 1) and abs(j - n / (len(a) + len(b) - n)) < 1e-12
    assert got[7, 7] == (2, 0.5)


def test_assignment_beats_greedy_choice(spark):
    scores = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.85), (0, 2, 2, 0.1)], "grp long, unit_a long, unit_b long, jaccard double")
    got = {(r.unit_a, r.unit_b): r.reciprocal for r in Q.matched_units(scores, 0.5).collect()}
    assert got == {(1, 2): False, (2, 1): False}


def test_shifted_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 2))
    moved = np.concatenate([base[1:], rng.normal(size=(1, 2))])
    rows = [(0, 1, base.ravel().tolist()), (0, 2, moved.ravel().tolist()), (0, 3, [0.0] * 12), (0, 4, None), (1, 5, base.ravel().tolist()), (0, 6, [1.0, 2.0])]
    bank = spark.createDataFrame(rows + [(0, 10 + i, rng.normal(size=12).tolist()) for i in range(20)], "grp long, unit long, wf array<double>")
    assert {(r.a, r.b) for r in T.similar_pairs(bank, 0.999, 2, 1).collect()} == {(1, 2)}
    assert T.similar_pairs(bank, 0.999).count() == 0
    whole = {(r.a, r.b): round(r.cos, 9) for r in T.similar_pairs(bank, 0.1, 2, 1).collect()}
    monkeypatch.setattr(T, "BLOCK", 3)
    assert {(r.a, r.b): round(r.cos, 9) for r in T.similar_pairs(bank, 0.1, 2, 1).collect()} == whole


def test_cross_cosines_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, rng.normal(size=8).tolist()) for i in range(30)] + [(0, 90, None), (0, 91, [0.0] * 8), (0, 92, [1.0, 2.0]), (7, 93, [1.0] * 8)]
    df = spark.createDataFrame(rows, "grp long, unit long, wf array<double>")
    cut = lambda: {(r.a, r.b): round(r.cos, 9) for r in T.cross_cosines(df.where("unit % 3 <> 0"), df.where("unit % 3 = 0"), 2, 1).collect()}
    whole = cut()
    x = {u: np.array(w) for _, u, w in rows if w is not None}

    def direct(a, b):
        parts = [(a, b), (a[2:], b[:-2]), (a[:-2], b[2:])]
        return max([-1.0, *(float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q))) for p, q in parts if p.any() and q.any())])

    group = {u: g for g, u, _ in rows}
    assert whole == {(a, b): round(direct(x[a], x[b]), 9) for a in x for b in x if a % 3 and not b % 3 and group[a] == group[b] and len(x[a]) == len(x[b])}
    monkeypatch.setattr(T, "BLOCK", 3)
    assert cut() == whole
    top = {r.a: (round(r.cos, 9), -r.b) for r in T.cross_cosines(df.where("unit % 3 <> 0"), df.where("unit % 3 = 0"), 2, 1, best=True).collect()}
    assert top == {a: max((c, -b) for (x, b), c in whole.items() if x == a) for a, _ in whole}


def test_production_recovers_and_pools(spark):
    bank = spark.createDataFrame([(0, 1, [1.0, 0.0, 0.0]), (0, 2, [0.0, 1.0, 0.0])], "grp long, unit long, wf array<double>")
    merged = spark.createDataFrame([(0, 1, 100), (0, 1, 1000), (0, 2, 500)], "grp long, unit long, frame long")
    like = [3.0, 0.1, 0.0]
    peaks = [
        (1, 0, 101, 20.0, like),  # claimed
        (2, 0, 300, 20.0, like),  # recovered for unit 1
        (3, 0, 1005, 20.0, like),  # within unit 1's refractory time, and too similar for the pool
        (4, 0, 700, 9.0, like),  # too small to be recovered, too similar for the pool
        (5, 0, 710, 9.0, [1.0, 0.0, 1.0]),  # pooled
        (6, 0, 712, 9.0, [1.0, 0.0, 1.0]),  # the same event
        (7, 0, 301, 9.0, [1.0, 0.0, 1.0]),  # claimed by what was recovered
        (8, 0, 800, 6.0, [1.0, 0.0, 1.0]),  # below the floor
        (9, 0, 900, 9.0, [0.0, 0.0, 1.0]),  # like nothing
    ]
    df = spark.createDataFrame(peaks, "peak long, grp long, frame long, value double, wf array<double>")
    got = sorted(tuple(r) for r in K.production(merged, bank, df, 3, 10).collect())
    assert got == [(0, -1, 710, True), (0, 1, 100, False), (0, 1, 300, False), (0, 1, 1000, False), (0, 2, 500, False)]


def test_adjudication_states(spark):
    units = spark.createDataFrame([(0, 1, None), (0, 2, 5), (0, 3, 9), (1, 4, 2), (0, 5, 1), (0, 6, 5)], "grp long, unit long, birth long")
    bank = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0]), (1, 4, [1.0, 0.0]), (0, 6, [0.1, 0.9])], "grp long, unit long, wf array<double>")
    verdicts = spark.createDataFrame([(1, 2, 4, 0.1, "duplicate"), (3, 6, 4, 0.9, "distinct")], "unit_a long, unit_b long, n_co long, ratio double, verdict string")
    got = {r.unit: (r.match, r.verdict) for r in K.adjudicate(units, bank, verdicts, 2, 1, 0).collect()}
    assert got == {2: (1, "duplicate"), 3: (6, "distinct"), 4: (-1, "no-neighbour"), 5: (-1, "stillborn"), 6: (1, "SEGREGATED")}


def test_transients_equal_direct_computation(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, 3000) + 5 * np.sin(np.arange(3000) / 200)
    for at, height in ((300, 20), (306, 25), (312, 22), (1023, 30), (1024, 31), (2500, 15)):
        v[at] += height
    trace = spark.createDataFrame([(0, 7, i, float(x)) for i, x in enumerate(v)], "grp long, channel long, frame long, value double")
    got = {(r.frame, round(r.height, 6)) for r in G.transients(trace, 0.05, 8, block=1024).collect()}
    high = np.abs(v - G.filtered(v, G.lowpass_taps(0.05, 64)))
    level = np.median(high) + 6 * 1.4826 * np.median(np.abs(high - np.median(high)))
    peaks = [i for i in range(1, 2999) if high[i] > high[i - 1] and high[i] >= high[i + 1] and high[i] >= level]
    kept = []
    for i in sorted(peaks, key=lambda i: (-high[i], -i)):
        if all(abs(i - j) >= 8 for j in kept):
            kept.append(i)
    assert got == {(i, round(float(high[i]), 6)) for i in kept} and {306, 2500} <= set(kept) and 1024 in kept


def test_synthetic_emg_is_the_mean_of_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 60)) + rng.normal(size=60)
    x[4, 30:] = 1.0
    trace = spark.createDataFrame([(c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)], "channel long, frame long, value double")
    got = {r.win: r for r in S.synthetic_emg(trace, 30).collect()}
    for win, rows in ((0, x[:, :30]), (1, x[:4, 30:])):
        r = np.corrcoef(rows)
        n = len(rows)
        assert abs(got[win].per_window - (r.sum() - n) / (n * (n - 1))) < 1e-9
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    want = np.mean([(z[:, t].sum() ** 2 - (z[:, t] ** 2).sum()) / 20 for t in range(30)])
    assert abs(got[0]["global"] - want) < 1e-9


def test_synthetic_emg_needs_no_rows_of_zeros(spark):
    # channels have values at few frames; one has the same at all, one none in the second window, one a single zero and a null
    rng = np.random.default_rng(6)
    x = np.where(rng.random((7, 60)) < 0.4, rng.integers(1, 50, (7, 60)), 0).astype(float)
    x[4], x[5, 30:], x[6] = 3.0, 0.0, 0.0
    rows = [(c, i, float(v)) for c, row in enumerate(x) for i, v in enumerate(row)]
    few = [r for r in rows if r[2]] + [(6, 2, 0.0), (6, 40, None), (None, 3, 5.0), (1, None, 5.0)]
    shape = "channel long, frame long, value double"
    want = {r.win: r for r in S.synthetic_emg(spark.createDataFrame(rows, shape), 30).collect()}
    frames = spark.range(60).withColumnRenamed("id", "frame")
    asked = S.synthetic_emg(spark.createDataFrame(few, shape), 30, frames=frames)
    got = {r.win: r for r in asked.collect()}
    assert got.keys() == want.keys() == {0, 1}
    for win, r in want.items():
        assert abs(got[win].per_window - r.per_window) < 1e-9 and abs(got[win]["global"] - r["global"]) < 1e-9
    none = S.synthetic_emg(spark.createDataFrame([(1, 2, 5.0)], shape), 30, frames=frames).collect()
    assert sorted(tuple(r) for r in none) == [(0, None, None), (1, None, None)]


def test_spatial_spectrum_is_a_transform(spark):
    v = np.random.default_rng(4).normal(size=12)
    got = S.spatial_spectrum(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "c long, v double"), "c", "v").orderBy("k").collect()
    assert np.allclose([r.power for r in got], np.abs(np.fft.rfft(v - v.mean())) ** 2) and got[2].period == 6.0


@pytest.mark.parametrize(("fundamental", "n", "period", "resolution", "want"), [("SUSTAINED", 1, 150.0, 0.1, "SHARED CLOCK"), ("NONE", 2, 112.4, 0.1, "LIKELY SHARED"), ("NONE", 0, 149.5, 0.1, "SUGGESTIVE"), ("SUSTAINED", 1, 130.0, 0.1, "SUGGESTIVE"), ("NONE", 0, 130.0, 0.1, "NONE")])
def test_shared_clock(spark, fundamental, n, period, resolution, want):
    df = spark.createDataFrame([(fundamental, n, period, resolution)], "fundamental string, n_sustained long, period double, resolution double")
    assert S.shared_clock(df, 75.0).first().verdict == want


def test_intervals_hold_rows(spark):
    intervals = [(0, 5, "a"), (5, 5, "none"), (5, 100, "b"), (300, 301, "c"), (4, 6, "d")]
    df = spark.createDataFrame(intervals, "s long, e long, name string")
    got = sorted(tuple(r) for r in S.in_intervals(spark.range(302).select(F.col("id").alias("at")), df, "at", "s", "e", ["name"]).collect())
    assert got == sorted((x, n) for x in range(302) for s, e, n in intervals if s <= x < e)
    assert S.in_intervals(spark.range(3).toDF("at"), df.limit(0), "at", "s", "e", ["name"]).count() == 0


def test_verdicts_are_asked_for_matches_alone(spark):
    units = spark.createDataFrame([(0, 1, None), (0, 2, 5), (0, 3, 9)], "grp int, unit long, birth long")
    bank = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0])], "grp int, unit long, wf array<double>")
    asked = []

    def verdicts(pairs):
        asked.extend((r.grp, r.unit_a, r.unit_b) for r in pairs.collect())
        return pairs.select("unit_a", "unit_b", F.lit(3).cast("long").alias("n_co"), F.lit(0.1).alias("ratio"), F.lit("duplicate").alias("verdict")).withColumns({"unit_a": F.least("unit_a", "unit_b"), "unit_b": F.greatest("unit_a", "unit_b")})

    got = {r.unit: (r.match, r.verdict) for r in K.adjudicate(units, bank, verdicts, 2, 1, 0).collect()}
    assert sorted(asked) == [(0, 2, 1), (0, 3, 2)] and got == {2: (1, "duplicate"), 3: (2, "duplicate")}


def test_guarded_merge_of_groups_of_any_kind(spark):
    bank = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.5]), (0, 3, [0.9, 0.5]), (0, 4, [-1.0, 0.6])], "grp int, unit long, wf array<double>")
    a = [500 + 200 * i + 10_000 * w for i in range(40) for w in range(3)]
    rows = [(0, 1, f) for f in a] + [(0, 2, f + 300) for f in a] + [(0, 3, f + 7) for f in a] + [(0, 4, f) for f in a]
    train = spark.createDataFrame(rows, "grp int, unit long, frame long")
    ccg = {"window": 10_000, "refractory": 45.0, "flank": (150.0, 750.0), "lag": 750}
    out = K.guarded_merge(train, bank, 0.5, 0.95, 3, 1, 0, **ccg)
    assert sorted({r.unit for r in out.collect()}) == [1, 4]


def test_correlations_equal_numpy_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SIDE", 3)
    monkeypatch.setattr(S, "SLAB", 8)
    rng = np.random.default_rng(5)
    x = rng.integers(1, 50, (8, 40)).astype(float) + 1e6
    x[3] = 7.0
    x[4, 5] = np.nan
    held = rng.random(x.shape) < 0.7
    held[6, 2:] = False
    rows = [(int(c) * 10, int(t) - 11, float(x[c, t])) for c, t in zip(*np.nonzero(held), strict=True)] + [(70, 500, None), (None, 1, 1.0), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "c long, t int, v double")
    found = S.pairwise_correlation(df, "c", "t", "v", 3)
    got = {(r.a, r.b): r for r in found.collect()}
    want = {(a * 10, b * 10) for a in range(8) for b in range(a + 1, 8) if (held[a] & held[b]).sum() >= 3}
    assert set(got) == want and len(want) == 21
    for (a, b), r in got.items():
        both = held[a // 10] & held[b // 10]
        y, z = x[a // 10, both], x[b // 10, both]
        assert r.n == both.sum()
        if np.ptp(y) > 0 and np.ptp(z) > 0:  # NaN isn't above zero either
            assert abs(r.r - np.corrcoef(y, z)[0, 1]) < 1e-9
        else:
            assert np.isnan(r.r)


def test_pairs_of_channels_are_not_rows_before_their_result(spark):
    df = spark.createDataFrame([(c, t, float(c * t % 7)) for c in range(20) for t in range(10)], "c long, t int, v double")
    plan = S.pairwise_correlation(df, "c", "t", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "MapInArrow" in plan


def test_triggered_sums_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    a = [(int(g), int(f)) for g, f in zip(rng.integers(0, 2, 80), rng.integers(-60, 200, 80), strict=True)]
    b = [(int(g), int(f), None if i % 9 == 0 else float(v)) for i, (g, f, v) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(-60, 200, 90), rng.normal(size=90), strict=True))]
    want = {}
    for g, f in a:
        for h, at, v in b:
            if g == h and 0 <= at - f < 40:
                want.setdefault((at - f) // 10, []).append(v)
    out = S.triggered_sums(spark.createDataFrame([*a, (None, 3)], "g long, f long"), spark.createDataFrame(b, "g long, f long, v double"), "g", "f", "v", 10, 4)
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    got = {r["lag"]: (r.n, r["mean"]) for r in out.collect()}
    assert {k: len(v) for k, v in want.items()} == {k: v[0] for k, v in got.items()}
    assert all(abs(got[k][1] - np.mean([x for x in v if x is not None])) < 1e-9 for k, v in want.items())


def test_spatial_spectrum_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PLACES", 4)
    v = np.random.default_rng(7).normal(size=23)
    got = S.spatial_spectrum(spark.createDataFrame([(3 * i, float(x)) for i, x in enumerate(v)], "c long, v double"), "c", "v").orderBy("k").collect()
    assert np.allclose([r.power for r in got], np.abs(np.fft.rfft(v - v.mean())) ** 2)

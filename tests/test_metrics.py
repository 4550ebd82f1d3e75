"""Metrics against direct computation, where the registered SQL says less."""

import math

import numpy as np
import pytest

from chronoweave.operators import metrics as Q

SHAPE = "grp long, unit long, frame long, value double"


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(0)
    rows = [(u // 2, u, int(f), float(v)) for u in range(4) for f, v in zip(rng.choice(10_000, 200, replace=False), rng.normal(20 + u, 3, 200), strict=True)]
    return spark.createDataFrame(rows + [(9, 9, 5, 1.0), (9, 8, 5, 1.0), (9, 8, 6, 1.0)], SHAPE)


def test_sliding_violations_need_evidence(spark):
    rng = np.random.default_rng(1)
    clean = np.arange(0, 2_000_000, 200)
    noisy = np.sort(rng.integers(0, 2_000_000, 10_000))
    rows = [(0, 1, int(f), 0.0) for f in clean] + [(0, 2, int(f), 0.0) for f in noisy] + [(0, 3, 7, 0.0)]
    got = {r.unit: r.sliding_rp_violation for r in Q.sliding_violations(spark.createDataFrame(rows, SHAPE), 2_000_000, [20, 50, 100]).collect()}
    # 2.3 expected pairs or more exclude a contamination if none is seen: 2 x 10000 x 100 x c x 0.005 >= 2.31
    assert got[1] == 0.005 and got[2] is None and got[3] is None


def test_poisson_law():
    import pandas as pd

    mean = [0.5, 3.0, 200.0, 5000.0]
    most = [0, 5, 190, 5000]
    got = Q._poisson(pd.Series(most), pd.Series(mean))
    for k, m, p in zip(most[:3], mean[:3], got[:3], strict=True):
        assert abs(p - sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k + 1))) < 1e-9
    assert abs(got[3] - 0.5) < 0.01


def test_cutoffs(spark):
    rng = np.random.default_rng(2)
    whole = rng.normal(50, 5, 20_000)
    rows = [(0, 1, i, float(v)) for i, v in enumerate(whole)] + [(0, 2, i, float(v)) for i, v in enumerate(whole[whole > 48])] + [(0, 3, i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, SHAPE)
    cut = {r.unit: r.amplitude_cutoff for r in Q.amplitude_cutoff(df).collect()}
    assert cut[1] < 0.02 and 0.15 < cut[2] <= 0.5 and 3 not in cut
    noise = {r.unit: r for r in Q.noise_cutoff(df).collect()}
    assert noise[2].noise_cutoff > 5 > abs(noise[1].noise_cutoff) and noise[2].noise_ratio > 0.5


def test_suite_has_a_row_per_unit(train):
    parts = [Q.rates(train, 0, 10_000, 1000, 500), Q.interval_violations(train, 10_000, 20), Q.synchrony(train, 10), Q.amplitudes(train, 0, 1000, 3), Q.drift(train, 0, 1000, 3), Q.amplitude_cutoff(train)]
    got = {r.unit: r for r in Q.suite(parts, train.select("unit").distinct()).collect()}
    assert set(got) == {0, 1, 2, 3, 8, 9}
    assert got[9].amplitude_cutoff is None and got[9].drift_std is None and got[9].num_spikes == 1 and got[8].isi_violations_count == 1
    assert got[8].sync_spike_2 == got[9].sync_spike_2 == 1.0 and got[9].sync_spike_4 == 0.0
    v = np.array([r.value for r in train.where("unit = 2").orderBy("frame").collect()])
    assert abs(got[2].amplitude_median - np.median(v)) < 1e-9
    n = np.array([r.value for r in train.where("grp = 1").collect()])
    assert abs(got[2].snr - abs(np.median(v)) / (np.median(np.abs(n - np.median(n))) / 0.6745)) < 1e-9
    assert Q.rates(train.limit(0), 0, 1, 1, 1).count() == 0


def test_cluster_metrics(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = {1: [0, 0, 0, 0], 2: [8, 0, 0, 0], 3: [8, 1, 0, 0]}
    x = {(u, 100 * u + i): rng.normal(c, 1, 4) for u, c in centre.items() for i in range(60)}
    df = spark.createDataFrame([(0, u, s, v.tolist()) for (u, s), v in x.items()], "grp long, unit long, spike long, features array<double>")
    far, near = (Q.d_prime(df, 4).where(f"unit = {u}").first().d_prime for u in (1, 2))
    assert far > 4 > near > 0
    own, rest = (np.stack([v for (u, _), v in x.items() if (u == 1) == mine]) for mine in (True, False))
    inverse = np.linalg.inv(np.cov(own.T))
    d = np.sort([(v - own.mean(axis=0)) @ inverse @ (v - own.mean(axis=0)) for v in rest])
    got = Q.mahalanobis(df, 4).where("unit = 1").first()
    assert abs(got.isolation_distance - d[59]) < 1e-6 * d[59]
    assert abs(got.l_ratio - (np.exp(-d / 2) * (1 + d / 2)).sum() / 60) < 1e-9
    score = {r.unit: r.silhouette for r in Q.silhouette(df, 4).collect()}
    assert score[1] > 0.6 > score[2]
    want = {r.unit: (r.nn_hit_rate, r.nn_miss_rate) for r in Q.nearest_neighbours(df).collect()}
    assert want[1][0] > 0.99 and want[1][1] < 0.01 and want[2][0] < 0.9
    monkeypatch.setattr(Q, "BLOCK", 16)
    assert {r.unit: (r.nn_hit_rate, r.nn_miss_rate) for r in Q.nearest_neighbours(df).collect()} == want


def test_cutoff_of_a_unit_whose_heights_are_alike_but_for_rounding(spark):
    # unit 1061 of sf0.1: two bins are equally near to the first, so the lower one counts, as in the SQL
    from chronoweave.sources.tables import events

    ev = events(spark, "/root/testdata/sf0.1").where("unit = 1061")
    assert round(Q.amplitude_cutoff(ev).first().amplitude_cutoff, 5) == 0.30518


def test_ties_with_bounds_of_tiers_do_not_depend_on_rounding(spark, tmp_path):
    """Discounts whose mean is 0.049 or 0.05 exactly, while sums of doubles end above or below."""
    from chronoweave.queries import registry

    rng = np.random.default_rng(3)
    rows = []
    for unit in range(1, 41):
        x = rng.integers(0, 11, 620)
        goal = 3100 if unit % 2 else 3038
        while x.sum() != goal:
            i = rng.integers(620)
            x[i] = min(10, max(0, x[i] + np.sign(goal - x.sum())))
        rows += [(unit, float(v) / 100, "R" if i % 100 < 40 else "A") for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.unit: r.tier for r in registry().queries["prj8_tier_mask"](spark, str(tmp_path)).collect()}
    assert got == {u: "none" if u % 11 == 0 else "lenient" if u % 2 else "conservative" for u in range(1, 41)}


def test_blocks_of_neighbours_are_not_put_into_one_task(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 8)
    rows = [(0, i % 3, i, [float(i % 5), float(i % 7)]) for i in range(60)]
    found = Q.nearest_neighbours(spark.createDataFrame(rows, "grp long, unit long, spike long, features array<double>"))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    own = {u: [0, 0] for u in range(3)}
    for _, u, i, x in rows:
        near = sorted((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), j, v) for _, v, j, y in rows if j != i)[:4]
        own[u][0] += sum(v == u for _, _, v in near)
        own[u][1] += 4
    assert {r.unit: r.nn_hit_rate for r in found.collect()} == {u: h / n for u, (h, n) in own.items()}


def test_share_of_ties_does_not_depend_on_the_parts_of_a_sum(spark, tmp_path):
    """The same discounts of mean 0.05 in one file and in many: sums of doubles end on either side of it."""
    from chronoweave.queries import registry

    rng = np.random.default_rng(5)
    rows = []
    for unit in range(1, 6):
        x = np.r_[np.arange(11), 5, rng.integers(0, 11, 600)]
        while x.sum() != 5 * len(x):
            i = rng.integers(len(x))
            x[i] = min(10, max(0, x[i] + np.sign(5 * len(x) - x.sum())))
        rows += [(unit, float(v) / 100, "R" if k < unit else "A") for k in range(20) for v in x.tolist()]
    rows += [(unit, 0.06, "R" if k < 30 else "A") for unit in (12, 13) for k in range(700)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string")
    for files in (1, 8):
        path = str(tmp_path / f"of-{files}")
        table.repartition(files).write.parquet(f"{path}/lineitem.parquet")
        assert [(r.tier, r.n, r.share) for r in registry().queries["ag40_pearson"](spark, path).collect()] == [("strict", 7, round(2 / 7, 6))]


@pytest.mark.parametrize("block, most, held", [(1, 8, 3), (16, 32, 100), (1024, 8192, 1 << 20)])
def test_nearest_neighbours_equal_brute_force_whatever_the_blocks(spark, monkeypatch, block, most, held):
    """Few snippets to a block leave some blocks empty; distances tie, and are held some at a time."""
    rng = np.random.default_rng(2)
    rows = [(g, int(rng.integers(0, 3)), 1000 * g + i, rng.integers(0, 6, 2).astype(float).tolist()) for g, n in ((0, 90), (1, 9)) for i in range(n)]
    hits = {}
    for g, u, s, x in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), t, v) for h, v, t, y in rows if h == g and t != s)[:4]
        hits.setdefault((g, u), []).extend(v == u for _, _, v in near)
    for name, value in (("BLOCK", block), ("MOST", most), ("HELD", held)):
        monkeypatch.setattr(Q, name, value, raising=False)
    found = Q.nearest_neighbours(spark.createDataFrame(rows, "grp long, unit long, spike long, features array<double>")).collect()
    assert {(r.grp, r.unit): round(r.nn_hit_rate, 9) for r in found} == {k: round(float(np.mean(v)), 9) for k, v in hits.items()}

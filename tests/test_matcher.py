"""The compressed matcher, the fold over windows and the sorter against dense loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import carry as C
from chronoweave.operators import matcher as X
from chronoweave.operators import sorting as S
from chronoweave.plans.storage import exists, own_path
from chronoweave.queries import signals

SF = "/root/testdata/sf0.001"
LENGTH, CHANNELS = 20, 4


def made_bank():
    t = np.arange(LENGTH)
    spike = -np.exp(-((t - 7) ** 2) / 6.0) + 0.4 * np.exp(-((t - 12) ** 2) / 10.0)
    bank = np.stack([np.outer(spike, w) for w in ([1, 0.3, 0.1, 0], [0, 1, 0.3, 0.2], [0.2, 0, 1, 0.5])])
    bank[1] += np.outer(0.5 * np.sin(t / 3.0) * np.exp(-((t - 9) ** 2) / 20.0), [0.1, 0.5, 0, 0.2])
    return bank


def dense_pursuit(trace, bank, threshold, variance=1.0, low=0.0, high=math.inf, rest_frames=10):
    """The matcher's definition with whole templates and a score of every place in every round."""
    left, length = trace.copy(), bank.samples
    places, units = len(trace) - length + 1, len(bank.space)
    fit = lambda p, u, s: X.scored(np.array((left[p : p + length] * bank.dense(s, u)).sum()), bank.norm[s, u], variance, low, high)
    resting, out = np.zeros((units, max(0, places)), bool), []
    while True:
        score = np.array([[fit(p, u, 0)[0] for p in range(places)] for u in range(units)], float)
        score[resting] = -np.inf
        best = score.max(axis=0)
        window = lambda p: range(max(0, p - length + 1), min(places, p + length))
        leads = [p for p in range(places) if best[p] >= threshold and all(best[q] < best[p] or (best[q] == best[p] and q >= p) for q in window(p))]
        if not leads:
            return sorted(out)
        then = left.copy()
        for p in leads:
            u = int(score[:, p].argmax())
            fits = [fit(p, u, s) for s in range(len(bank.shifts))]
            s = int(np.argmax([f[0] for f in fits]))
            then[p : p + length] -= float(fits[s][1]) * bank.dense(s, u)
            out.append((p, u, float(bank.shifts[s]), round(float(fits[s][1]), 6)))
            resting[u, max(0, p - rest_frames) : p + rest_frames + 1] = True
        left = then


def planted(rng, bank, frames, events, noise=0.05):
    trace = rng.normal(size=(frames, CHANNELS)) * noise
    for _ in range(events):
        at = rng.integers(0, frames - LENGTH)
        trace[at : at + LENGTH] += rng.uniform(0.6, 1.5) * bank.dense(int(rng.integers(len(bank.shifts))), int(rng.integers(3)))
    return trace


def as_tuples(events):
    return [(int(a), int(u), float(s), round(float(x), 6)) for a, u, s, x in events.itertuples(index=False)]


@pytest.mark.parametrize("variance", [1.0, 0.0, 0.05, math.inf])
def test_compressed_matcher_equals_dense_matcher(variance):
    bank = X.Bank(made_bank())
    trace = planted(np.random.default_rng(1), bank, 220, 12)  # events overlap
    found, rounds = X.pursue(trace, bank, 0.3, amplitude_variance=variance, scale_min=0.5, scale_max=1.3)
    assert as_tuples(found) == dense_pursuit(trace, bank, 0.3, variance, 0.5, 1.3) and len(found) > 5 and rounds > 1
    if variance:
        assert found["scale"].between(0.5, 1.3).all()


def test_all_events_of_a_busy_block_are_found():
    rng, bank = np.random.default_rng(2), made_bank()
    trace = rng.normal(size=(32768, CHANNELS)) * 0.02
    at = np.sort(rng.choice(32768 // 21 - 1, 1500, replace=False)) * 21
    units = rng.integers(0, 3, 1500)
    for a, u in zip(at, units, strict=True):
        trace[a : a + LENGTH] += bank[u]
    found, _ = X.pursue(trace, bank, 0.3 * float(np.median((bank**2).sum(axis=(1, 2)))))
    assert found["at"].tolist() == at.tolist() and found["unit"].tolist() == units.tolist()


def test_events_between_samples_and_of_any_scale():
    bank = X.Bank(made_bank())
    trace = np.zeros((600, CHANNELS))
    want = [(50, 0, 0.25, 0.8), (63, 1, -0.375, 1.2), (300, 2, 0.5, 1.0)]
    for a, u, s, x in want:
        trace[a : a + LENGTH] += x * bank.dense(int(np.flatnonzero(bank.shifts == s)[0]), u)
    found, _ = X.pursue(trace, bank, 0.4, amplitude_variance=100.0)
    got = found.sort_values("at")
    places = [(a + s, u) for a, u, s, _ in as_tuples(got)]
    assert [u for _, u in places] == [0, 1, 2] and all(abs(p - a - s) < 0.13 for (p, _), (a, _, s, _) in zip(places, want, strict=True))
    assert all(abs(x - w[3]) < 0.05 for x, w in zip(got["scale"], want, strict=True))


def test_parameters_act():
    made = made_bank()
    assert X.Bank(made, approx_rank=1).space.shape[1] == 1 and np.abs(X.Bank(made).dense(0, 1) - made[1]).max() < 1e-12
    assert (X.Bank(made, visibility_threshold=0.15).dense(0, 0)[:, 2] == 0).all()
    assert X.Bank(made, jitter_factor=1).shifts.tolist() == [0.0]
    trace = np.zeros((200, CHANNELS))
    trace[50:70] += made[0]
    trace[56:76] += made[0]
    count = lambda **p: len(X.pursue(trace, made, 0.5, **p)[0])
    assert count(refractory_period_frames=3) == 2 and count(refractory_period_frames=10) < 2 + 1 and count(max_iter=1) == 1
    far = trace[:0], trace[:5]
    assert all(len(X.pursue(x, made, 1.0)[0]) == 0 for x in far)
    assert X.matcher_parameters(3.0)["threshold"] == 3.0
    assert X.matcher_parameters(factor=0.5, norms_sq=[1.0, 4.0, 9.0])["threshold"] == 2.0
    assert X.matcher_parameters(1.0, scale_max=2.0) == X.PARAMETERS | {"scale_max": 2.0, "threshold": 1.0}
    with pytest.raises(ValueError, match="factor"):
        X.matcher_parameters()
    with pytest.raises(ValueError, match="no parameters"):
        X.matcher_parameters(1.0, most=5)
    with pytest.raises(ValueError, match="above 0"):
        X.pursue(trace, made, 0.0)


def long_trace(spark, *traces):
    parts = [pd.DataFrame({"grp": g, "channel": np.tile(np.arange(x.shape[1]), len(x)), "frame": np.repeat(np.arange(len(x)), x.shape[1]), "value": x.ravel()}) for g, x in enumerate(traces)]
    return spark.createDataFrame(pd.concat(parts), "grp long, channel long, frame long, value double")


def bank_table(spark, *banks):
    return spark.createDataFrame([(g, 10 * g + u, w.ravel().tolist()) for g, bank in enumerate(banks) for u, w in enumerate(bank)], "grp long, unit long, wf array<double>")


@pytest.mark.parametrize("block", [400, 1 << 15])
def test_blocks_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(X, "ROUNDS", 2)  # the first halo is too narrow for what overlaps this much
    made = made_bank()
    bank = X.Bank(made)
    rng = np.random.default_rng(3)
    traces = planted(rng, bank, 1500, 230, 0.03), planted(rng, bank, 700, 20, 0.03)
    out = X.match_recording(long_trace(spark, *traces), bank_table(spark, made, made[:2]), 0.4, samples=LENGTH, block=block).collect()
    for g, units in ((0, made), (1, made[:2])):
        want, rounds = X.pursue(traces[g], units, 0.4)
        got = sorted((r.frame, r.unit - 10 * g, r.shift, round(r.scale, 6)) for r in out if r.grp == g)
        assert got == as_tuples(want) and (g == 1 or rounds > 2)


def test_gate_and_group_thresholds(spark):
    made = made_bank()
    trace = np.zeros((300, CHANNELS))
    trace[40:60] += made[0]
    trace[140:160] += 0.5 * made[1]
    trace[220:240] += made[0] * np.linspace(1.6, 0.2, LENGTH)[:, None] + 0.5
    run = lambda **p: X.match_recording(long_trace(spark, trace), made, samples=LENGTH, amplitude_variance=math.inf, **p)
    found = {r.frame: r for r in run(factor=0.1).collect()}
    assert found[40].r == pytest.approx(1.0) and found[140].r == pytest.approx(1.0) and found[140].scale == pytest.approx(0.5)
    gated = {r.frame for r in run(factor=0.1, gate=0.99).collect()}
    assert gated == {40, 140}
    with pytest.raises(ValueError, match="factor"):
        run()
    with pytest.raises(ValueError, match="samples"):
        X.match_recording(long_trace(spark, trace), bank_table(spark, made), 1.0)


def plain_fold(traces, banks, window, threshold, gate, least, cap, shifts, **given):
    """Windows in order with dense loops: {(grp, win, frame, unit)}, and the banks at the end."""
    out, banks = set(), {g: {u: w.copy() for u, w in bank.items()} for g, bank in banks.items()}
    first, last = min(min(t) for t in traces.values()), max(max(t) for t in traces.values())
    for win in range((last - first) // window + 1):
        for g, rows in traces.items():
            frames = [f for f in sorted(rows) if first + win * window <= f < first + (win + 1) * window]
            if not frames:
                continue
            x = np.array([rows[f] for f in frames])
            units = sorted(banks[g])
            bank = X.Bank(np.stack([banks[g][u] for u in units]), jitter_factor=1)
            whole = np.nan_to_num(x)
            seen = {}
            for p, u, _, _ in dense_pursuit(whole, bank, threshold, **given):
                t, y = bank.dense(0, u), whole[p : p + bank.samples]
                if (t * y).sum() / math.sqrt((t**2).sum() * (y**2).sum()) >= gate:
                    seen.setdefault(units[u], []).append(p)
                    out.add((g, win, frames[0] + p, units[u]))
            for u, at in seen.items():
                if len(at) >= least:
                    mean = np.nanmean([x[p : p + bank.samples] for p in at], axis=0)
                    if C._likeness(mean, banks[g][u], shifts) >= cap:
                        banks[g][u] = mean
    return out, banks


def test_fold_equals_plain_loops_on_the_given_events(spark):
    rows = signals.trace(spark, SF).toPandas()
    traces = {g: {f: p.set_index("channel").value.reindex(range(4 * g, 4 * g + 4)).to_numpy() for f, p in part.groupby("frame")} for g, part in rows.groupby("grp")}
    bump = 100 * np.exp(-((np.arange(signals.LENGTH) - 3.0) ** 2) / 2)
    units = {c: np.outer(bump, np.eye(4)[c]) for c in range(4)}
    want, banks = plain_fold(traces, {g: units for g in traces}, 75, 5000.0, 0.3, 3, 0.5, 1, variance=math.inf, rest_frames=4)
    free = {"amplitude_variance": math.inf, "jitter_factor": 1, "refractory_period_frames": 4}
    fold = C.carry_forward(signals.trace(spark, SF), signals.bumps(spark, SF), 75, signals.LENGTH, 4, threshold=5000.0, gate=0.3, least=3, cap=0.5, shifts=1, block=30, **free)
    assert {(r.grp, r.win, r.frame, r.unit) for r in fold.events.collect()} == want and len(want) > 10
    changed = 0
    for r in fold.bank.collect():
        assert np.allclose(r.wf, banks[r.grp][r.unit].ravel())
        changed += not np.allclose(r.wf, units[r.unit].ravel())
    assert changed
    counts = {(r.grp, r.win, r.unit): r.n for r in C.window_counts(fold.events).collect()}
    assert sum(counts.values()) == len(want)


def drifting(rng, windows=6, window=1200):
    """A unit that drifts, one that jumps, and one that the bank doesn't know."""
    made = made_bank()
    trace = rng.normal(size=(windows * window, CHANNELS)) * 0.03
    for w in range(windows):
        turn = 0.12 * w
        now = math.cos(turn) * made[0] + math.sin(turn) * np.roll(made[0], 1, axis=1)
        for n, at in enumerate(range(w * window + 20, (w + 1) * window - 60, 100)):
            trace[at : at + LENGTH] += now
            trace[at + 45 : at + 45 + LENGTH] += made[2] * (1 if n % 2 else 0.9)
    return made, trace


def test_fold_follows_drift_and_founds_units(spark):
    made, trace = drifting(np.random.default_rng(5))
    table, bank = long_trace(spark, trace), bank_table(spark, made[:1])
    sorter = lambda part: S.sort_trace(part, 6.0, 10, 7, 13, CHANNELS, whiten=False).withColumn("frame", F.col("frame") - 7)
    given = {"factor": 0.3, "gate": 0.8, "least": 8, "shifts": 3, "block": 500}
    still = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, **(given | {"least": 999}))
    moving = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, **given)
    last = lambda fold: fold.events.where("win = 5").count()
    assert last(moving) == 12 and moving.events.count() == 72
    assert np.corrcoef(still.bank.first().wf, made[0].ravel())[0, 1] > 0.999999
    capped = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, cap=0.9999, **given)
    assert np.allclose(capped.bank.first().wf, made[0].ravel())
    founded = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, every=2, sorter=sorter, born=(8, 3.0), new_below=0.8, **given)
    births = founded.births.collect()
    assert [(r.win, r.unit) for r in births] == [(1, -1)] and births[0].likeness < 0.8
    seen = {(r.win, r.unit): r.n for r in C.window_counts(founded.events).collect()}
    assert all((w, -1) not in seen for w in (0, 1)) and all(seen[w, -1] >= 10 for w in (2, 3, 4, 5))
    with pytest.raises(ValueError, match="sorter"):
        C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, every=1, **given)


def test_a_killed_fold_goes_on(spark, monkeypatch):
    made, trace = drifting(np.random.default_rng(6), 3)
    table, bank = long_trace(spark, trace), bank_table(spark, made[:1])
    given = {"factor": 0.3, "gate": 0.8, "least": 8, "block": 600}
    whole = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, **given)
    store, real, calls = own_path(spark, "fold"), C.match_recording, []

    def dies(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*args, **kwargs)

    monkeypatch.setattr(C, "match_recording", dies)
    with pytest.raises(RuntimeError, match="killed"):
        C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, store=store, **given)
    assert exists(spark, f"{store}/window-000001/bank/_SUCCESS") and not exists(spark, f"{store}/window-000002/bank")
    again = C.carry_forward(table, bank, 1200, LENGTH, CHANNELS, store=store, **given)
    assert len(calls) == 4  # only the window that was lost
    rows = lambda fold: sorted((r.grp, r.win, r.frame, r.unit, round(r.scale, 9)) for r in fold.events.collect())
    assert rows(again) == rows(whole)
    empty = C.carry_forward(table.limit(0), bank, 1200, LENGTH, CHANNELS, **given)
    assert empty.events.count() == empty.births.count() == 0 and empty.bank.count() == 1


def clouds(rng, sizes, far=6.0):
    while True:
        middle = rng.normal(size=(len(sizes), 6))
        middle *= 8 / np.linalg.norm(middle, axis=1, keepdims=True)
        gap = np.linalg.norm(middle[:, None] - middle[None], axis=2) + 99 * np.eye(len(sizes))
        if gap.min() > far:
            break
    x = np.concatenate([m + rng.normal(size=(n, 6)) for m, n in zip(middle, sizes, strict=True)])
    return x, np.repeat(np.arange(len(sizes)), sizes)


@pytest.mark.parametrize("sizes", [[1500], [1200, 90], [1000, 500, 300, 150, 60], [800, 700, 500, 400, 300, 200, 100, 80, 60]])
def test_the_number_of_clusters_is_found(sizes):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x, truth = clouds(rng, sizes)
        order = rng.permutation(len(x))
        label = S.split_clusters(x[order])
        pairs = pd.crosstab(label, truth[order]).to_numpy()
        assert len(pairs) == len(sizes) and pairs.max(axis=1).sum() >= 0.98 * len(x)


def test_peaks_of_projections():
    rng = np.random.default_rng(0)
    assert max(S.two_peaks(rng.normal(size=n))[0] for n in (60, 300, 2000) for _ in range(100)) < S.DIP
    assert max(S.two_peaks(rng.exponential(size=1000))[0] for _ in range(50)) < S.DIP
    gap, valley = S.two_peaks(np.concatenate((rng.normal(size=500), 6 + rng.normal(size=300))))
    assert gap > 2 * S.DIP and 2 < valley < 4.5
    assert S._rising(np.array([3.0, 1.0, 2.0, 5.0, 4.0])).tolist() == [2.0, 2.0, 2.0, 4.5, 4.5]
    assert S.split_clusters(np.zeros((30, 2))).tolist() == [0] * 30 and S.split_clusters(np.zeros((1, 3))).tolist() == [0]


def test_clusters_are_found_on_a_sample_and_given_to_all(spark):
    rng = np.random.default_rng(8)
    x, truth = clouds(rng, [900, 400, 200])
    y, other = clouds(rng, [300, 100])
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, 5000 + i, v.tolist()) for i, v in enumerate(y)]
    table = spark.createDataFrame(rows, "grp long, spike long, wf array<double>")
    got = S.cluster(table, train=500).toPandas().sort_values("spike")
    assert len(got) == len(rows)
    for g, want in ((0, truth), (1, other)):
        pairs = pd.crosstab(got[got.grp == g].cluster.to_numpy(), want).to_numpy()
        assert len(pairs) == want.max() + 1 and pairs.max(axis=1).sum() >= 0.98 * len(want)
    again = S.cluster(table.repartition(7), train=500).toPandas().sort_values("spike")
    assert again.cluster.tolist() == got.cluster.tolist()


def test_whitened_channels_are_uncorrelated(spark):
    rng = np.random.default_rng(9)
    mixed = rng.normal(size=(4000, 3)) @ np.array([[2.0, 0.5, 0.0], [0.0, 1.0, 0.7], [0.0, 0.0, 0.3]])
    table = long_trace(spark, mixed, 5 * mixed[:2000])
    matrix = S.whitening(S.covariance(table, block=64, one_in=4))
    cov = {(r.grp, r.i, r.j): r.cov for r in S.covariance(S.whitened(table, matrix)).collect()}
    assert len(cov) == 18 and all(abs(v - (i == j)) < 0.3 for (_, i, j), v in cov.items())
    exact = {(r.grp, r.i, r.j): r.cov for r in S.covariance(S.whitened(table, S.whitening(S.covariance(table)))).collect()}
    assert all(abs(v - (i == j)) < 1e-9 for (_, i, j), v in exact.items())
    w = lambda df: sorted((r.grp, r.i, r.j, round(r.w, 9)) for r in df.collect())
    assert w(matrix) == w(S.whitening(S.covariance(table.repartition(5), block=64, one_in=4)))


def test_sorter_finds_planted_units(spark):
    made, trace = drifting(np.random.default_rng(7), 1, 4000)
    out = S.sort_trace(long_trace(spark, trace), 6.0, 10, 7, 13, CHANNELS, block=700).toPandas()
    first = out[(out.frame - 27) % 100 < 3]
    assert out.unit.nunique() == 2 and len(out) >= 75 and first.unit.nunique() == 1

import collections
import random

import numpy as np
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from chronoweave.operators import quality as Q
from chronoweave.operators import trains as T
from chronoweave.operators.graph import connected_components


def events(spark, rows):
    return spark.createDataFrame(rows, "grp long, unit long, frame long")


def test_isi_violation_needs_two_events(spark):
    out = {r.unit: r for r in T.isi_violation(events(spark, [(0, 1, 10), (0, 1, 12), (0, 1, 40), (0, 2, 5)]), 5).collect()}
    assert (out[1].n_events, out[1].n_violations, out[1].violation_rate) == (3, 1, 0.5)
    assert (out[2].n_events, out[2].n_violations, out[2].violation_rate) == (1, 0, None)


def test_within_tol_is_inclusive_and_keeps_groups_apart(spark):
    q = events(spark, [(0, 1, 100), (0, 1, 206), (1, 1, 100), (2, 1, 7)])
    r = events(spark, [(0, 9, 105), (0, 9, 200), (1, 9, 106)])
    assert {(x.grp, x.frame): x.hit for x in T.within_tol(q, r, 5).collect()} == {(0, 100): True, (0, 206): False, (1, 100): False, (2, 7): False}


def test_within_tol_equals_brute_force(spark):
    rng = random.Random(3)
    q = [(rng.randrange(3), 0, rng.randrange(300)) for _ in range(120)]
    r = [(rng.randrange(3), 1, rng.randrange(300)) for _ in range(40)]
    want = sorted((g, f, any(a == g and abs(b - f) <= 4 for a, _, b in r)) for g, _, f in q)
    assert sorted((x.grp, x.frame, x.hit) for x in T.within_tol(events(spark, q), events(spark, r), 4).collect()) == want


def test_collapse_chains_over_dropped_events_and_is_idempotent(spark):
    rows = [(0, 0, f) for f in (0, 4, 8, 12, 30, 33)]
    once = T.collapse(events(spark, rows).select("grp", "frame"), 5, ["grp"])
    assert sorted(x.frame for x in once.collect()) == [0, 30]
    assert sorted(x.frame for x in T.collapse(once, 5, ["grp"]).collect()) == [0, 30]


def test_band_is_open_at_the_top(spark):
    a, b = events(spark, [(0, 1, 100)]), events(spark, [(0, 2, 90), (0, 2, 109), (0, 2, 110)])
    assert sorted(x.frame_b for x in T.band_pairs(a, b, 10).collect()) == [90, 109]


def test_ccg_dip_and_verdict(spark):
    a = [500 + 200 * i + 10_000 * w for i in range(40) for w in range(3)]
    rows = [(0, 1, f) for f in a] + [(0, 2, f + 300) for f in a]
    v = T.ccg_verdicts(events(spark, rows), 10_000, 45.0, (150.0, 750.0), 750).first()
    assert (v.central, v.verdict, v.n_co) == (0, "duplicate", 3) and v.flank > 30


@pytest.mark.parametrize(("ratio", "n", "want"), [(0.1, 5, "duplicate"), (1.0, 5, "distinct"), (0.5, 5, "ambiguous"), (0.1, 1, "SEGREGATED"), (None, 5, "SEGREGATED")])
def test_verdicts(spark, ratio, n, want):
    df = spark.createDataFrame([(ratio, n)], "r double, n int")
    assert df.select(T.verdict(df.r, df.n)).first()[0] == want


@settings(max_examples=12, deadline=None)
@given(n=st.integers(1, 5000), chunk=st.integers(2, 700), overlap=st.sampled_from([0.0, 0.25, 0.5, 0.75]))
def test_chunks_own_each_frame_once(spark, n, chunk, overlap):
    assume(round(chunk * (1 - overlap)) >= 1)  # less is rejected, see below
    rows = sorted(T.ownership(T.plan_chunks(spark, n, chunk, overlap)).collect())
    assert rows[0].lo == 0 and rows[-1].hi == n
    assert all(a.hi == b.lo for a, b in zip(rows, rows[1:], strict=False))


def test_collapse_in_buckets_equals_one_pass(spark):
    rng = random.Random(3)
    rows = sorted((g, rng.randrange(40_000)) for g in (0, 0, 1) for _ in range(1500)) + [(0, 256 * 11 * k) for k in range(10)] + [(2, -5), (2, -1), (2, 9)]
    df = spark.createDataFrame(rows, "unit long, frame long").repartition(3)
    want, last = [], {}
    for g, f in sorted(rows):
        if g not in last or f - last[g] > 10:
            want.append((g, f))
        last[g] = f
    assert sorted(tuple(r) for r in T.collapse(df, 10).collect()) == want


def test_nearest_within_equals_loops(spark):
    rng = random.Random(4)
    query = [(g, f) for g in (0, 1) for f in rng.sample(range(60_000), 120)]
    ref = [(g, u, f) for g in (0, 1) for u in (1, 2, 3) for f in rng.sample(range(60_000), 100)] + [(0, 9, query[0][1]), (0, 4, query[0][1]), (1, 5, query[130][1] - 7), (1, 4, query[130][1] + 7)]
    got = {(r.grp, r.frame): (r.gap, r.at, r.near_unit) for r in T.nearest_within(spark.createDataFrame(query, "grp long, frame long"), spark.createDataFrame(ref, "grp long, unit long, frame long"), 20, "unit").collect()}
    for g, f in query:
        near = [(abs(x - f), x, u) for k, u, x in ref if k == g and abs(x - f) <= 20]
        assert got[g, f] == (min(near) if near else (None, None, None))


def test_running_sums_over_a_whole_table(spark):
    from chronoweave.plans.order import numbered

    df = spark.createDataFrame([(i * 37 % 1009, "x") for i in range(1009)], "a long, b string").repartition(5)
    out = numbered(df, ["a"], "at").collect()
    assert sorted((r.a, r["at"]) for r in out) == [(i, i) for i in range(1009)]
    assert numbered(df.limit(0), ["a"], "at").count() == 0


def test_plan_chunks_rejects_full_overlap(spark):
    with pytest.raises(ValueError, match="overlap"):
        T.plan_chunks(spark, 10, 5, 1.0)


def test_coverage_labels(spark):
    peaks = spark.createDataFrame([(0, 10, 6.0), (0, 50, 30.0)], "grp long, frame long, value double")
    out = {r.band: r.pct for r in T.coverage_by_band(peaks, events(spark, [(0, 1, 12)]), 5, [5.5, 7, 24]).collect()}
    assert out == {"5.5-7": 100.0, ">24": 0.0, "overall": 50.0}


def test_components_do_not_depend_on_edge_order(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    for order in (edges, edges[::-1]):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(order, "a long, b long")).collect()}
        assert all(find(x) == c for x, c in got.items())
        assert {x for e in edges if e[0] is not None and e[0] != e[1] for x in e} == set(got)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_votes(spark):
    cosine = spark.createDataFrame([(1, 0.5, 2), (3, 0.95, -1), (4, 0.5, 5), (6, 0.5, 7)], "unit long, best_match_frac double, top_neighbor long")
    pairs = spark.createDataFrame([(2, 1, "distinct"), (4, 5, "duplicate"), (6, 7, "duplicate")], "a long, b long, verdict string")
    held = spark.createDataFrame([(1, 0.5), (3, 0.95), (4, 0.95), (6, 0.5)], "unit long, self_frac double")
    out = {r.unit: (r.flagged, r.category) for r in Q.purity_votes(cosine, pairs, held).collect()}
    assert out == {1: (True, "cross_contaminated"), 3: (False, "clean"), 4: (False, "clean"), 6: (True, "oversplit")}


def test_nan_fails_every_gate(spark):
    df = spark.createDataFrame([(float("nan"), float("nan"), 9.0), (0.01, None, 0.7), (0.01, None, float("nan"))], "v double, c double, f double")
    assert [r[0] for r in df.select(Q.tier(df.v, df.c, df.f)).collect()] == ["none", "strict", "none"]


def test_hungarian_beats_greedy():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 5), (5, 3), (1, 4)):
        cost = rng.random(shape)
        got = sum(cost[i, j] for i, j in Q.hungarian(cost))
        small = cost if shape[0] <= shape[1] else cost.T
        want = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert abs(got - want) < 1e-9


def test_scoreboard_text():
    rows = [{"label": "a", "axis_a": {"overall": 99.5}, "axis_b": {"w": 0.91}}, {"label": "b"}]
    text = Q.scoreboard_text(rows, [("cover", ("axis_a", "overall")), ("purity", ("axis_b", "w"))])
    assert len(text.splitlines()) == 3 and "99.5" in text and "0.910" in text and "-" in text.splitlines()[2]


@pytest.mark.parametrize("swept", [1 << 20, 50])
def test_swept_counts_equal_all_pairs(spark, monkeypatch, swept):
    monkeypatch.setattr(T, "SWEPT", swept)
    rng = np.random.default_rng(3)
    rows = [(int(g), int(u), int(f)) for g, u, f in zip(rng.integers(0, 2, 900), rng.integers(0, 7, 900), rng.integers(0, 4000, 900), strict=True)]
    rows += [(0, 1, 100), (0, 2, 200), (0, 2, 300), (0, 1, 400), (0, 1, 1000), (0, 2, 1000), (0, 2, 1000)]
    train = spark.createDataFrame(rows, "grp long, unit long, frame long").repartition(3)
    lag, window, refractory, flank, least = 100, 250, 5.0, (20.0, 100.0), 4
    got = {(r.grp, r.unit_a, r.unit_b): (r.n_co, r.central, r.flank) for r in T.ccg_verdicts(train, window, refractory, flank, lag, least, 3).collect()}
    n = collections.Counter((g, u, f // window) for g, u, f in rows)
    for (g, a, b), found in got.items():
        both = {w for (h, u, w), k in n.items() if (h, u) == (g, a) and k >= least and n[g, b, w] >= least}
        d = [abs(x - y) for h, u, x in rows if (h, u) == (g, a) and x // window in both for k, v, y in rows if (k, v) == (g, b) and y // window in both and -lag <= x - y < lag]
        assert found == (len(both), sum(v <= refractory for v in d), sum(flank[0] <= v <= flank[1] for v in d))
    assert len(got) == 42 and sum(f[2] for f in got.values()) > 500


@pytest.mark.parametrize(("worth", "span"), [(0, 64), (1 << 30, 64), (64, 2)])
def test_blocks_of_correlograms_equal_all_pairs(spark, monkeypatch, worth, span):
    # a unit of a third of all events, bins wider than a frame, several blocks and spans; pairs asked for are those of all
    for name, value in (("WORTH", worth), ("SPAN", span), ("UNITS", 4), ("STRIP", 50), ("SWEPT", 300), ("BINS", 40)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(g), int(u), int(f)) for g, u, f in zip(rng.integers(0, 2, 1500), rng.choice(9, 1500, p=[1 / 3] + [1 / 12] * 8), rng.integers(-2000, 4000, 1500), strict=True)]
    rows += [(0, 1, 100), (0, 2, 600), (0, 2, -400), (0, 20, 5), (0, 21, 3000)]
    train = spark.createDataFrame(rows, "grp long, unit long, frame long").repartition(3)
    lag, window, refractory, flank, least = 500, 1250, 41.0, (120.0, 500.0), 4
    found = T.ccg_counts(train, window, refractory, flank, lag, least)
    got = {(r.grp, r.unit_a, r.unit_b): (r.n_co, r.central, r.flank) for r in found.collect()}
    n = collections.Counter((g, u, f // window) for g, u, f in rows)
    units = sorted({(g, u) for g, u, _ in rows})
    want = {}
    for g, a in units:
        for h, b in units:
            if g == h and a < b:
                both = {w for (k, u, w), m in n.items() if (k, u) == (g, a) and m >= least and n[g, b, w] >= least}
                d = [abs(x - y) for k, u, x in rows if (k, u) == (g, a) and x // window in both for m, v, y in rows if (m, v) == (g, b) and y // window in both and -lag <= x - y < lag]
                want[g, a, b] = (len(both), sum(v <= refractory for v in d), sum(flank[0] <= v <= flank[1] for v in d))
    assert got == want
    asked = spark.createDataFrame([(0, 3, 1), (0, 2, 5), (1, 0, 8), (0, 20, 21), (0, 1, 99)], "grp long, unit_a long, unit_b long")
    some = {(r.grp, r.unit_a, r.unit_b): (r.n_co, r.central, r.flank) for r in T.ccg_counts(train, window, refractory, flank, lag, least, asked).collect()}
    assert some == {k: want[k] for k in [(0, 1, 3), (0, 2, 5), (1, 0, 8), (0, 20, 21)]}


@pytest.mark.parametrize(("near", "few"), [(1 << 20, 0), (5, 0), (5, 1 << 20)])
def test_agreement_in_blocks_equals_plain_matching(spark, monkeypatch, near, few):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "UNITS", 3)
    monkeypatch.setattr(Q, "NEAR", near)
    rng = np.random.default_rng(8)
    sides = [[(int(g), int(u), int(f)) for g, u, f in zip(rng.integers(0, 2, 500), rng.integers(0, 8, 500), rng.integers(-300, 900, 500), strict=True)] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, "grp long, unit long, frame long") for rows in sides)
    got = {(r.grp, r.unit_a, r.unit_b): (r.n_match, round(r.jaccard, 9)) for r in Q.agreement(a, b, 9).collect()}
    trains = [collections.defaultdict(set) for _ in range(2)]
    for rows, train in zip(sides, trains, strict=True):
        for g, u, f in rows:
            train[g, u].add(f)
    want = {}
    for (g, u), x in trains[0].items():
        for (h, v), y in trains[1].items():
            free, n = sorted(y), 0
            for f in sorted(x) if g == h else ():
                while free and free[0] < f - 9:
                    free.pop(0)
                if free and free[0] <= f + 9:
                    free.pop(0)
                    n += 1
            if n:
                want[g, u, v] = (n, round(n / (len(x) + len(y) - n), 9))
    assert got == want


def test_units_are_matched_by_components(spark):
    # 3000 units of one group, and two where the best pair alone isn't the best total: no task has a matrix of the group
    rows = [(0, i, i, 0.9) for i in range(2, 3000)] + [(0, 0, 0, 0.8), (0, 0, 1, 0.7), (0, 1, 0, 0.75), (0, 5, 6, 0.3)]
    scores = spark.createDataFrame(rows, "grp long, unit_a long, unit_b long, jaccard double")
    got = {r.unit_a: (r.unit_b, r.reciprocal) for r in Q.matched_units(scores, 0.5).collect()}
    assert got == {i: (i, True) for i in range(2, 3000)} | {0: (1, False), 1: (0, False)}


def test_pairs_are_counted_however_many_units_there_are(spark, tmp_path):
    """408 units, some of them active: the numbers of duplicate and distinct pairs are those of the SQL."""
    import duckdb

    from chronoweave.queries import registry

    rng = np.random.default_rng(11)
    frames = lambda n: rng.integers(0, 10 * 86400, n)
    first = frames(60)
    rows = [(u, int(f)) for u in range(408) for f in (frames(60) if u < 24 else frames(2))]
    rows += [(u, int(f)) for u in (408, 416) for f in first + (u - 408) * 100]
    made = spark.createDataFrame(rows, "user_id long, second long")
    made = made.selectExpr("user_id", "timestamp_seconds(1704067200 + second) AS ts", "'view' AS event_type", "1.0D AS value", "user_id AS event_id")
    made.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    got = tuple(registry().queries["ag30_axis_c"](spark, str(tmp_path)).first())
    assert got[0] == 410 and None not in got[3:] and got[4] > 0
    assert got == con.execute(registry().sql["ag30_axis_c"]).fetchone()


@pytest.mark.parametrize("days", [6, 400])
def test_tally_equals_counted_pairs(spark, days):
    """Pairs counted within tasks (one span) and over spans, against the pairs themselves; busy units need more than one product."""
    rng = np.random.default_rng(days)
    rows = [(u % 2, u, int(f)) for u in range(30) for f in rng.integers(0, days * 24, 300 if u < 20 else 3)]
    ev, lags = events(spark, rows), (5 * 24, 2.0, (6.0, 24.0), 24)
    v = T.ccg_verdicts(ev, *lags).collect()
    want = collections.Counter((r.verdict, (r.unit_a * 7 + r.unit_b * 13) % 20) for r in v)
    assert len(v) == 2 * 105 and len({r.verdict for r in v}) > 1
    assert {(r.verdict, r.mix): r.n for r in T.ccg_tally(ev, *lags, mix=(7, 13, 20)).collect()} == want
    frames = collections.defaultdict(list)
    for _, u, f in rows:
        frames[u].append(f)
    a, b = (np.array(frames[u]) for u in (0, 2))
    if days == 6:  # windows are 0-119 and 120-143, both units active in both
        d = np.abs(a[:, None] - b[None, :])
        got = next(r for r in v if (r.unit_a, r.unit_b) == (0, 2))
        late = (b[None, :] - a[:, None] == 24).sum()
        assert (got.central, got.flank) == ((d <= 2).sum(), ((d >= 6) & (d < 24)).sum() + late)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import arrays as A
from chronoweave.operators import templates as T

SAMPLES, CHANNELS = 90, 4


def shape(peak, shift=0):
    t = np.arange(SAMPLES) - 30 - shift
    base = -100 * np.exp(-(t**2) / 8) + 40 * np.exp(-((t - 6) ** 2) / 20)
    out = np.zeros((SAMPLES, CHANNELS))
    out[:, peak] = base
    out[:, (peak + 1) % CHANNELS] = 0.3 * base
    return out.ravel().tolist()


def shifted(spark, a, b, most=10):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(A.max_shift_cosine(F.col("a"), F.col("b"), SAMPLES, CHANNELS, most)).first()[0]


def test_shifted_copy_is_not_new(spark):
    assert shifted(spark, shape(0), shape(0)) == pytest.approx(1.0)
    assert shifted(spark, shape(0, 4), shape(0)) > 0.99
    assert shifted(spark, shape(1), shape(3)) < 0.8
    noisy = (np.array(shape(0)) + np.random.default_rng(0).normal(0, 6, SAMPLES * CHANNELS)).tolist()
    assert 0.5 < shifted(spark, noisy, shape(0)) < 0.999


def test_zero_template_has_no_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(A.cosine(F.col("a"), F.col("b"))).first()[0] is None
    assert shifted(spark, [0.0] * SAMPLES * CHANNELS, shape(0)) == -1.0


def test_mask_and_back(spark):
    df = spark.createDataFrame([([float(i) for i in range(8)],)], "a array<double>")
    packed = A.masked(F.col("a"), 4, [1, 3])
    assert df.select(packed).first()[0] == [1.0, 3.0, 5.0, 7.0]
    assert df.select(A.unmasked(packed, 2, 4, [1, 3])).first()[0] == [0.0, 1.0, 0.0, 3.0, 0.0, 5.0, 0.0, 7.0]


@pytest.fixture
def bank(spark):
    return spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 2, [1.0, 1.0])], "grp long, unit long, wf array<double>")


def test_best_match_reassign_and_fit(spark, bank):
    rows = [(0, 10, 0, [2.0, 0.1]), (0, 11, 0, [0.1, 0.5]), (0, 12, 1, [0.0, 0.0]), (7, 13, 5, [1.0, 0.0])]
    s = spark.createDataFrame(rows, "grp long, spike long, assigned long, wf array<double>")
    m = {r.spike: r for r in T.reassigned(T.best_match(s, bank, ["spike"]), 0.0).collect()}
    assert (m[10].arg, m[10].label, m[10].moved) == (0, 0, False)
    assert (m[11].arg, m[11].label, m[11].moved) == (1, 1, True)
    assert (m[12].arg, m[12].r_best, m[12].label) == (None, None, 1)
    assert (m[13].arg, m[13].label) == (None, 5)
    assert not any(r.moved for r in T.reassigned(T.best_match(s, bank, ["spike"]), 1.5).collect())
    f = {r.spike: r for r in T.fit(s, bank).collect()}
    assert f[11].r == pytest.approx(0.1 / math.sqrt(0.26)) and f[10].a == pytest.approx(2.0) and f[12].r is None


def test_purity_of_counts(spark):
    rows = [(0, 0)] * 7 + [(0, 1)] * 3 + [(0, None)] + [(1, 1)] * 4
    m = spark.createDataFrame(rows, "assigned long, arg long")
    got = {r.unit: r for r in T.purity(T.match_counts(m, [])).collect()}
    assert (got[0].n, got[0].n_finite, got[0].best_match_frac, got[0].neighbor_win_frac, got[0].top_neighbor, got[0].top_neighbor_frac) == (11, 10, 0.7, 0.3, 1, 0.3)
    assert (got[1].n, got[1].best_match_frac, got[1].top_neighbor, got[1].top_neighbor_frac) == (4, 1.0, -1, 0.0)


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    # every template has copies, so most of the nearest are ties; ranks exclude some; a zero template is like nothing
    monkeypatch.setattr(T, "BLOCK", 7)
    rng = np.random.default_rng(4)
    shapes = rng.normal(0, 1, (12, 8))
    shapes[3] = 0
    rows = [(i % 2, i, i % 5, [float(x) for x in shapes[rng.integers(0, 12)]]) for i in range(60)]
    df = spark.createDataFrame(rows, "grp int, unit long, rank long, wf array<double>")
    for shifts, least in ((0, None), (1, -1.0)):
        found = T.nearest(df.where("unit % 3 <> 0").select("grp", "unit", "wf", F.col("rank").alias("upto")), df, "unit", 2, shifts, 2, least=least)
        got = sorted((r.unit, r.place, r.cand, round(r.cos, 9)) for r in found.collect())
        want = []
        for g, u, k, x in rows:
            if u % 3 == 0:
                continue
            met = []
            for h, v, m, y in rows:
                if g == h and m < k:
                    parts = [(x[max(0, s) * 2 : 8 - max(0, -s) * 2], y[max(0, -s) * 2 : 8 - max(0, s) * 2]) for s in range(-shifts, shifts + 1)]
                    cos = [sum(a * b for a, b in zip(*p, strict=True)) / (sum(a * a for a in p[0]) * sum(b * b for b in p[1])) ** 0.5 for p in parts if any(p[0]) and any(p[1])]
                    if cos or least is not None:
                        met.append((-round(max([*cos, *([least] if least is not None else [])]), 9), v))
            want += [(u, i, v, -c) for i, (c, v) in enumerate(sorted(met)[:2], 1)]
        assert got == sorted(want)


def test_pairs_of_blocks_of_one_group_are_dealt_to_many_tasks(spark, monkeypatch):
    # sizes too many to be sent along: the join with them has the whole group in one task, the blocks' products must not
    monkeypatch.setattr(T, "BLOCK", 20)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(0, i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(200)], "grp long, unit long, wf array<double>").repartition(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (0, T.GROUPS_SENT):
            monkeypatch.setattr(T, "GROUPS_SENT", sent)
            asked, bank = df.where("unit % 2 = 1"), df.where("unit % 2 = 0")
            ways = (
                T.similar_pairs(df, -2.0).select("a"), T.cross_cosines(asked, bank).select("a"), T.nearest(asked, bank, "unit", most=3).select("unit"),
            )
            assert [w.count() for w in ways] == [200 * 199 // 2, 100 * 100, 300]
            found = [w.withColumn("_task", F.spark_partition_id()) for w in (T.similar_pairs(df, -2.0), T.cross_cosines(asked, bank))]
            assert all(w.select("_task").distinct().count() > 8 for w in found)
            plan = T.nearest(asked, bank, "unit", most=3)._jdf.queryExecution().toString()
            assert "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_snippet_meets_the_template_of_its_rank_by_a_key(spark):
    from pathlib import Path

    from chronoweave.queries.templates import _snippets

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("needs the driver's tables")
    joins = [line for line in _snippets(spark, sf)._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line]
    # the top join is that of snippets and templates; the one below it meets a row per group
    assert "k#" in joins[0] and "%" not in joins[0]

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.plans import order, storage


def test_tables_are_written_and_cleared(spark):
    storage.clear_tables(spark)
    a = storage.materialize(spark.range(5), "numbers")
    b = storage.materialize(spark.range(0), "none")
    folder = storage.shared_dir(spark).removeprefix("file://")
    assert a.count() == 5 and b.count() == 0 and b.columns == ["id"]
    assert any(x.startswith("numbers-") for x in os.listdir(folder))
    storage.drop_table(a)
    assert not any(x.startswith("numbers-") for x in os.listdir(folder))
    assert storage.clear_tables(spark) == 2 and not any(x.startswith("none-") for x in os.listdir(folder))


def test_broadcast_only_within_the_bound(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 7)
    right = spark.range(7).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda most: left.join(storage.broadcast_if_small(right, most), "k")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan(7) and "BroadcastHashJoin" not in plan(6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pick_is_exact(spark):
    df = spark.range(2).select(F.col("id").alias("Text"), (F.col("id") + 10).alias("text"), (F.col("id") + 20).alias("text"))
    assert [tuple(r) for r in storage.pick(df, "text").orderBy("text").collect()] == [(10,), (11,)]


@pytest.mark.parametrize("held", [20, 100_000])
def test_quantiles_and_ranks_by_refining_histograms(spark, monkeypatch, held):
    monkeypatch.setattr(order, "HELD", held)
    monkeypatch.setattr(order, "BINS", 8)
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 900).astype(float), "one": np.full(500, 2.5), "few": np.array([3.0, 1.0]), "single": np.array([7.0]),
        "wide": np.concatenate((rng.normal(size=400) * 1e300, rng.normal(size=400) * 1e-300, [0.0, -0.0, 1.7e308, -1.7e308])), None: rng.exponential(size=800) ** 9,
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("few", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.g: list(r.q) for r in order.quantiles(df, ["g"], F.col("v"), shares).collect()}
    want = {r.g: list(r.q) for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", shares).alias("q")).collect()}
    assert got == want and set(got) == set(groups)
    ranks = [(g, int(k)) for g, x in groups.items() for k in {0, len(x) // 3, len(x) - 1}] + [("few", 99), ("nothing", 0)]
    found = order.selected(df, ["g"], F.col("v"), spark.createDataFrame(ranks, "g string, rank long"), "x").collect()
    assert {(r.g, r.rank): r.x for r in found} == {(g, k): float(np.sort(groups[g])[k]) for g, k in ranks if g in groups and k < len(groups[g])}
    assert order.median(df.limit(0), ["g"], F.col("v"), "m").collect() == []


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_previous_rows_across_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(order, "SORTED", most)
    rng = np.random.default_rng(2)
    rows = [("busy", int(f), float(f % 7)) for f in rng.permutation(3000)] + [("few", 5, 1.0), ("few", 2, 2.0), ("one", 9, 3.0), (None, 4, 4.0), (None, 6, 5.0)]
    df = spark.createDataFrame(rows, "g string, f long, v double").repartition(6)
    got = {(r.g, r.f): r.p for r in order.previous(df, ["g"], ["f"], "v", "p").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((f, v) for h, f, v in rows if h == g)
        want |= {(g, f): (mine[i - 1][1] if i else None) for i, (f, _) in enumerate(mine)}
    assert got == want and order.previous(df.limit(0), ["g"], ["f"], "v", "p").columns == ["g", "f", "v", "p"]

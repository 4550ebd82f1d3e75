"""Pruned reads of raw samples, and traces as quantised blocks."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.sources import blocks as B
from chronoweave.sources import recordings as R
from chronoweave.sources.pushdown import Bounds


def test_filters_prune_raw_reads(spark, tmp_path):
    raw = np.arange(4000, dtype="<i2").reshape(1000, 4)
    raw.tofile(tmp_path / "raw.dat")
    df = R.read_raw(spark, str(tmp_path / "raw.dat"), 4, chunk=100)
    assert df.rdd.getNumPartitions() == 10
    some = df.where("frame >= 250 and frame < 420 and channel = 2")
    assert some.rdd.getNumPartitions() == 2  # from frame 250 on in chunks of 100, cut at 420
    assert {(r.frame, r.channel): r.value for r in some.collect()} == {(f, 2): float(raw[f, 2]) for f in range(250, 420)}
    assert df.where("frame > 10 and frame <= 12 and channel in (3, 1)").count() == 4
    assert df.where("frame = 990").count() == 4 and df.where("frame in (5, 905)").rdd.getNumPartitions() <= 3
    assert df.where("channel = 9").count() == df.where("frame < 0").count() == 0
    assert df.where("value > 3990").count() == 9 and df.where("frame = 3 or channel = 1").count() == 1003


def made(spark, seconds=3):
    rng = np.random.default_rng(0)
    n = 1000 * seconds
    rows = []
    for g, channels, scale in ((0, 4, 50.0), (1, 2, 1e-4), (7, 1, 1e6)):
        x = np.cumsum(rng.normal(size=(n, channels)), axis=0) * scale
        rows.append(pd.DataFrame({"grp": g, "channel": np.tile(np.arange(channels) + 10 * g, n), "frame": np.repeat(np.arange(n) - 500, channels), "value": x.ravel()}))
    pdf = pd.concat(rows, ignore_index=True).astype({"value": "float32"})
    pdf = pdf.drop(pdf.index[(pdf.grp == 0) & (pdf.frame.between(40, 60)) & (pdf.channel == 1)])  # a gap
    return pdf, spark.createDataFrame(pdf, "grp long, channel int, frame long, value float").repartition(6)


@pytest.mark.parametrize("step", [None, 0.5])
def test_blocks_come_back_within_half_a_step(spark, tmp_path, step):
    pdf, df = made(spark)
    path = f"file://{tmp_path}/trace"
    B.write_blocks(df.unionByName(df.limit(1).withColumns({"frame": F.lit(90000).cast("long"), "value": F.lit(None).cast("float")})), path, 300, step)
    got = B.read_blocks(spark, path).toPandas()
    both = pdf.merge(got, on=["grp", "channel", "frame"], suffixes=("", "_back"))
    assert len(both) == len(got) == len(pdf)
    block = both.frame // 300
    largest = both.value.abs().groupby([both.grp, both.channel, block]).transform("max")
    bound = (largest / B.STEPS / 2 if step is None else 0.25) + 1e-6 * both.value.abs() + 1e-12
    assert ((both.value - both.value_back).abs() <= bound).all()
    size = sum(os.path.getsize(tmp_path / "trace" / x) for x in os.listdir(tmp_path / "trace"))
    assert size < 12 * len(pdf) / 3


def test_filters_spare_files_and_blocks(spark, tmp_path, monkeypatch):
    pdf, df = made(spark)
    path = f"file://{tmp_path}/trace"
    B.write_blocks(df, path, 300)
    reader = B._Reader(path)
    every = len(reader.partitions())
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    filters = [EqualTo(("grp",), 7), GreaterThanOrEqual(("frame",), 1000), LessThan(("frame",), 1200)]
    assert list(reader.pushFilters(filters)) == filters
    read = []
    monkeypatch.setattr(B, "unpacked", lambda data, about, real=B.unpacked: (read.append(about), real(data, about))[1])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) <= every and len(read) <= 2 and all(a["grp"] == 7 for a in read)
    assert sum(b.num_rows for b in batches) >= 200
    got = B.read_blocks(spark, path).where("grp = 7 and frame >= 1000 and frame < 1200")
    assert got.count() == 200 and B.read_blocks(spark, path).where("channel = 11").count() == 3000
    assert B.read_blocks(spark, path).where("grp = 5").count() == 0


def test_a_killed_write_leaves_the_table_as_it_was(spark, tmp_path):
    pdf, df = made(spark, 1)
    path = f"file://{tmp_path}/trace"
    bad = df.withColumn("value", F.when((F.col("grp") == 7) & (F.col("frame") == 499), F.raise_error(F.lit("dies"))).otherwise(F.col("value")).cast("float"))
    with pytest.raises(Exception, match="dies"):
        B.write_blocks(bad, path, 300)
    assert B.read_blocks(spark, path).count() == 0
    B.write_blocks(df.where("grp = 1"), path, 300)
    first = B.read_blocks(spark, path).count()
    with pytest.raises(Exception, match="dies"):
        B.write_blocks(bad, path, 300)
    assert B.read_blocks(spark, path).count() == first == 2000
    B.write_blocks(df, path, 300)
    assert B.read_blocks(spark, path).count() == len(pdf)
    B.write_blocks(df.limit(0), path, 300)
    assert B.read_blocks(spark, path).count() == 0
    with pytest.raises(Exception, match="not appended"):
        df.write.format("trace_blocks").options(path=path, block="300").mode("append").save()


def test_bounds():
    b = Bounds()
    b.narrow(low=3)
    b.narrow(low=1, high=9)
    assert (b.low, b.high) == (3, 9) and b.wants(9, 20) and not b.wants(10, 20) and not b.wants(0, 2)
    b.listed = {5}
    assert b.among([3, 4, 5]) == [5] and not b.wants(6, 9)

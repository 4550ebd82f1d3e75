import numpy as np
import pytest

from chronoweave.sources import recordings as R
from chronoweave.sources import stores
from chronoweave.streaming import trains as ST

XML = (
    '<SETTINGS><SIGNALCHAIN><PROCESSOR name="Other"><CUSTOM_PARAMETERS><STREAM><CH index="99" enabled="1"/></STREAM></CUSTOM_PARAMETERS></PROCESSOR>'
    '<PROCESSOR name="Channel Map"><CUSTOM_PARAMETERS><STREAM>'
    + "".join(f'<CH index="{i}" enabled="{e}"/>' for i, e in zip((7, 5, 3, 1, 6, 4, 2, 0, 8), (1, 1, 1, 1, 1, 0, 1, 1, 1), strict=True))
    + "</STREAM></CUSTOM_PARAMETERS></PROCESSOR></SIGNALCHAIN></SETTINGS>"
)


def test_channel_map(spark):
    rows = R.channel_map(spark.createDataFrame([(XML,)], "value string")).orderBy("pos").collect()
    assert [r.oe_index for r in rows] == [7, 5, 3, 1, 6, 4, 2, 0]
    assert [r.enabled for r in rows] == [1, 1, 1, 1, 1, 0, 1, 1] and [r.tetrode for r in rows] == [1] * 4 + [2] * 4


def test_attach_map(spark):
    m = R.channel_map(spark.createDataFrame([(XML,)], "value string"))
    channels = spark.createDataFrame([(i, f"CH{i + 1}") for i in range(8)], "oe_index int, channel string")
    out = R.attach_map(channels, m).orderBy("grp", "pos").collect()
    assert [r.channel for r in out] == ["CH8", "CH6", "CH4", "CH2", "CH7", "CH5", "CH3", "CH1"]
    assert [r.grp for r in out] == [0] * 4 + [1] * 4 and out[4].label == "TT2" and out[4].x == 300.0
    assert [r.grp for r in R.attach_map(channels, m, [2], geometry=False).collect()] == [0] * 4
    assert sorted(r.channel for r in R.lead_channels(R.attach_map(channels, m)).collect()) == ["CH7", "CH8"]
    with pytest.raises(Exception, match="inconsistent"):
        R.attach_map(channels.where("oe_index <> 3"), m).collect()
    with pytest.raises(ValueError, match="neither"):
        R.lead_channels(channels)


def test_settings_names(tmp_path):
    assert [R.settings_name(f"experiment{i}") for i in (1, 2, 11)] == ["settings.xml", "settings_2.xml", "settings_11.xml"]
    for i in (1, 2, 11):
        (tmp_path / f"experiment{i}").mkdir()
    assert R.settings_for_block(str(tmp_path), 2).endswith("settings_11.xml")
    with pytest.raises(IndexError):
        R.settings_for_block(str(tmp_path), 3)


def test_sync_and_threshold(spark):
    df = spark.createDataFrame([("Software Time (ms): 1700000000500",), ("nothing",)], "value string")
    assert [r[0] for r in df.select(R.software_time(df.value)).collect()] == [1700000000.5, None]
    df = spark.createDataFrame([("a\ndetect_threshold: 5.5",), ("detect_threshold: x",)], "value string")
    assert [r[0] for r in df.select(R.detect_threshold(df.value, 4.0)).collect()] == [5.5, 4.0]


def test_raw_samples(spark, tmp_path):
    raw = np.arange(400, dtype="<i2").reshape(100, 4)
    raw.tofile(tmp_path / "raw.dat")
    df = R.read_raw(spark, str(tmp_path / "raw.dat"), 4, gains="0.5", selected="3,1", start=10, end=60, chunk=7)
    rows = {(r.channel, r.frame): r.value for r in df.collect()}
    assert len(rows) == 100 and rows[3, 10] == 0.5 * raw[10, 3] and rows[1, 59] == 0.5 * raw[59, 1]
    wide = R.with_layout(df, "wide").where("frame = 20").first()
    assert wide["values"] == [0.5 * raw[20, 1], 0.5 * raw[20, 3]]
    with pytest.raises(ValueError, match="layout"):
        R.with_layout(df, "cube")


def test_params_ignore_unknown_keys(tmp_path):
    p = R.ExperimentParams("s", "e", t0_unix=0.0, lightsOn=["2024-01-01T09:00:00"])
    p.save(str(tmp_path / "x" / "p.json"))
    assert R.ExperimentParams.load(str(tmp_path / "x" / "p.json")) == p


def test_local_time_round_trip(spark):
    df = spark.sql("SELECT timestamp'2024-03-10 03:30:00' AS t UNION ALL SELECT timestamp'2024-07-01 00:00:00'")
    s = R.session_seconds(df.t, "America/New_York", 1.7e9)
    assert all(r[0] == r[1] for r in df.select("t", R.local_time(s, "America/New_York", 1.7e9)).collect())


def test_find_recording_lists_what_there_is(spark):
    seg = spark.createDataFrame([(1, 1), (2, 1)], "experiment int, recording int")
    assert R.find_recording(seg, 2, 1).count() == 1
    with pytest.raises(KeyError, match="1, 1"):
        R.find_recording(seg, 3, 1)


def test_session_tree(spark):
    paths = [(f"file:/d/Record Node 1/experiment{e}/recording1/continuous/A/continuous.dat", 10 * e) for e in (1, 2)] + [("file:/d/Record Node 1/settings.xml", 5)]
    tree = R.session_tree(spark.createDataFrame(paths, "path string, length long")).orderBy("experiment").collect()
    assert [(r.node, r.experiment, r.recording, r.stream, r.bytes) for r in tree] == [("Record Node 1", 1, 1, "A", 10), ("Record Node 1", 2, 1, "A", 20)]


def test_stores(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert stores.materialize_once(spark, str(tmp_path / "once"), make).count() == 5
    assert len(made) == 1
    assert stores.append_new(spark.range(3), str(tmp_path / "out"), "id") == 3
    assert stores.append_new(spark.range(5), str(tmp_path / "out"), "id") == 2
    with stores.locked(spark, str(tmp_path / "out")), pytest.raises(RuntimeError, match="being written"):
        stores.append_new(spark.range(9), str(tmp_path / "out"), "id")
    assert stores.append_new(spark.range(6), str(tmp_path / "out"), "id") == 1
    trace = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "grp long, frame long, value double")
    stores.write_trace(trace, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).where("grp = 1").count() == 1
    for form in ("csv", "json"):
        stores.write_rows(trace, str(tmp_path / form), form)
        stores.write_rows(trace, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    assert '"provenance":{"run":"7"}' in stores.manifest(trace, {"run": "7"}).first().value
    seg = spark.createDataFrame([(0, 10, 0.0), (10, 20, 100.0)], "start_sample long, end_sample long, t_start double")
    ev = spark.createDataFrame([(0, 3, 12)], "grp long, unit long, frame long")
    assert tuple(stores.spike_table(ev, seg, 2.0).first()) == (101.0, 3, "TT1")


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i % 2, f"2024-01-01 00:{m:02d}:00", i) for i, m in enumerate((0, 1, 2, 20, 21, 50))]
    df = spark.createDataFrame(rows, "unit long, t string, frame long").selectExpr("unit", "cast(t as timestamp) as ts", "frame")
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), df


def run(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, stream):
    live, batch = stream
    from pyspark.sql import functions as F

    got = run(ST.tumbling_counts(live, "ts", ["unit"], "10 minutes", "1 hour"), spark, "tumbling", "complete")
    want = batch.groupBy(F.window("ts", "10 minutes"), "unit").count()
    assert sorted((r.window.start, r.unit, r.n) for r in got.collect()) == sorted((r.window.start, r.unit, r["count"]) for r in want.collect())
    starts = run(ST.session_starts(live, "ts", ["unit"], "5 minutes", "1 hour"), spark, "sessions", "complete")
    assert sorted(r.n for r in starts.collect()) == [1, 1, 1, 1, 2]
    rates = run(ST.running_rates(live, "unit", "frame"), spark, "rates", "update")
    assert sorted((r.unit, r.n, r.last) for r in rates.collect()) == [(0, 3, 4), (1, 3, 5)]

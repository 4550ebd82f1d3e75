"""Scalar functions and text scans on ``events``, ``orders``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators import trains as T
from chronoweave.plans.registry import query
from chronoweave.operators import quality as Q
from chronoweave.sources import recordings as R
from chronoweave.sources import stores as W
from chronoweave.sources.tables import DAY, EVENTS, events, table


@query(
    "src16_json_params",
    """SELECT c_custkey, c_mktsegment AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'UTC' ELSE 'zone' || c_nationkey END AS timezone, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::DOUBLE END AS t0_unix,
    CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END::INT AS n_lights, c_custkey % 7 = 0 AS broken FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 7 = 0""",
)
def src16_json_params(spark, sf):
    key = F.col("c_custkey")
    made = F.struct(
        F.col("c_mktsegment").alias("subject"), F.col("c_name").alias("experiment"), F.when(key % 3 != 0, F.concat(F.lit("zone"), F.col("c_nationkey").cast("string"))).alias("timezone"),
        F.when(key % 5 != 0, F.col("c_acctbal").cast("double")).alias("t0_unix"), F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("lightsOn"), F.lit(1).alias("unknown"),
    )
    c = table(spark, sf, "customer").select("c_custkey", F.when(key % 7 != 0, F.to_json(made)).alias("text"))
    p = c.select("c_custkey", R.params_of(F.col("text")).alias("p"))
    return p.select("c_custkey", "p.subject", "p.timezone", "p.t0_unix", F.when(F.col("p").isNotNull(), F.size("p.lightsOn")).alias("n_lights"), F.col("p").isNull().alias("broken"))


@query("src7_sync_anchor", "SELECT event_id, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t0 FROM events")
def src7_sync_anchor(spark, sf):
    line = F.concat(F.lit("Software Time (milliseconds since midnight Jan 1st 1970 UTC): "), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    return table(spark, sf, "events").select("event_id", R.software_time(line).alias("t0"))


@query("src17_detect_threshold", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 5.0::DOUBLE ELSE (c_custkey % 10) / 2.0::DOUBLE END AS threshold FROM customer")
def src17_detect_threshold(spark, sf):
    line = F.when(F.col("c_custkey") % 3 == 0, F.lit("detect_threshold: none")).otherwise(F.concat(F.lit("x\ndetect_threshold: "), ((F.col("c_custkey") % 10) / 2.0).cast("string")))
    return table(spark, sf, "customer").select("c_custkey", R.detect_threshold(line).alias("threshold"))


_SETTINGS = "<SETTINGS><SIGNALCHAIN><PROCESSOR name='Other'><CUSTOM_PARAMETERS/></PROCESSOR><PROCESSOR name='Channel Map'><CUSTOM_PARAMETERS><STREAM>"


@query("src1_channel_map", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS pos, (24 - n_nationkey)::INT AS oe_index, (n_nationkey % 5 <> 0)::INT AS enabled, ((row_number() OVER (ORDER BY n_nationkey) - 1) // 4 + 1)::INT AS tetrode FROM nation QUALIFY pos < 24")
def src1_channel_map(spark, sf):
    n = F.col("n_nationkey")
    ch = F.concat(F.lit('<CH index="'), (24 - n).cast("string"), F.lit('" enabled="'), (n % 5 != 0).cast("int").cast("string"), F.lit('"/>'))
    one = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct(n, ch.alias("x")))).alias("c"))  # a settings file
    body = F.array_join(F.transform("c", lambda s: s["x"]), "")
    text = F.concat(F.lit(_SETTINGS.replace("'", '"')), body, F.lit("</STREAM></CUSTOM_PARAMETERS></PROCESSOR></SIGNALCHAIN></SETTINGS>"))
    return R.channel_map(one.select(text.alias("value")))


@query("src2_settings_names", "SELECT n_nationkey + 1 AS experiment, CASE WHEN n_nationkey = 0 THEN 'settings.xml' ELSE 'settings_' || (n_nationkey + 1) || '.xml' END AS name FROM nation")
def src2_settings_names(spark, sf):
    e = (F.col("n_nationkey") + 1).alias("experiment")
    return table(spark, sf, "nation").select(e).withColumn("name", R.settings_names(F.concat(F.lit("experiment"), F.col("experiment").cast("string"))))


@query("src4_session_tree", "SELECT 'Record Node ' || (conv_id % 3) AS node, (conv_id % 7)::INT AS experiment, (conv_id % 2 + 1)::INT AS recording, role AS stream, sum(length(text))::BIGINT AS bytes FROM conversations WHERE turn <> 1 GROUP BY 1, 2, 3, 4")
def src4_session_tree(spark, sf):
    # a file per turn; the second turn of each conversation lies outside the streams
    n = lambda x: x.cast("string")
    folder = F.concat(F.lit("file:/d/Record Node "), n(F.col("conv_id") % 3), F.lit("/experiment"), n(F.col("conv_id") % 7), F.lit("/recording"), n(F.col("conv_id") % 2 + 1))
    stream = F.when(F.col("turn") != 1, F.concat(F.lit("/continuous/"), "role")).otherwise("/events")
    files = table(spark, sf, "conversations").select(F.concat(folder, stream, F.lit("/f"), n(F.col("turn"))).alias("path"), F.length("text").cast("long").alias("length"))
    return R.session_tree(files)


@query("src12_typed_scan", "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, contains(html, '<table') AS has_table FROM pages")
def src12_typed_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.contains("html", F.lit("<table")).alias("has_table"))


@query("fn1_labels", "SELECT s_suppkey, 'TT' || (s_suppkey % 16 + 1) AS label, regexp_extract('TT' || (s_suppkey % 16 + 1), '([0-9]+)', 1)::INT AS k, regexp_replace(s_name, '^Supplier#0*', '') AS short, printf('%.2f', s_acctbal) AS shown FROM supplier")
def fn1_labels(spark, sf):
    label = F.concat(F.lit("TT"), (F.col("s_suppkey") % 16 + 1).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", label.alias("label"), F.regexp_extract(label, "([0-9]+)", 1).cast("int").alias("k"), F.regexp_replace("s_name", "^Supplier#0*", "").alias("short"), F.format_string("%.2f", "s_acctbal").alias("shown"))


@query("fn2_session_seconds", f"WITH {EVENTS} SELECT event_id, round((frame - 5 * 3600000000 * -1) / 1000000.0::DOUBLE - 1700000000, 3) AS t FROM ev")
def fn2_session_seconds(spark, sf):
    # a zone five hours behind, without daylight saving
    local = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.round(R.session_seconds(local, "-05:00", 1.7e9), 3).alias("t"))


@query("fn2_round_trip", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def fn2_round_trip(spark, sf):
    local = F.col("ts").cast("timestamp")
    t = R.session_seconds(local, "America/New_York", 1.7e9)
    return table(spark, sf, "events").select("event_id", F.date_format(R.local_time(t, "America/New_York", 1.7e9), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("fn5_sample_bounds", "SELECT s_suppkey, least(greatest(15 + round_even((s_suppkey % 9 - 4) * 0.25 * 30, 0)::INT, 0), 40)::INT AS a FROM supplier")
def fn5_sample_bounds(spark, sf):
    shift = F.bround((F.col("s_suppkey") % 9 - 4) * 0.25 * 30, 0).cast("int")
    return table(spark, sf, "supplier").select("s_suppkey", F.least(F.greatest(15 + shift, F.lit(0)), F.lit(40)).alias("a"))


_PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd")


@query("fn7_palette", "WITH l AS (SELECT DISTINCT p_brand AS label FROM part) SELECT label, (['" + "', '".join(_PALETTE) + "'])[((dense_rank() OVER (ORDER BY label) - 1) % 5 + 1)] AS color FROM l")
def fn7_palette(spark, sf):
    l = table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct()  # noqa: E741
    place = F.pmod(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1, F.lit(len(_PALETTE)))
    return l.select("label", F.get(F.array(*map(F.lit, _PALETTE)), place).alias("color"))


@query("fn8_nested_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k, coalesce(json_extract_string(props, '$.none.such'), '-') AS none FROM events")
def fn8_nested_paths(spark, sf):
    return table(spark, sf, "events").select("event_id", Q.dig(F.col("props"), "k").alias("k"), Q.dig(F.col("props"), "none", "such").alias("none"))


@query("fn9_paths", "SELECT c_custkey, 'data/' || c_mktsegment || '/' || c_name || '/experiment_params.json' AS path FROM customer")
def fn9_paths(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.experiment_paths(F.col("c_mktsegment"), F.col("c_name")).alias("path"))


@query("fn11_chunk_columns", f"WITH {EVENTS}, t AS (SELECT max(frame) - min(frame) + 1 AS n FROM ev), c AS (SELECT i AS chunk, i * {DAY} AS a, least((i + 1) * {DAY}, n) AS b FROM t, (SELECT unnest(range(0, 400)) AS i) WHERE i * {DAY} < n) SELECT chunk, (b - a) AS n_frames, a / 1000000.0::DOUBLE AS t_start_s, b / 1000000.0::DOUBLE AS t_end_s FROM c")
def fn11_chunk_columns(spark, sf):
    span = events(spark, sf).agg((F.max("frame") - F.min("frame") + 1).alias("n")).first()  # one number
    c = T.plan_chunks(spark, span.n or 0, DAY, 0.0, least_tail=0.0)
    return c.select("chunk", (F.col("end_frame") - F.col("start_frame")).alias("n_frames"), (F.col("start_frame") / 1e6).alias("t_start_s"), (F.col("end_frame") / 1e6).alias("t_end_s"))


@query("prj1_gain_scaling", "SELECT s_suppkey, round(((s_acctbal::INT % 1000)::FLOAT * 0.195::FLOAT)::DOUBLE, 3) AS uv FROM supplier")
def prj1_gain_scaling(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(((F.bround("s_acctbal", 0).cast("int") % 1000).cast("float") * F.lit(0.195).cast("float")).cast("double"), 3).alias("uv"))


@query("prj2_attach_groups", "SELECT ((s_suppkey) // 4)::INT AS grp, (s_suppkey)::INT AS pos, 'CH' || (s_suppkey + 1) AS channel, 'TT' || (s_suppkey // 4 + 1) AS label FROM supplier")
def prj2_attach_groups(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("i"))
    mapping = s.select(F.col("i").alias("pos"), F.col("i").alias("oe_index"), F.lit(1).alias("enabled"), (F.floor(F.col("i") / 4) + 1).cast("int").alias("tetrode"))
    channels = s.select(F.col("i").alias("oe_index"), F.concat(F.lit("CH"), (F.col("i") + 1).cast("string")).alias("channel"))
    return R.attach_map(channels, mapping).select("grp", "pos", "channel", "label")


@query("prj3_lead_channels", "SELECT (s_suppkey // 4)::INT AS grp, 'CH' || min(s_suppkey) AS channel FROM supplier GROUP BY 1")
def prj3_lead_channels(spark, sf):
    s = table(spark, sf, "supplier").select((F.floor(F.col("s_suppkey") / 4)).cast("int").alias("grp"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("CH"), F.col("s_suppkey").cast("string")).alias("channel"))
    return R.lead_channels(s)


_SEGMENTS = f"""sg AS (SELECT frame // {5 * DAY} AS seg, min(frame) AS s, max(frame) + 1 AS e FROM ev GROUP BY 1), st AS (SELECT *, seg * 1000.0::DOUBLE AS t_start FROM sg WHERE seg % 4 <> 1)"""


@query("snk5_spike_table", f"WITH {EVENTS}, {_SEGMENTS} SELECT event_id, round(t_start + (frame - s) / 1000000.0::DOUBLE, 3) AS time, unit::INT AS unit_id, 'TT' || (grp + 1) AS tetrode FROM ev JOIN st ON frame >= s AND frame < e")
def snk5_spike_table(spark, sf):
    # segments of five days; of one in four the samples were lost
    ev = events(spark, sf)
    seg = F.floor(F.col("frame") / F.lit(5 * DAY))
    cut = ev.groupBy(seg.alias("seg")).agg(F.min("frame").alias("start_sample"), (F.max("frame") + 1).alias("end_sample")).where("seg % 4 <> 1")
    return W.spike_table(ev, cut.withColumn("t_start", F.col("seg") * 1000.0), 1e6, ("event_id",)).withColumn("time", F.round("time", 3))

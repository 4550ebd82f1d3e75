"""Series operators on daily shipments, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators import series as S
from chronoweave.plans.registry import query
from chronoweave.sources.tables import DAILY, DAY, EVENTS, HOUR, daily, events, table


@query("ag1_group_mean", f"WITH {DAILY} SELECT channel % 4 AS grp, day, round(avg(value), 6) AS mean FROM dl GROUP BY 1, 2")
def ag1_group_mean(spark, sf):
    return daily(spark, sf).groupBy((F.col("channel") % 4).alias("grp"), F.col("day").cast("long").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("ag23_common_median", f"WITH {DAILY} SELECT channel, day, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY day), 6) AS referenced FROM dl")
def ag23_common_median(spark, sf):
    out = S.common_reference(daily(spark, sf), ["day"], "value")
    return out.select("channel", F.col("day").cast("long").alias("day"), F.round("referenced", 6).alias("referenced"))


_MONTHS = "mo AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS m, count(*) AS n, min(epoch_us(o_orderdate)) / 1000000.0 AS t0 FROM orders GROUP BY 1)"


def _months(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").groupBy((F.year(d) * 12 + F.month(d)).cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"), (F.min(F.unix_micros(d)) / 1e6).alias("t0"))


_SLICES = f"""{_MONTHS}, en AS (SELECT m, n, t0, sum(n) OVER (ORDER BY m) AS end_sample, t0 - first_value(t0) OVER (ORDER BY m) AS t_start FROM mo),
    sl AS (SELECT m, n, end_sample::BIGINT AS end_sample, (end_sample - n)::BIGINT AS start_sample, t_start, t_start + n / 0.001 AS t_end FROM en)"""


@query("wn3_slice_table", f"WITH {_SLICES} SELECT m, start_sample, end_sample, round(t_start, 3)::DOUBLE AS t_start, round(t_end, 3)::DOUBLE AS t_end, round(t_start - lag(t_end) OVER (ORDER BY m), 3)::DOUBLE AS gap_s FROM sl")
def wn3_slice_table(spark, sf):
    s = S.slice_table(_months(spark, sf), "m", "n", "t0", 0.001)
    return s.select("m", "start_sample", "end_sample", *[F.round(c, 3).alias(c) for c in ("t_start", "t_end", "gap_s")])


@query(
    "jn16_frame_to_time",
    f"""WITH {_SLICES}, t AS (SELECT max(end_sample) AS total FROM sl), q AS (SELECT o_orderkey, (o_orderkey * 7919) % total AS f FROM orders, t)
    SELECT o_orderkey, m, round(t_start + (f - start_sample) / 0.001, 3)::DOUBLE AS t FROM q JOIN sl ON f >= start_sample AND f < end_sample""",
)
def jn16_frame_to_time(spark, sf):
    sl = S.slice_table(_months(spark, sf), "m", "n", "t0", 0.001).select("m", "start_sample", "end_sample", "t_start")
    total = sl.agg(F.max("end_sample").alias("total"))  # one row
    q = table(spark, sf, "orders").select("o_orderkey").join(F.broadcast(total))
    q = q.select("o_orderkey", ((F.col("o_orderkey") * 7919) % F.col("total")).alias("f"))
    met = S.in_intervals(q, sl.withColumn("from", F.col("start_sample")), "f", "start_sample", "end_sample", ["m", "t_start", "from"]).withColumnRenamed("from", "start_sample")
    return met.select("o_orderkey", "m", F.round(F.col("t_start") + (F.col("f") - F.col("start_sample")) / 0.001, 3).alias("t"))


_TRANSITIONS = f"""tr AS (SELECT unit, min(frame) AS t, CASE WHEN (frame // {DAY}) % 2 = 0 THEN 'light' ELSE 'dark' END AS label FROM ev WHERE kind = 'signup' GROUP BY unit, frame // {DAY}, 3),
    ld AS (SELECT unit, t AS s, lead(t) OVER (PARTITION BY unit ORDER BY t) AS e, label FROM tr)"""


def _periods(spark, sf):
    day = F.floor(F.col("frame") / F.lit(DAY))
    label = F.when(F.pmod(day, F.lit(2)) == 0, "light").otherwise("dark")
    tr = events(spark, sf).where("kind = 'signup'").groupBy("unit", day.alias("day"), label.alias("label")).agg(F.min("frame").alias("t"))
    return S.light_dark(tr, "t", "label", ["unit"])


@query("wn4_light_dark", f"WITH {EVENTS}, {_TRANSITIONS} SELECT unit, s AS start, e AS \"end\", label FROM ld WHERE e IS NOT NULL")
def wn4_light_dark(spark, sf):
    return _periods(spark, sf)


@query(
    "jn19_clip_intervals",
    f"""WITH {EVENTS}, {_TRANSITIONS}, b AS (SELECT min(frame) + {5 * DAY} AS lo, min(frame) + {12 * DAY} AS hi FROM ev),
    c AS (SELECT unit, greatest(s, lo) AS s, least(e, hi) AS e FROM ld, b WHERE e IS NOT NULL) SELECT unit, s AS lo, e AS hi FROM c WHERE e > s""",
)
def jn19_clip_intervals(spark, sf):
    first = events(spark, sf).agg(F.min("frame").alias("f")).first().f or 0  # one number
    lo, hi = S.clipped(F.col("start"), F.col("end"), first + 5 * DAY, first + 12 * DAY)
    return _periods(spark, sf).select("unit", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


@query(
    "wn5_rolling_mean",
    f"""WITH {DAILY}, r AS (SELECT channel, day, avg(value) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth,
        row_number() OVER (PARTITION BY channel ORDER BY day) - 1 AS k FROM dl) SELECT channel, day, round(smooth, 6) AS smooth FROM r WHERE k % 3 = 0""",
)
def wn5_rolling_mean(spark, sf):
    r = S.rolling_mean(daily(spark, sf), ["channel"], "day", "value", 5)
    k = F.row_number().over(Window.partitionBy("channel").orderBy("day")) - 1
    return r.withColumn("k", k).where("k % 3 = 0").select("channel", F.col("day").cast("long").alias("day"), F.round("smooth", 6).alias("smooth"))


@query(
    "wn5_extreme_day",
    f"""WITH {DAILY}, r AS (SELECT channel, day, avg(value) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM dl),
    k AS (SELECT channel, day, row_number() OVER (PARTITION BY channel ORDER BY round(smooth, 6) DESC, day) AS n FROM r WHERE NOT day BETWEEN 1000 AND 1500) SELECT channel, day FROM k WHERE n = 1""",
)
def wn5_extreme_day(spark, sf):
    r = S.rolling_mean(daily(spark, sf), ["channel"], "day", "value", 5).where("not day between 1000 and 1500")
    best = r.groupBy("channel").agg(F.max(F.struct(F.round("smooth", 6).alias("s"), (-F.col("day")).alias("d"))).alias("b"))
    return best.select("channel", (-F.col("b.d")).cast("long").alias("day"))


_HIST = f"""{DAILY}, x AS (SELECT channel % 5 AS grp, channel, day, value FROM dl), sp AS (SELECT grp, min(value) AS lo, (max(value) - min(value)) / 200 AS w FROM x GROUP BY grp),
    cn AS (SELECT x.grp, least(floor((value - lo) / w), 199)::BIGINT AS bin, count(*) AS n FROM x JOIN sp ON sp.grp = x.grp GROUP BY 1, 2),
    gr AS (SELECT grp, lo, w, unnest(range(0, 200)) AS bin FROM sp), hi AS (SELECT gr.grp, gr.bin, lo, w, coalesce(n, 0) AS n FROM gr LEFT JOIN cn ON cn.grp = gr.grp AND cn.bin = gr.bin),
    zi AS (SELECT *, bin - row_number() OVER (PARTITION BY grp ORDER BY bin) AS island FROM hi WHERE n = 0),
    ru AS (SELECT grp, min(bin) AS bin, count(*) AS len, min(lo) AS lo, min(w) AS w FROM zi GROUP BY grp, island),
    re AS (SELECT *, coalesce(max(len) OVER (PARTITION BY grp ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM ru),
    th AS (SELECT grp, prior + 1 AS run_length, lo + bin * w AS threshold FROM re WHERE len > prior)"""


def _grouped(spark, sf):
    return daily(spark, sf).select((F.col("channel") % 5).alias("grp"), "channel", F.col("day").cast("long").alias("day"), "value")


@query("wn8_gap_thresholds", f"WITH {_HIST} SELECT grp, run_length, round(threshold, 6) AS threshold FROM th")
def wn8_gap_thresholds(spark, sf):
    return S.gap_thresholds(S.histogram(_grouped(spark, sf), ["grp"], "value", 200), ["grp"]).withColumn("threshold", F.round("threshold", 6))


@query("ag13_histogram", f"WITH {_HIST} SELECT grp, bin, n FROM hi")
def ag13_histogram(spark, sf):
    return S.histogram(_grouped(spark, sf), ["grp"], "value", 200).select("grp", "bin", "n")


@query(
    "sp5_outlier_gap",
    f"""WITH {_HIST}, t AS (SELECT grp, min(threshold) AS threshold FROM th GROUP BY grp)
    SELECT channel, day, CASE WHEN threshold IS NULL OR value <= threshold THEN value END AS clean FROM x LEFT JOIN t ON t.grp = x.grp""",
)
def sp5_outlier_gap(spark, sf):
    return S.replace_outliers(_grouped(spark, sf), ["grp"], "value", 200).select("channel", "day", "clean")


@query("sp7_local_peaks", f"WITH {DAILY}, p AS (SELECT channel, day, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM dl WINDOW w AS (PARTITION BY channel ORDER BY day)) SELECT channel, day, value FROM p WHERE value > a AND value >= b AND value >= 60")
def sp7_local_peaks(spark, sf):
    return S.local_peaks(daily(spark, sf), ["channel"], "day", "value", 60.0).select("channel", F.col("day").cast("long").alias("day"), "value")


@query(
    "sp9_mad_transients",
    f"""WITH {DAILY}, m AS (SELECT channel, quantile_cont(value, 0.5) AS med FROM dl GROUP BY channel), d AS (SELECT dl.channel, quantile_cont(abs(value - med), 0.5) AS mad, max(med) AS med FROM dl JOIN m ON m.channel = dl.channel GROUP BY 1)
    SELECT dl.channel, day, value FROM dl JOIN d ON d.channel = dl.channel WHERE value > med + 3 * 1.4826 * mad""",
)
def sp9_mad_transients(spark, sf):
    x = daily(spark, sf)
    m = x.groupBy("channel").agg(F.percentile("value", 0.5).alias("med"))
    y = x.join(m, "channel")
    d = y.groupBy("channel").agg(F.percentile(F.abs(F.col("value") - F.col("med")), 0.5).alias("mad"))
    return y.join(d, "channel").where("value > med + 3 * 1.4826 * mad").select("channel", F.col("day").cast("long").alias("day"), "value")


@query(
    "fn3_robust_scale",
    f"""WITH {DAILY}, m AS (SELECT channel, quantile_cont(value, 0.5) AS med FROM dl GROUP BY channel)
    SELECT dl.channel, round(quantile_cont(abs(value - med), 0.5) / 0.6745, 6) AS mad, round(sqrt(avg(value * value)), 6) AS rms, round(10 * log10(avg(value) + 1e-30), 6) AS db, round(stddev_pop(value), 6) AS sd
    FROM dl JOIN m ON m.channel = dl.channel GROUP BY dl.channel""",
)
def fn3_robust_scale(spark, sf):
    x = daily(spark, sf)
    y = x.join(x.groupBy("channel").agg(F.percentile("value", 0.5).alias("med")), "channel")
    v = F.col("value")
    return y.groupBy("channel").agg(
        F.round(F.percentile(F.abs(v - F.col("med")), 0.5) / 0.6745, 6).alias("mad"), F.round(F.sqrt(F.avg(v * v)), 6).alias("rms"),
        F.round(10 * F.log10(F.avg(v) + 1e-30), 6).alias("db"), F.round(F.stddev_pop(v), 6).alias("sd"),
    )


@query("ag26_slope_through_origin", f"WITH {DAILY}, s AS (SELECT channel, sum(day * value) / sum(day * day) AS b, sum(day::DOUBLE * day) AS xx, count(*) AS n FROM dl GROUP BY channel) SELECT dl.channel, round(max(b), 9) AS slope, round(sqrt(sum(power(value - b * day, 2)) / (max(n) - 1) / max(xx)), 9) AS se FROM dl JOIN s ON s.channel = dl.channel GROUP BY dl.channel")
def ag26_slope_through_origin(spark, sf):
    x, day = daily(spark, sf), F.col("day").cast("double")
    s = x.groupBy("channel").agg((F.sum(day * F.col("value")) / F.sum(day * day)).alias("b"), F.sum(day * day).alias("xx"), F.count(F.lit(1)).alias("n"))
    r = F.sum(F.pow(F.col("value") - F.col("b") * day, 2))
    return x.join(s, "channel").groupBy("channel").agg(F.round(F.max("b"), 9).alias("slope"), F.round(F.sqrt(r / (F.max("n") - 1) / F.max("xx")), 9).alias("se"))


@query("ag27_loglog_slope", "WITH c AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT round(regr_slope(ln(q), ln(n)), 6) AS slope, count(*) AS n FROM c")
def ag27_loglog_slope(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return c.agg(F.round(F.regr_slope(F.log("q"), F.log("n")), 6).alias("slope"), F.count(F.lit(1)).alias("n"))


@query("ag27_ranked_breakdown", "WITH c AS (SELECT l_shipdate::DATE AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1), y AS (SELECT year(d)::BIGINT AS y, sum(q) AS q FROM c GROUP BY 1) SELECT y, row_number() OVER (ORDER BY q DESC, y) AS rank, round(100 * q / sum(q) OVER (), 6) AS pct FROM y")
def ag27_ranked_breakdown(spark, sf):
    y = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy(F.lit(0))  # a row per year
    return y.select("y", F.row_number().over(w.orderBy(F.col("q").desc(), "y")).cast("long").alias("rank"), F.round(100 * F.col("q") / F.sum("q").over(w), 6).alias("pct"))


@query("ag28_vector_strength", f"WITH {EVENTS}, p AS (SELECT unit, 2 * pi() * (frame % {DAY}) / {DAY}.0::DOUBLE AS ph FROM ev) SELECT unit, round(sqrt(power(avg(cos(ph)), 2) + power(avg(sin(ph)), 2)), 6) AS r FROM p GROUP BY unit")
def ag28_vector_strength(spark, sf):
    phase = 2 * F.pi() * (F.col("frame") % DAY) / float(DAY)
    return events(spark, sf).groupBy("unit").agg(F.round(S.vector_strength(phase), 6).alias("r"))


_STRENGTHS = f"""la AS (SELECT unnest([-12, -6, 0, 6, 12]) AS lag_h), pe AS (SELECT unnest([24, 12, 8]) AS period_h),
    q AS (SELECT unit, lag_h AS lag, period_h, 2 * pi() * ((frame + lag_h * {HOUR} * (unit % 3)) % (period_h * {HOUR})) / (period_h * {HOUR})::DOUBLE AS ph FROM ev, la, pe),
    st AS (SELECT unit, period_h, lag, count(*) AS n, sqrt(power(avg(cos(ph)), 2) + power(avg(sin(ph)), 2)) AS r FROM q GROUP BY 1, 2, 3),
    cl AS (SELECT unit, period_h, max(r) FILTER (WHERE lag = 0) AS r0, avg(r) FILTER (WHERE abs(lag) >= 12) AS r_edge, max(0.5 * sqrt(3.0::DOUBLE / n)) AS null_r FROM st GROUP BY 1, 2),
    kc AS (SELECT *, CASE WHEN r_edge > 2 * null_r THEN 'SUSTAINED' WHEN r0 > 2 * null_r THEN 'LEAKAGE' ELSE 'NONE' END AS class FROM cl)"""


def _phase_classes(spark, sf):
    """Bands are periods of the day; phases turn with the lag for two units in three. Half the Rayleigh law's 95th percentile stands for the null."""
    numbers = lambda xs, name: F.explode(F.array(*map(F.lit, xs))).alias(name)
    p = events(spark, sf).select("unit", "frame", numbers((-12, -6, 0, 6, 12), "lag")).select("*", numbers((24, 12, 8), "period_h"))
    turn = F.col("period_h") * F.lit(HOUR)
    ph = 2 * F.pi() * ((F.col("frame") + F.col("lag") * F.lit(HOUR) * (F.col("unit") % 3)) % turn) / turn
    r = p.groupBy("unit", "period_h", "lag").agg(S.vector_strength(ph).alias("r"))
    n = events(spark, sf).groupBy("unit").agg((0.5 * F.sqrt(3.0 / F.count(F.lit(1)))).alias("null_r"))
    nulls = n.select("unit", "null_r", numbers((24, 12, 8), "period_h"))
    return S.phase_classes(r, nulls, ["unit", "period_h"], 12.0)


@query("sp15_phase_class", f"WITH {EVENTS}, {_STRENGTHS} SELECT unit, period_h, round(r0, 6) AS r0, round(r_edge, 6) AS r_edge, class FROM kc")
def sp15_phase_class(spark, sf):
    return _phase_classes(spark, sf).withColumns({"r0": F.round("r0", 6), "r_edge": F.round("r_edge", 6)})


@query(
    "sp16_shared_clock",
    f"""WITH {EVENTS}, {_STRENGTHS}, w AS (SELECT unit, (max(frame) - min(frame)) / {HOUR}::DOUBLE / count(*) AS period, count(*) AS n FROM ev GROUP BY 1),
    x AS (SELECT w.unit, any_value(period) AS period, any_value(period) * any_value(period) * 0.005 AS resolution, max(class) FILTER (WHERE period_h = 24) AS fundamental, count(*) FILTER (WHERE class = 'SUSTAINED') AS n_sustained,
        bool_or(class = 'SUSTAINED' AND period_h = 24) AS has_day, bool_or(class = 'LEAKAGE') AS has_leakage, bool_or(class = 'SUSTAINED' AND period_h < 24) AS has_harmonic FROM w JOIN kc ON kc.unit = w.unit GROUP BY w.unit),
    c AS (SELECT *, period / 6.0 AS ratio, least(abs(period / 6.0 - round(period / 6.0)), abs(period / 6.0 - round(2 * period / 6.0) / 2)) * 6 < greatest(resolution, 1.0) AS rate_clean FROM x)
    SELECT unit, n_sustained, round(ratio, 6) AS ratio, rate_clean, has_day, has_leakage, has_harmonic,
        CASE WHEN fundamental = 'SUSTAINED' AND rate_clean THEN 'SHARED CLOCK' WHEN n_sustained >= 1 AND rate_clean THEN 'LIKELY SHARED' WHEN n_sustained >= 1 OR rate_clean THEN 'SUGGESTIVE' ELSE 'NONE' END AS verdict FROM c""",
)
def sp16_shared_clock(spark, sf):
    w = events(spark, sf).groupBy("unit").agg(((F.max("frame") - F.min("frame")) / float(HOUR) / F.count(F.lit(1))).alias("period"))
    sustained = F.col("class") == "SUSTAINED"
    k = _phase_classes(spark, sf).groupBy("unit").agg(
        F.max(F.when(F.col("period_h") == 24, F.col("class"))).alias("fundamental"), F.count_if(sustained).alias("n_sustained"), F.bool_or(sustained & (F.col("period_h") == 24)).alias("has_day"),
        F.bool_or(F.col("class") == "LEAKAGE").alias("has_leakage"), F.bool_or(sustained & (F.col("period_h") < 24)).alias("has_harmonic"),
    )
    x = w.withColumn("resolution", F.col("period") * F.col("period") * 0.005).join(k, "unit")
    x = S.shared_clock(x, 6.0).withColumn("ratio", F.round("ratio", 6))
    return x.select("unit", "n_sustained", "ratio", "rate_clean", "has_day", "has_leakage", "has_harmonic", "verdict")


@query(
    "ag25_universal_peaks",
    f"""WITH {DAILY}, p AS (SELECT channel, round(value)::BIGINT AS f FROM dl WHERE value >= 80), n AS (SELECT channel, unnest([f - 1, f, f + 1]) AS f FROM p)
    SELECT f, count(DISTINCT channel) AS n_channels FROM n GROUP BY f HAVING count(DISTINCT channel) >= 10""",
)
def ag25_universal_peaks(spark, sf):
    f = F.round("value").cast("long")
    n = daily(spark, sf).where("value >= 80").select("channel", F.explode(F.array(f - 1, f, f + 1)).alias("f"))
    return n.groupBy("f").agg(F.countDistinct("channel").alias("n_channels")).where("n_channels >= 10")


@query(
    "sp12_event_triggered_average",
    f"""WITH {EVENTS}, m AS (SELECT (b.frame - a.frame) // {HOUR} AS lag_h, b.value FROM ev a JOIN ev b ON a.grp = b.grp AND b.frame - a.frame >= -{6 * HOUR} AND b.frame - a.frame < {6 * HOUR} WHERE a.kind = 'error' AND b.kind = 'view' AND b.frame >= a.frame)
    SELECT lag_h, count(*) AS n, round(avg(value), 6) AS mean FROM m GROUP BY lag_h""",
)
def sp12_event_triggered_average(spark, sf):
    ev = events(spark, sf)
    met = S.triggered_sums(ev.where("kind = 'error'"), ev.where("kind = 'view'"), "grp", "frame", "value", HOUR, 6)
    return met.select(F.col("lag").alias("lag_h"), "n", F.round("mean", 6).alias("mean"))


@query(
    "sp13_pairwise_correlation",
    f"""WITH {DAILY}, x AS (SELECT channel, day // 30 AS win, day, value FROM dl)
    SELECT a.channel AS a, b.channel AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM x a JOIN x b ON a.day = b.day AND a.channel < b.channel GROUP BY 1, 2 HAVING count(*) > 2""",
)
def sp13_pairwise_correlation(spark, sf):
    return S.pairwise_correlation(daily(spark, sf), "channel", "day", "value", 3).withColumn("r", F.round("r", 6))


_GRID = f"""{DAILY}, ds AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM dl), gd AS (SELECT c.channel, ds.day, coalesce(dl.value, 0)::DOUBLE AS value FROM (SELECT DISTINCT channel FROM dl) c CROSS JOIN ds LEFT JOIN dl ON dl.channel = c.channel AND dl.day = ds.day)"""


@query(
    "sp13_synthetic_emg",
    f"""WITH {_GRID}, lo AS (SELECT *, day // 90 AS win, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, avg(value) OVER g AS gm, stddev_pop(value) OVER g AS gs FROM gd WINDOW w AS (PARTITION BY channel, day // 90), g AS (PARTITION BY channel)),
    z AS (SELECT win, day, CASE WHEN s > 0 THEN (value - m) / s END AS z, CASE WHEN gs > 0 THEN (value - gm) / gs END AS g FROM lo),
    t AS (SELECT win, day, sum(z) AS a, sum(z * z) AS aa, count(z) AS n, sum(g) AS b, sum(g * g) AS bb, count(g) AS k FROM z GROUP BY 1, 2)
    SELECT win, round(avg(CASE WHEN n > 1 THEN (a * a - aa) / (n * (n - 1)) END), 6) AS per_window, round(avg(CASE WHEN k > 1 THEN (b * b - bb) / (k * (k - 1)) END), 6) AS "global" FROM t GROUP BY win""",
)
def sp13_synthetic_emg(spark, sf):
    d = daily(spark, sf)
    span = d.agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select(F.explode(F.col("days").cast("array<long>")).alias("frame"))
    x = d.select("channel", F.col("day").cast("long").alias("frame"), "value")  # the recording: every channel at every day, 0 where it has no row
    return S.synthetic_emg(x, 90, frames=span).select("win", F.round("per_window", 6).alias("per_window"), F.round("global", 6).alias("global"))


@query(
    "sp12_spatial_spectrum",
    f"""WITH {DAILY}, a AS (SELECT channel, avg(value) AS v FROM dl GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY channel) - 1 AS i, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM a),
    k AS (SELECT unnest(range(0, n // 2 + 1)) AS k FROM (SELECT count(*) AS n FROM a))
    SELECT k, round(CASE WHEN k > 0 THEN any_value(n) / k::DOUBLE END, 6) AS period, round(pow(sum(v * cos(2 * pi() * k * i / n)), 2) + pow(sum(v * sin(2 * pi() * k * i / n)), 2), 4) AS power FROM i, k GROUP BY k""",
)
def sp12_spatial_spectrum(spark, sf):
    a = daily(spark, sf).groupBy("channel").agg(F.avg("value").cast("double").alias("v"))
    return S.spatial_spectrum(a, "channel", "v").select(F.col("k").cast("long").alias("k"), F.round("period", 6).alias("period"), F.round("power", 4).alias("power"))

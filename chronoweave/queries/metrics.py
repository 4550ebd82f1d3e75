"""The metric suite on events (amplitudes, trains) and embeddings (clusters): labels are units, their parity the group."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import metrics as Q
from chronoweave.operators import quality as G
from chronoweave.operators import trains as T
from chronoweave.plans.registry import REGISTRY, query
from chronoweave.queries import trains as _trains  # noqa: F401
from chronoweave.sources.tables import DAY, EVENTS, HOUR, SECOND, TEMPLATES, events, templates

LEAST = 3
TIMES = [HOUR // 2, HOUR, 2 * HOUR, 4 * HOUR, 6 * HOUR, 12 * HOUR]


def _span(spark, sf):
    row = events(spark, sf).agg(F.min("frame").alias("a"), F.max("frame").alias("b")).first()  # two numbers
    return row.a or 0, (row.b or 0) - (row.a or 0) + 1


_SPAN = "sp AS (SELECT min(frame) AS a, max(frame) - min(frame) + 1 AS t FROM ev)"


@query(
    "ag22_rates",
    f"""WITH {EVENTS}, {_SPAN}, u AS (SELECT unit, count(*) AS num_spikes FROM ev GROUP BY 1), c AS (SELECT unit, (frame - a) // {DAY} AS bin, count(*) AS n FROM ev, sp GROUP BY 1, 2),
    g AS (SELECT u.unit, coalesce(c.n, 0) AS n FROM u CROSS JOIN (SELECT unnest(range(0, ((t + {DAY} - 1) // {DAY})::BIGINT)) AS bin FROM sp) b LEFT JOIN c ON c.unit = u.unit AND c.bin = b.bin)
    SELECT u.unit, any_value(num_spikes) AS num_spikes, round(any_value(num_spikes) / ((SELECT t FROM sp) / {SECOND}::DOUBLE), 6) AS firing_rate, round(avg((n > 0)::INT), 6) AS presence_ratio,
        round((quantile_cont(n, 0.95) - quantile_cont(n, 0.05)) / {DAY / SECOND}, 6) AS firing_range FROM u JOIN g ON g.unit = u.unit GROUP BY u.unit""",
)
def ag22_rates(spark, sf):
    start, frames = _span(spark, sf)
    return Q.rounded(Q.rates(events(spark, sf), start, frames, SECOND, DAY))


@query(
    "ag22_interval_violations",
    f"""WITH {EVENTS}, {_SPAN}, d AS (SELECT unit, frame - lag(frame) OVER (PARTITION BY unit ORDER BY frame) AS d FROM ev)
    SELECT unit, count(*) FILTER (WHERE d < {HOUR}) AS isi_violations_count, round(count(*) FILTER (WHERE d < {HOUR}) * (SELECT t FROM sp)::DOUBLE / (2.0::DOUBLE * {HOUR} * count(*) * count(*)), 6) AS isi_violations_ratio FROM d GROUP BY unit""",
)
def ag22_interval_violations(spark, sf):
    return Q.rounded(Q.interval_violations(events(spark, sf), _span(spark, sf)[1], HOUR))


_SLIDING = f"""t AS (SELECT unnest({TIMES}) AS t0), n AS (SELECT unit, count(*) AS n FROM ev GROUP BY 1),
    s AS (SELECT n.unit, n.n, t.t0, (SELECT count(*) FROM ev x JOIN ev y ON x.unit = y.unit AND y.frame > x.frame AND y.frame - x.frame <= t.t0 WHERE x.unit = n.unit) AS seen FROM n, t),
    c AS (SELECT unit, seen, i / 200.0::DOUBLE AS c, 2.0::DOUBLE * n * t0 * (i / 200.0::DOUBLE) * n / sp.t AS m FROM s, sp, (SELECT unnest(range(1, 71)) AS i)),
    p AS (SELECT unit, c, (SELECT sum(exp(-m + k * ln(m) - lgamma(k + 1))) FROM (SELECT unnest(range(0, seen + 1)) AS k)) AS p FROM c),
    sl AS (SELECT unit, min(c) FILTER (WHERE 1 - p > 0.9) AS sliding_rp_violation FROM p GROUP BY unit)"""


@query("ag22_sliding_rp", f"WITH {EVENTS}, {_SPAN}, {_SLIDING} SELECT * FROM sl")
def ag22_sliding_rp(spark, sf):
    return Q.sliding_violations(events(spark, sf), _span(spark, sf)[1], TIMES)


@query(
    "ag22_synchrony",
    f"""WITH {EVENTS}, b AS (SELECT grp, frame // {HOUR} AS bin, unit, count(*) AS n FROM ev GROUP BY 1, 2, 3), u AS (SELECT *, count(*) OVER (PARTITION BY grp, bin) AS k FROM b)
    SELECT unit, round(sum(CASE WHEN k >= 2 THEN n ELSE 0 END) / sum(n), 6) AS sync_spike_2, round(sum(CASE WHEN k >= 4 THEN n ELSE 0 END) / sum(n), 6) AS sync_spike_4, round(sum(CASE WHEN k >= 8 THEN n ELSE 0 END) / sum(n), 6) AS sync_spike_8 FROM u GROUP BY unit""",
)
def ag22_synchrony(spark, sf):
    return Q.rounded(Q.synchrony(events(spark, sf), HOUR))


_NOISE = "md AS (SELECT grp, quantile_cont(value, 0.5) AS c FROM ev GROUP BY 1), ns AS (SELECT ev.grp, quantile_cont(abs(value - c), 0.5) / 0.6745::DOUBLE AS noise FROM ev JOIN md ON md.grp = ev.grp GROUP BY 1)"


@query(
    "ag22_amplitudes",
    f"""WITH {EVENTS}, {_SPAN}, {_NOISE}, st AS (SELECT grp, unit, value, value - lag(value) OVER (PARTITION BY unit ORDER BY frame, value) AS d FROM ev),
    o AS (SELECT st.grp, unit, quantile_cont(value, 0.5) AS amplitude_median, stddev_pop(d) / sqrt(2) AS sd FROM st GROUP BY 1, 2),
    b AS (SELECT unit, (frame - a) // {7 * DAY} AS bin, stddev_pop(value) / abs(avg(value)) AS cv FROM ev, sp GROUP BY 1, 2 HAVING count(*) >= {LEAST} AND avg(value) <> 0),
    v AS (SELECT unit, quantile_cont(cv, 0.5) AS m, quantile_cont(cv, 0.95) - quantile_cont(cv, 0.05) AS r FROM b GROUP BY 1)
    SELECT o.unit, round(amplitude_median, 6) AS amplitude_median, round(abs(amplitude_median) / noise, 6) AS snr, round(sd / noise, 6) AS sd_ratio, round(m, 6) AS amplitude_cv_median, round(r, 6) AS amplitude_cv_range
    FROM o JOIN ns ON ns.grp = o.grp LEFT JOIN v ON v.unit = o.unit""",
)
def ag22_amplitudes(spark, sf):
    return Q.rounded(Q.amplitudes(events(spark, sf), _span(spark, sf)[0], 7 * DAY, LEAST))


@query(
    "ag22_drift",
    f"""WITH {EVENTS}, {_SPAN}, w AS (SELECT unit, quantile_cont(value, 0.5) AS c FROM ev GROUP BY 1), p AS (SELECT unit, (frame - a) // {7 * DAY} AS bin, quantile_cont(value, 0.5) AS m FROM ev, sp GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
    d AS (SELECT p.unit, m - c AS d FROM p JOIN w ON w.unit = p.unit), e AS (SELECT unit, quantile_cont(d, 0.5) AS e FROM d GROUP BY 1)
    SELECT d.unit, round(max(d) - min(d), 6) AS drift_ptp, round(stddev_pop(d), 6) AS drift_std, round(quantile_cont(abs(d - e), 0.5), 6) AS drift_mad FROM d JOIN e ON e.unit = d.unit GROUP BY d.unit""",
)
def ag22_drift(spark, sf):
    return Q.rounded(Q.drift(events(spark, sf), _span(spark, sf)[0], 7 * DAY, LEAST))


def _hist_sql(bins: int) -> str:
    return f"""mm AS (SELECT unit, min(value) AS lo, (max(value) - min(value)) / {bins} AS width FROM ev GROUP BY 1 HAVING max(value) > min(value)),
    hn AS (SELECT ev.unit, least(floor((value - lo) / width)::BIGINT, {bins - 1}) AS bin, count(*) AS n FROM ev JOIN mm ON mm.unit = ev.unit GROUP BY 1, 2),
    hi AS (SELECT mm.unit, b.bin, coalesce(n, 0) AS n FROM mm CROSS JOIN (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN hn ON hn.unit = mm.unit AND hn.bin = b.bin)"""


@query(
    "ag22_amplitude_cutoff",
    f"""WITH {EVENTS}, {_hist_sql(Q.CUTOFF_BINS)}, k AS (SELECT i, exp(-0.5 * pow(i / {Q.SMOOTH}.0::DOUBLE, 2)) AS w FROM (SELECT unnest(range({-Q.REACH}, {Q.REACH + 1})) AS i)), kn AS (SELECT i, w / (SELECT sum(w) FROM k) AS w FROM k),
    hs AS (SELECT unit, bin, n / (sum(n) OVER (PARTITION BY unit))::DOUBLE AS p FROM hi),
    sm AS (SELECT a.unit, a.bin, sum(b.p * kn.w) AS p FROM hs a CROSS JOIN kn JOIN hs b ON b.unit = a.unit AND b.bin = a.bin - kn.i GROUP BY 1, 2),
    tp AS (SELECT unit, arg_max(bin, (round(p, 12), -bin)) AS top, max(p) FILTER (WHERE bin = 0) AS p0 FROM sm GROUP BY 1),
    en AS (SELECT sm.unit, arg_min(bin, (round(abs(p - p0), 12), bin)) AS e FROM sm JOIN tp ON tp.unit = sm.unit WHERE bin >= top GROUP BY 1)
    SELECT sm.unit, round(least(0.5, sum(p)), 5) AS amplitude_cutoff FROM sm JOIN en ON en.unit = sm.unit WHERE bin >= e GROUP BY sm.unit""",
)
def ag22_amplitude_cutoff(spark, sf):
    return Q.rounded(Q.amplitude_cutoff(events(spark, sf)), 5)


@query(
    "ag22_noise_cutoff",
    f"""WITH {EVENTS}, {_hist_sql(Q.NOISE_BINS)}
    SELECT unit, round(CASE WHEN stddev_pop(n) FILTER (WHERE bin >= 75) > 0 THEN (avg(n) FILTER (WHERE bin < 10) - avg(n) FILTER (WHERE bin >= 75)) / stddev_pop(n) FILTER (WHERE bin >= 75) END, 6) AS noise_cutoff,
        round(avg(n) FILTER (WHERE bin < 10) / max(n), 6) AS noise_ratio FROM hi GROUP BY unit""",
)
def ag22_noise_cutoff(spark, sf):
    return Q.rounded(Q.noise_cutoff(events(spark, sf)))


def _snippets(spark, sf):
    pair = F.array(F.get("wf", F.lit(0)), F.get("wf", F.lit(1)))
    return templates(spark, sf).select((F.col("grp") % 2).alias("grp"), F.col("grp").alias("unit"), F.col("unit").alias("spike"), pair.alias("features"))


_CLUSTERS = f"{TEMPLATES}, sn AS (SELECT grp % 2 AS grp, grp AS unit, unit AS spike, wf[1] AS x, wf[2] AS y FROM tp)"


@query(
    "ag22_d_prime",
    f"""WITH {_CLUSTERS}, pr AS (SELECT u.grp, u.unit, s.unit = u.unit AS own, x, y FROM (SELECT DISTINCT grp, unit FROM sn) u JOIN sn s ON s.grp = u.grp),
    m AS (SELECT grp, unit, own, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM pr GROUP BY 1, 2, 3),
    j AS (SELECT a.grp, a.unit, a.mx - b.mx AS dx, a.my - b.my AS dy, a.vx AS ax, a.vy AS ay, a.vxy AS az, b.vx AS bx, b.vy AS by_, b.vxy AS bz,
        a.vx * (a.n - 1) + b.vx * (b.n - 1) AS sx, a.vy * (a.n - 1) + b.vy * (b.n - 1) AS sy, a.vxy * (a.n - 1) + b.vxy * (b.n - 1) AS sz FROM m a JOIN m b ON a.grp = b.grp AND a.unit = b.unit AND a.own AND NOT b.own WHERE a.n > 1 AND b.n > 1),
    w AS (SELECT *, (sy * dx - sz * dy) / (sx * sy - sz * sz) AS wx, (sx * dy - sz * dx) / (sx * sy - sz * sz) AS wy FROM j)
    SELECT grp, unit, round((wx * dx + wy * dy) / sqrt(0.5 * (wx * wx * (ax + bx) + 2 * wx * wy * (az + bz) + wy * wy * (ay + by_))), 6) AS d_prime FROM w""",
)
def ag22_d_prime(spark, sf):
    return Q.rounded(Q.d_prime(_snippets(spark, sf), 2))


@query(
    "ag22_mahalanobis",
    f"""WITH {_CLUSTERS}, m AS (SELECT grp, unit, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vz FROM sn GROUP BY 1, 2 HAVING count(*) > 2),
    d AS (SELECT m.grp, m.unit, n, (vy * (x - mx) * (x - mx) - 2 * vz * (x - mx) * (y - my) + vx * (y - my) * (y - my)) / (vx * vy - vz * vz) AS d FROM m JOIN sn s ON s.grp = m.grp AND s.unit <> m.unit),
    k AS (SELECT *, row_number() OVER (PARTITION BY grp, unit ORDER BY d) AS k FROM d)
    SELECT grp, unit, round(max(d) FILTER (WHERE k <= n), 6) AS isolation_distance, round(sum(exp(-d / 2)) / max(n), 6) AS l_ratio FROM k GROUP BY 1, 2""",
)
def ag22_mahalanobis(spark, sf):
    return Q.rounded(Q.mahalanobis(_snippets(spark, sf), 2))


@query(
    "ag22_silhouette",
    f"""WITH {_CLUSTERS}, c AS (SELECT grp, unit, avg(x) AS cx, avg(y) AS cy FROM sn GROUP BY 1, 2),
    d AS (SELECT s.grp, s.unit, s.spike, c.unit = s.unit AS own, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM sn s JOIN c ON c.grp = s.grp),
    e AS (SELECT grp, unit, spike, max(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b FROM d GROUP BY 1, 2, 3)
    SELECT grp, unit, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM e WHERE b IS NOT NULL AND greatest(a, b) > 0 GROUP BY 1, 2""",
)
def ag22_silhouette(spark, sf):
    return Q.rounded(Q.silhouette(_snippets(spark, sf), 2))


@query(
    "ag22_nearest_neighbour",
    f"""WITH {_CLUSTERS}, k AS (SELECT a.grp, a.unit, a.spike, b.unit AS other, row_number() OVER (PARTITION BY a.spike ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.spike) AS k FROM sn a JOIN sn b ON a.grp = b.grp AND a.spike <> b.spike),
    n AS (SELECT grp, unit, other, count(*) AS n FROM k WHERE k <= 4 GROUP BY 1, 2, 3), o AS (SELECT grp, unit, sum(n) AS own, sum(CASE WHEN other = unit THEN n ELSE 0 END) AS hit FROM n GROUP BY 1, 2),
    ms AS (SELECT grp, other AS unit, sum(n) AS miss FROM n WHERE other <> unit GROUP BY 1, 2), al AS (SELECT grp, sum(n) AS total FROM n GROUP BY 1)
    SELECT o.grp, o.unit, round(hit / own, 6) AS nn_hit_rate, round(CASE WHEN total > own THEN coalesce(miss, 0) / (total - own) END, 6) AS nn_miss_rate FROM o JOIN al ON al.grp = o.grp LEFT JOIN ms ON ms.grp = o.grp AND ms.unit = o.unit""",
)
def ag22_nearest_neighbour(spark, sf):
    return Q.rounded(Q.nearest_neighbours(_snippets(spark, sf)))


def _suite(spark, sf):
    ev, (start, frames) = events(spark, sf), _span(spark, sf)
    parts = [
        Q.rates(ev, start, frames, SECOND, DAY), Q.interval_violations(ev, frames, HOUR), T.rp_contamination(ev, frames, HOUR).select("unit", F.col("contamination").alias("rp_contamination")),
        Q.sliding_violations(ev, frames, TIMES), Q.synchrony(ev, HOUR), Q.amplitudes(ev, start, 7 * DAY, LEAST), Q.drift(ev, start, 7 * DAY, LEAST), Q.amplitude_cutoff(ev), Q.noise_cutoff(ev),
    ]
    return Q.suite(parts, ev.select("unit").distinct())


#: The SQL of each family, side by side; :mod:`chronoweave.queries.trains` has the contamination's.
_PARTS = ("ag22_rates", "ag22_interval_violations", "ag5_rp_contamination", "ag22_sliding_rp", "ag22_synchrony", "ag22_amplitudes", "ag22_drift", "ag22_amplitude_cutoff", "ag22_noise_cutoff")
_JOINED = " ".join(f"LEFT JOIN ({REGISTRY.sql[p]}) p{i} ON p{i}.unit = u.unit" for i, p in enumerate(_PARTS))
_COLUMNS = ", ".join("p2.contamination AS rp_contamination" if p == "ag5_rp_contamination" else f"p{i}.* EXCLUDE (unit)" for i, p in enumerate(_PARTS))


@query("ag22_suite", f"SELECT u.unit, {_COLUMNS} FROM (SELECT DISTINCT user_id AS unit FROM events) u {_JOINED}")
def ag22_suite(spark, sf):
    return Q.rounded(_suite(spark, sf).withColumn("amplitude_cutoff", F.round("amplitude_cutoff", 5)))


TIERS = {"strict": (0.22, 0.15, 2.0), "conservative": (0.3, 0.2, 1.9), "lenient": (0.4, 0.3, 1.8)}
_TIER = " ".join(f"WHEN (ratio <= {a} OR coalesce(sliding_rp_violation <= {b}, false)) AND rate >= {f} THEN '{name}'" for name, (a, b, f) in TIERS.items())


@query(
    "prj8_tier_of_suite",
    f"""WITH {EVENTS}, {_SPAN}, {_SLIDING}, d AS (SELECT unit, frame - lag(frame) OVER (PARTITION BY unit ORDER BY frame) AS d FROM ev),
    v AS (SELECT unit, count(*) AS n, count(*) FILTER (WHERE d < {HOUR}) * (SELECT t FROM sp)::DOUBLE / (2.0::DOUBLE * {HOUR} * count(*) * count(*)) AS ratio FROM d GROUP BY unit),
    f AS (SELECT v.unit, n / ((SELECT t FROM sp) / {DAY}::DOUBLE) AS rate, ratio, sliding_rp_violation FROM v JOIN sl ON sl.unit = v.unit)
    SELECT unit, CASE {_TIER} ELSE 'none' END AS tier FROM f""",
)
def prj8_tier_of_suite(spark, sf):
    s = _suite(spark, sf)
    return s.select("unit", G.tier(F.col("isi_violations_ratio"), F.col("sliding_rp_violation"), F.col("firing_rate") * (DAY / SECOND), TIERS).alias("tier"))

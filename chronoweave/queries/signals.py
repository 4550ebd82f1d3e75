"""Signal, matching and learning operators; filters and spectra in SQL are sums over the same fixed taps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators import carry as C
from chronoweave.operators import learning as L
from chronoweave.operators import metrics as Q
from chronoweave.operators import recursive as R
from chronoweave.operators import signal as G
from chronoweave.operators import sorting as S
from chronoweave.plans.registry import query
from chronoweave.plans.storage import own_path
from chronoweave.sources.blocks import read_blocks, write_blocks
from chronoweave.sources.tables import EVENTS, events, table, templates

#: The events of a group, in order, are the samples of a channel.
FS = 100.0
BLOCK = 4096


def trace(spark, sf):
    place = F.row_number().over(Window.partitionBy("grp").orderBy("frame", "event_id")) - 1
    x = events(spark, sf).select("grp", F.col("grp").alias("channel"), place.cast("long").alias("frame"), "value")
    return x.withColumn("grp", F.floor(F.col("channel") / 4))


_TRACE = f"{EVENTS}, tr AS (SELECT grp // 4 AS grp, grp AS channel, row_number() OVER (PARTITION BY grp ORDER BY frame, event_id) - 1 AS frame, value FROM ev)"


def _numbers(x: np.ndarray) -> str:
    return "[" + ", ".join(f"{v!r}" for v in np.asarray(x, float).tolist()) + "]::DOUBLE[]"


def _filtered(out: str, source: str, taps: np.ndarray, step: int = 1) -> str:
    """Rows of ``source`` convolved with the taps, ends padded with the end values, every ``step`` frames."""
    half = len(taps) // 2
    pad = lambda at: f"list_transform(range(0, {half}), lambda z: v[{at}])"
    return f"""{out}_l AS (SELECT grp, channel, list(value ORDER BY frame) AS v FROM {source} GROUP BY 1, 2), {out}_p AS (SELECT grp, channel, len(v) AS n, {pad("1")} || v || {pad("len(v)")} AS p FROM {out}_l),
    {out} AS (SELECT grp, channel, unnest(range(0, n, {step})) // {step} AS frame, unnest(list_transform(range(0, n, {step}), lambda i: list_dot_product(p[i + 1:i + {len(taps)}], {_numbers(taps[::-1])}))) AS value FROM {out}_p)"""


_BAND = G.bandpass_taps(0.05, 0.3, 64)
_DECIMATED = f"{_TRACE}, {_filtered('d1', 'tr', G.lowpass_taps(0.4 / 2, 32), 2)}, {_filtered('d2', 'd1', G.lowpass_taps(0.4 / 5, 80), 5)}"


@query("sp1_decimate", f"WITH {_DECIMATED} SELECT grp, channel, frame, round(value, 6) AS value FROM d2")
def sp1_decimate(spark, sf):
    return Q.rounded(G.downsample(trace(spark, sf), 100, (50, 10), BLOCK))


@query(
    "sp2_bandpass_reference",
    f"WITH {_TRACE}, {_filtered('bp', 'tr', _BAND)}, md AS (SELECT frame, quantile_cont(value, 0.5) AS m FROM bp GROUP BY 1) SELECT frame, grp, channel, round(value - m, 6) AS value FROM bp JOIN md USING (frame)",
)
def sp2_bandpass_reference(spark, sf):
    return Q.rounded(G.common_reference(G.bandpass(trace(spark, sf), 0.05, 0.3, block=BLOCK), "global"))


@query(
    "sp3_band_power",
    f"""WITH {_TRACE}, {_filtered('bp', 'tr', G.bandpass_taps(0.02, 0.1, 64))}, {_filtered('hb', 'bp', G.hilbert_taps(64))}
    SELECT bp.grp, frame, round(avg(bp.value * bp.value + hb.value * hb.value), 4) AS power FROM bp JOIN hb USING (channel, frame) GROUP BY 1, 2""",
)
def sp3_band_power(spark, sf):
    return Q.rounded(G.band_power(trace(spark, sf), 0.02, 0.1, block=BLOCK), 4)


def _spectra(size: int, step: int, window: np.ndarray) -> str:
    """``ps``: (grp, channel, win, freq, psd) of all whole windows."""
    scale = 1.0 / (FS * float((window**2).sum()))
    return f"""wl AS (SELECT grp, channel, list(value ORDER BY frame) AS v FROM tr GROUP BY 1, 2), wn AS (SELECT grp, channel, v, unnest(range(0, (len(v) - {size}) // {step} + 1)) AS win FROM wl WHERE len(v) >= {size}),
    wv AS (SELECT grp, channel, win, v[win * {step} + 1:win * {step} + {size}] AS v FROM wn), wc AS (SELECT grp, channel, win, list_transform(v, lambda y: y - list_avg(v)) AS v FROM wv),
    kf AS (SELECT k, list_transform(range(0, {size}), lambda j: ({_numbers(window)})[j + 1] * cos(2 * pi() * k * j / {size})) AS c, list_transform(range(0, {size}), lambda j: ({_numbers(window)})[j + 1] * sin(2 * pi() * k * j / {size})) AS s FROM (SELECT unnest(range(0, {size // 2 + 1})) AS k)),
    ps AS (SELECT grp, channel, win, k * {FS / size!r}::DOUBLE AS freq, (pow(list_dot_product(v, c), 2) + pow(list_dot_product(v, s), 2)) * {scale!r}::DOUBLE * CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END AS psd FROM wc, kf)"""


BANDS = {"delta": (0.5, 4), "vlad": (3, 7), "theta": (6, 10), "sigma": (9, 15)}
_BANDS = ", ".join(f"('{name}', {a}, {b})" for name, (a, b) in BANDS.items())


@query(
    "sp4_stft_bands",
    f"""WITH {_TRACE}, {_spectra(200, 200, G.slepian(200))}, m AS (SELECT grp, win, freq, avg(psd) AS psd FROM ps GROUP BY 1, 2, 3)
    SELECT grp, win, band, round(sum(psd), 4) AS power FROM m JOIN (VALUES {_BANDS}) b(band, lo, hi) ON freq BETWEEN lo AND hi GROUP BY 1, 2, 3""",
)
def sp4_stft_bands(spark, sf):
    return Q.rounded(G.stft_bands(trace(spark, sf), FS, 200, BANDS), 4)


@query("sp6_welch", f"WITH {_TRACE}, {_spectra(128, 64, np.hanning(129)[:-1])} SELECT grp, channel, freq, round(avg(psd), 4) AS psd FROM ps GROUP BY 1, 2, 3")
def sp6_welch(spark, sf):
    return G.welch(trace(spark, sf), FS, 128).withColumn("psd", F.round("psd", 4))


@query("sp7_prominent_peaks")
def sp7_prominent_peaks(spark, sf):
    return G.prominent_peaks(G.welch(trace(spark, sf), FS, 128), 1.0)


@query("sp8_harmonic_groups")
def sp8_harmonic_groups(spark, sf):
    return G.harmonic_groups(G.prominent_peaks(G.welch(trace(spark, sf), FS, 128), 1.0))


@query("sp9_transients")
def sp9_transients(spark, sf):
    return G.transients(trace(spark, sf), 0.1, 5, 3.0, block=BLOCK)


@query(
    "sp10_exclusive_peaks",
    f"""WITH {_TRACE}, md AS (SELECT channel, quantile_cont(-value, 0.5) AS c FROM tr GROUP BY 1), nl AS (SELECT tr.channel, quantile_cont(abs(-value - c), 0.5) / 0.6745::DOUBLE AS noise FROM tr JOIN md ON md.channel = tr.channel GROUP BY 1),
    dp AS (SELECT grp, tr.channel, frame, value / noise AS amp FROM tr JOIN nl ON nl.channel = tr.channel WHERE noise > 0 AND value / noise >= 3)
    SELECT grp, frame, round(amp, 6) AS amp_mad FROM dp a WHERE NOT EXISTS (SELECT 1 FROM dp b WHERE b.grp = a.grp AND abs(b.frame - a.frame) <= 5 AND (b.amp > a.amp OR (b.amp = a.amp AND (b.frame < a.frame OR (b.frame = a.frame AND b.channel < a.channel)))))""",
)
def sp10_exclusive_peaks(spark, sf):
    return Q.rounded(G.exclusive_peaks(trace(spark, sf).withColumn("value", -F.col("value")), 3.0, 5, BLOCK))


@query(
    "sp11_narrowband_phase",
    f"WITH {_TRACE}, {_filtered('bp', 'tr', G.bandpass_taps(0.08, 0.12, 64))}, {_filtered('hb', 'bp', G.hilbert_taps(64))} SELECT bp.grp, channel, frame, round(atan2(hb.value, bp.value), 6) AS value FROM bp JOIN hb USING (channel, frame)",
)
def sp11_narrowband_phase(spark, sf):
    return Q.rounded(G.phase(trace(spark, sf), 0.08, 0.12, block=BLOCK))


@query(
    "sp14_inband_error",
    f"""WITH {_TRACE}, ro AS (SELECT grp, channel, frame, round(value)::DOUBLE AS value FROM tr), {_filtered('bp', 'tr', _BAND)}, {_filtered('lo', 'ro', _BAND)}
    SELECT channel, round(stddev_pop(bp.value - lo.value), 6) AS rms, round(quantile_cont(abs(bp.value), 0.5) / 0.6745::DOUBLE, 6) AS floor, round(stddev_pop(bp.value - lo.value) / (quantile_cont(abs(bp.value), 0.5) / 0.6745::DOUBLE), 6) AS share FROM bp JOIN lo USING (channel, frame) GROUP BY channel""",
)
def sp14_inband_error(spark, sf):
    x = trace(spark, sf)
    return Q.rounded(G.inband_error(x, x.withColumn("value", F.round("value")), 0.05, 0.3, BLOCK))


def _windows(spark, sf):
    t = templates(spark, sf).where("unit % 10 <> 0")
    return t.select("grp", F.floor(F.col("unit") / 100).alias("win"), F.col("unit").alias("spike"), "wf")


def _bank(spark, sf):
    return templates(spark, sf).where("unit % 10 = 0").select("grp", "unit", "wf")


#: Windows of a fold, samples of a template (a bump on each channel of a group), and energy from which one is an event.
WINDOWS, LENGTH, ENERGY = 3, 8, 30000.0


def frames_of(t):
    """Frames of a trace that starts at 0."""
    return (t.agg(F.max("frame")).first()[0] or 0) + 1  # one number


def bumps(spark, sf):
    """A bank for the trace: a unit for each channel of a group."""
    bump = [float(v) for v in 100 * np.exp(-((np.arange(LENGTH) - 3.0) ** 2) / 2)]
    wf = F.array(*[F.when(F.col("unit") == c, F.lit(v)).otherwise(F.lit(0.0)) for v in bump for c in range(4)])
    return trace(spark, sf).select("grp").distinct().crossJoin(spark.range(4).withColumnRenamed("id", "unit")).select("grp", "unit", wf.alias("wf"))  # 4 rows a group


def fold(spark, sf, **more):
    free = {"amplitude_variance": float("inf"), "jitter_factor": 1, "refractory_period_frames": 4}
    t = trace(spark, sf)
    return C.carry_forward(t, bumps(spark, sf), -(-frames_of(t) // WINDOWS), LENGTH, 4, threshold=ENERGY, gate=0.6, least=5, cap=0.5, shifts=1, block=200, **free, **more)


def _starts(part):
    """The sorter's trains, at the frames where templates start."""
    return S.sort_trace(part.withColumn("value", -F.col("value")), 3.0, 5, 3, 5, 4, block=BLOCK).withColumn("frame", F.col("frame") - 3)


@query("it2_carry_forward")
def it2_carry_forward(spark, sf):
    return fold(spark, sf).events.select("grp", "win", "frame", "unit", F.round("scale", 6).alias("scale"), F.round("r", 6).alias("r"))


@query("it2_match_counts")
def it2_match_counts(spark, sf):
    return C.window_counts(fold(spark, sf).events)


@query("it3_carry_forward_reseed")
def it3_carry_forward_reseed(spark, sf):
    found = fold(spark, sf, every=2, sorter=_starts, born=(10, 0.5), new_below=0.99)
    births = found.births.select("grp", "win", "unit", "n", F.round("likeness", 6).alias("likeness"))
    return C.window_counts(found.events).join(births.drop("n"), ["grp", "win", "unit"], "full")


@query("ex1_cluster_groups")
def ex1_cluster_groups(spark, sf):
    return S.cluster(_windows(spark, sf))


@query(
    "ex1_snippets",
    f"""WITH {_TRACE}, md AS (SELECT channel, quantile_cont(value, 0.5) AS c FROM tr GROUP BY 1), nl AS (SELECT tr.channel, quantile_cont(abs(value - c), 0.5) / 0.6745::DOUBLE AS noise FROM tr JOIN md ON md.channel = tr.channel GROUP BY 1),
    dp AS (SELECT grp, tr.channel, frame, -value / noise AS amp FROM (SELECT grp, channel, frame, -value AS value FROM tr) tr JOIN nl ON nl.channel = tr.channel WHERE noise > 0 AND -value / noise >= 3),
    pk AS (SELECT grp, frame FROM dp a WHERE NOT EXISTS (SELECT 1 FROM dp b WHERE b.grp = a.grp AND abs(b.frame - a.frame) <= 5 AND (b.amp > a.amp OR (b.amp = a.amp AND (b.frame < a.frame OR (b.frame = a.frame AND b.channel < a.channel))))))
    SELECT pk.grp, pk.frame AS spike, count(*) AS n, round(sum(-value * (1 + channel % 4)), 5) AS total FROM pk JOIN tr ON tr.grp = pk.grp AND tr.frame >= pk.frame - 4 AND tr.frame < pk.frame + 8 GROUP BY 1, 2 HAVING count(*) = 48""",
)
def ex1_snippets(spark, sf):
    x = trace(spark, sf).withColumn("value", -F.col("value"))
    weight = F.array(*[F.lit(float(1 + c)) for _ in range(12) for c in range(4)])
    total = F.aggregate(F.zip_with("wf", weight, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
    s = S.snippets(x, G.exclusive_peaks(x, 3.0, 5, BLOCK), 4, 8, 4)
    return s.select("grp", "spike", F.size("wf").cast("long").alias("n"), F.round(total, 5).alias("total"))


_WHOLE = f"""WITH {_TRACE}, mx AS (SELECT grp, min(m) AS m FROM (SELECT grp, channel, max(frame) AS m FROM tr GROUP BY 1, 2) GROUP BY 1), wt AS (SELECT tr.* FROM tr JOIN mx ON mx.grp = tr.grp WHERE frame <= m)"""


def _whole(spark, sf):
    """The trace as far as all channels of a group go."""
    t = trace(spark, sf)
    ends = t.groupBy("grp", "channel").agg(F.max("frame").alias("m")).groupBy("grp").agg(F.min("m").alias("m"))
    return t.join(ends, "grp").where("frame <= m").drop("m")


@query("ex1_covariance", f"{_WHOLE} SELECT a.grp, a.channel AS i, b.channel AS j, round(covar_pop(a.value, b.value), 5) AS cov FROM wt a JOIN wt b ON a.grp = b.grp AND a.frame = b.frame GROUP BY 1, 2, 3")
def ex1_covariance(spark, sf):
    return S.covariance(_whole(spark, sf)).withColumn("cov", F.round("cov", 5))


@query("ex1_whitened", f"{_WHOLE}, c AS (SELECT DISTINCT grp, channel FROM wt) SELECT a.grp, a.channel AS i, b.channel AS j, CASE WHEN a.channel = b.channel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov FROM c a JOIN c b ON a.grp = b.grp")
def ex1_whitened(spark, sf):
    t = _whole(spark, sf)
    white = S.whitened(t, S.whitening(S.covariance(t)))
    return S.covariance(white).withColumn("cov", F.round("cov", 6) + 0.0)  # no negative zeros


@query("ex1_sort_trace")
def ex1_sort_trace(spark, sf):
    return S.sort_trace(trace(spark, sf).withColumn("value", -F.col("value")), 3.0, 5, 4, 8, 4, block=BLOCK)


def _unit_features(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.max("l_extendedprice").alias("e")
    )
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_totalprice") > 150000).cast("int").alias("label"))
    m = m.withColumn("d", F.when(F.col("unit") % 17 != 0, F.round("d", 2))).withColumn("n", F.col("n").cast("double"))
    return m.join(o, "unit")


FEATURES = ["n", "q", "d", "e"]


@query("ml3_label_units")
def ml3_label_units(spark, sf):
    # a fifth of the units, by a hash, is scored by what the others taught
    x = _unit_features(spark, sf)
    held = F.pmod(F.xxhash64("unit"), F.lit(5)) == 0
    return L.score(L.train(x.where(~held), FEATURES, "label"), x.where(held)).select("unit", F.round("p", 6).alias("p"), "predicted")


@query("ml2_cross_validation")
def ml2_cross_validation(spark, sf):
    return L.cross_validate(_unit_features(spark, sf), FEATURES, "label", "unit")


STEP = 0.25


@query("snk1_trace_blocks", f"WITH {_TRACE} SELECT grp, channel, count(*) AS n, min(frame) AS first, max(frame) AS last, sum(round(value / {STEP}))::BIGINT AS steps FROM tr WHERE channel % 2 = 1 AND frame >= 100 GROUP BY 1, 2")
def snk1_trace_blocks(spark, sf):
    # half of the channels and all but the first frames, so that the reader has something to spare
    path = own_path(spark, "trace-blocks")
    write_blocks(trace(spark, sf), path, 256, STEP)
    x = read_blocks(spark, path).where(F.col("channel").isin(1, 3, 5, 7) & (F.col("frame") >= 100))
    steps = F.sum(F.round(F.col("value") / STEP)).cast("long").alias("steps")
    return x.groupBy("grp", F.col("channel").cast("long").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), steps)


_SECTIONS = R.butterworth(2, 0.05, 0.3)


def _stepped(x: str, z: list[str]) -> tuple[str, list[str]]:
    """SQL of a filter's output and next state."""
    then = []
    for i, (b0, b1, b2, a1, a2) in enumerate(_SECTIONS.tolist()):
        y = f"({b0!r}::DOUBLE * {x} + {z[2 * i]})"
        then += [f"{b1!r}::DOUBLE * {x} - {a1!r}::DOUBLE * {y} + {z[2 * i + 1]}", f"{b2!r}::DOUBLE * {x} - {a2!r}::DOUBLE * {y}"]
        x = y
    return x, then


def _recursive_sql(out: str, source: str, step: int) -> str:
    """Rows of ``source`` (channel, frame, value) filtered in one direction, a sample at a time."""
    settled = R.Cascade(_SECTIONS).settled.tolist()
    names = [f"z{i}" for i in range(len(settled))]
    select = lambda x, z: ", ".join(f"{e} AS {n}" for e, n in zip((lambda y, then: [y, *then])(*_stepped(x, z)), ["value", *names], strict=True))
    first = "min" if step > 0 else "max"
    return f"""{out} AS (SELECT e.channel, e.frame, {select("e.value", [f"({v!r}::DOUBLE * e.value)" for v in settled])} FROM {source} e JOIN (SELECT channel, {first}(frame) AS frame FROM {source} GROUP BY 1) s ON s.channel = e.channel AND s.frame = e.frame
    UNION ALL SELECT e.channel, e.frame, {select("e.value", [f"p.{n}" for n in names])} FROM {out} p JOIN {source} e ON e.channel = p.channel AND e.frame = p.frame + {step})"""


_PAD = 3 * (2 * len(_SECTIONS) + 1)


@query(
    "sp2_recursive_bandpass",
    f"""WITH RECURSIVE {_TRACE}, en AS (SELECT channel, max(frame) AS z, arg_min(value, frame) AS x0, arg_max(value, frame) AS x1 FROM tr GROUP BY 1),
    ex AS (SELECT channel, frame, value FROM tr UNION ALL SELECT tr.channel, -frame, 2 * x0 - value FROM tr JOIN en ON en.channel = tr.channel WHERE frame BETWEEN 1 AND {_PAD}
        UNION ALL SELECT tr.channel, 2 * z - frame, 2 * x1 - value FROM tr JOIN en ON en.channel = tr.channel WHERE frame BETWEEN z - {_PAD} AND z - 1),
    {_recursive_sql("fw", "ex", 1)}, {_recursive_sql("bw", "fw", -1)}
    SELECT tr.grp, tr.channel, tr.frame, round(bw.value, 5) AS value FROM tr JOIN bw ON bw.channel = tr.channel AND bw.frame = tr.frame""",
)
def sp2_recursive_bandpass(spark, sf):
    return R.bandpass(trace(spark, sf), 0.05, 0.3, 2, BLOCK).withColumn("value", F.round("value", 5))

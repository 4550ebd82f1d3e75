"""Matching pursuit with compressed templates (EX3, EX4).

Templates are factored into few temporal and spatial parts. A trace is projected on the spatial parts and
convolved with the temporal ones; what an event takes away from every other template's score comes from a
table of template-by-template convolutions, so after the first pass nothing is convolved again. Events are
placed between samples by shifted temporal parts, their scale is drawn to one by a prior and kept in bounds,
and a unit rests after it fired.

A round takes every place whose score is the largest of all templates within a template's length (of equal ones
the earliest place, then the smallest unit), subtracts them all, and the next looks at what is left, until no
score reaches the threshold. Each event takes at least the threshold of the trace's energy, so this ends by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.storage import broadcast_if_small, materialize

PARAMETERS = {
    "approx_rank": 4, "amplitude_variance": 1.0, "jitter_factor": 8, "max_iter": None, "refractory_period_frames": 10,
    "visibility_threshold": 0.0, "scale_min": 0.0, "scale_max": float("inf"),
}
#: Rounds that the first halo of a block is good for; blocks that take more are matched again with a wider one.
ROUNDS = 6
MAX_GROUPS = 100_000


def matcher_parameters(threshold: float | None = None, *, factor: float | None = None, norms_sq: list[float] | None = None, **given) -> dict:
    """Parameters of :func:`pursue`: explicit ones win; else the threshold is factor x median squared norm (EX3, AG19).

    approx_rank: parts of a template; amplitude_variance: of the prior of scales about one (0: the scale is one,
    infinite: it is free); jitter_factor: steps between samples; max_iter: rounds (None: until nothing is left);
    refractory_period_frames: rest of a unit after and before an event; visibility_threshold: channels on which a
    template stays below it are left out; scale_min, scale_max: bounds of scales.
    """
    if unknown := set(given) - set(PARAMETERS):
        raise ValueError(f"no parameters of the matcher: {sorted(unknown)}")
    out = PARAMETERS | given
    if threshold is not None:
        return out | {"threshold": threshold}
    if factor is None or norms_sq is None:
        raise ValueError("a threshold or a factor of the median norm is needed")
    return out | {"threshold": factor * float(np.median(norms_sq))}


class Bank:
    """Templates (units, samples, channels) as temporal and spatial parts, at every shift between samples."""

    def __init__(self, templates: np.ndarray, approx_rank: int = 4, jitter_factor: int = 8, visibility_threshold: float = 0.0) -> None:
        t = np.asarray(templates, float)
        t = np.where(np.abs(t).max(axis=1, keepdims=True) >= visibility_threshold, t, 0.0)
        left, size, right = np.linalg.svd(t, full_matrices=False)
        rank = max(1, min(approx_rank, size.shape[1]))
        self.space = right[:, :rank]
        steps = np.arange(-(jitter_factor // 2), jitter_factor // 2 + 1) if jitter_factor > 1 else np.zeros(1, int)
        self.shifts = steps[np.argsort(np.abs(steps), kind="stable")] / max(1, jitter_factor)  # of equal scores the nearest shift wins
        self.time = np.stack([_moved(left[:, :, :rank] * size[:, None, :rank], s) for s in self.shifts])
        self.norm = (self.time**2).sum(axis=(2, 3))  # the spatial parts are orthonormal
        self.samples = t.shape[1]
        self._pairs: dict[tuple[int, int], np.ndarray] = {}

    def dense(self, shift: int, unit: int) -> np.ndarray:
        return self.time[shift, unit] @ self.space[unit]

    def convolved(self, trace: np.ndarray) -> np.ndarray:
        """Products of every template with the trace, at every place."""
        out = np.zeros((len(self.space), max(0, len(trace) - self.samples + 1)))
        if not out.size:
            return out
        for unit, parts in enumerate(self.space):
            on = trace @ parts.T
            for r in range(len(parts)):
                out[unit] += np.correlate(on[:, r], self.time[0, unit, :, r], "valid")
        return out

    def against_all(self, shift: int, unit: int) -> np.ndarray:
        """Products of a shifted template with every template, placed from ``samples`` - 1 before it to as much after it."""
        if (shift, unit) not in self._pairs:
            rows = []
            for other, parts in enumerate(self.space):
                on = self.time[shift, unit] @ (self.space[unit] @ parts.T)
                rows.append(sum(np.correlate(on[:, r], self.time[0, other, :, r], "full") for r in range(len(parts))))
            self._pairs[shift, unit] = np.array(rows)
        return self._pairs[shift, unit]


def _moved(time: np.ndarray, shift: float) -> np.ndarray:
    """Temporal parts (units, samples, rank) later by a fraction of a sample, as a band-limited signal with silence around."""
    if shift == 0:
        return time
    n = 2 * time.shape[1]
    turn = np.exp(-2j * np.pi * np.fft.rfftfreq(n) * shift)
    return np.fft.irfft(np.fft.rfft(time, n, axis=1) * turn[None, :, None], n, axis=1)[:, : time.shape[1]]


def scored(product: np.ndarray, norm: np.ndarray, variance: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, scale): energy that the best scale in bounds explains, less what the prior asks for it."""
    if variance == 0:
        return np.where(norm > 0, 2 * product - norm, -np.inf), np.ones(np.broadcast(product, norm).shape)
    prior = 1 / variance
    scale = np.clip((product + prior) / np.maximum(norm + prior, 1e-300), low, high)
    return np.where(norm > 0, scale * (2 * (product + prior) - (norm + prior) * scale) - prior, -np.inf), scale


def _leaders(at: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """Which of the places, in order, hold the largest value within ``reach`` frames; of equal ones the first."""
    keep = np.ones(len(at), bool)
    for k in range(1, len(at)):
        near = np.flatnonzero(at[k:] - at[:-k] <= reach)
        if not len(near):
            break
        first = value[near] >= value[near + k]
        keep[near[~first]] = False
        keep[near[first] + k] = False
    return keep


def pursue(trace: np.ndarray, templates: np.ndarray | Bank, threshold: float, **given) -> tuple[pd.DataFrame, int]:
    """Events ``(at, unit, shift, scale)`` of a (frames, channels) trace, and the rounds that they took.

    A template starts at ``at`` + ``shift``; see :func:`matcher_parameters` for the others.
    """
    if threshold <= 0:
        raise ValueError("the threshold is an energy above 0")
    p = PARAMETERS | given
    bank = templates if isinstance(templates, Bank) else Bank(templates, p["approx_rank"], p["jitter_factor"], p["visibility_threshold"])
    fit = lambda product, norm: scored(product, norm, p["amplitude_variance"], p["scale_min"], p["scale_max"])
    rest, length = np.array(trace, float), bank.samples
    product = bank.convolved(rest)
    found: list[tuple] = []
    rounds = 0
    if not product.size:
        return pd.DataFrame(found, columns=["at", "unit", "shift", "scale"]), 0
    score = fit(product, bank.norm[0][:, None])[0]
    resting = np.zeros_like(score, bool)
    best = score.max(axis=0)
    places = product.shape[1]
    while p["max_iter"] is None or rounds < p["max_iter"]:
        at = np.flatnonzero(best >= threshold)
        at = at[_leaders(at, best[at], length - 1)]
        if not len(at):
            break
        rounds += 1
        unit = score[:, at].argmax(axis=0)
        parts = np.stack([rest[a : a + length] for a in at])
        touched = np.zeros(places, bool)
        for u in np.unique(unit):
            mine = unit == u
            dense = np.stack([bank.dense(s, u) for s in range(len(bank.shifts))])
            value, scale = fit(np.einsum("elc,slc->es", parts[mine], dense), bank.norm[:, u][None, :])
            shift = value.argmax(axis=1)
            for a, s, x in zip(at[mine].tolist(), shift.tolist(), scale[np.arange(len(shift)), shift].tolist(), strict=True):
                found.append((a, int(u), float(bank.shifts[s]), x))
                rest[a : a + length] -= x * dense[s]
                lo, hi = max(0, a - length + 1), min(places, a + length)
                product[:, lo:hi] -= x * bank.against_all(s, u)[:, lo - a + length - 1 : hi - a + length - 1]
                near = max(0, a - p["refractory_period_frames"])
                resting[u, near : a + p["refractory_period_frames"] + 1] = True
                touched[min(lo, near) : max(hi, a + p["refractory_period_frames"] + 1)] = True
        new = np.flatnonzero(touched)
        score[:, new] = np.where(resting[:, new], -np.inf, fit(product[:, new], bank.norm[0][:, None])[0])
        best[new] = score[:, new].max(axis=0)
    events = pd.DataFrame(found, columns=["at", "unit", "shift", "scale"])
    return events.sort_values(["at", "unit"], ignore_index=True), rounds


def _dense(pdf: pd.DataFrame, channels: int) -> tuple[np.ndarray, int]:
    """(frames x channels, first frame) of rows (channel, frame, value), channels numbered; absent samples are zero."""
    frame = pdf.frame.to_numpy(np.int64)
    first = int(frame.min())
    out = np.zeros((int(frame.max()) - first + 1, channels))
    out[frame - first, pdf.channel.to_numpy(np.int64)] = pdf.value.to_numpy(float)
    return out, first


def match_recording(
    trace: DataFrame, bank: DataFrame | np.ndarray, threshold: float | None = None, *, factor: float | None = None, gate: float | None = None,
    samples: int | None = None, block: int = 1 << 15, **given,
) -> DataFrame:
    """Events of a recording, block by block: ``(grp, frame, unit, shift, scale, r)`` (EX4).

    trace: ``(grp, channel, frame, value)``, every channel without gaps; bank: ``(grp, unit, wf)`` of ``samples``
    samples, wf sample by sample, or one array (units, samples, channels) for all groups. r is the cosine of the
    trace with the template as placed; with ``gate``, events below it are left out. The threshold is given, or
    ``factor`` times the group's median squared norm.

    A block is matched with a halo of frames on either side. A round carries what an event changes no further than
    two template lengths, so a block that took more rounds than its halo allows is matched again with one twice as
    wide: where blocks are cut decides nothing.
    """
    matcher_parameters(threshold, factor=factor, norms_sq=[1.0], **given)
    arrays = isinstance(bank, np.ndarray)
    length = bank.shape[1] if arrays else samples
    if not length:
        raise ValueError("a bank's samples are needed")
    reach = 2 * (length - 1) + 1
    # a channel's number in its group; a block may lack channels that end before it
    order = broadcast_if_small(trace.groupBy("grp").agg(F.array_sort(F.collect_set("channel")).alias("_order")), MAX_GROUPS)
    number_of = (F.array_position("_order", F.col("channel")) - 1).alias("channel")
    trace = trace.select("grp", "channel", "frame", "value").join(order, "grp").select("grp", number_of, "frame", "value")

    def matched(number: int, grp: int, rows: pd.DataFrame, units: np.ndarray, templates: np.ndarray, halo: int) -> pd.DataFrame:
        p = matcher_parameters(threshold, factor=factor, norms_sq=[float(x) for x in (templates**2).sum(axis=(1, 2))], **given)
        compressed = Bank(templates, p["approx_rank"], p["jitter_factor"], p["visibility_threshold"])
        wide, first = _dense(rows, templates.shape[2])
        events, rounds = pursue(wide, compressed, **p)
        last = first + len(wide) - 1
        cut = first <= number * block - halo or last >= (number + 1) * block - 1 + halo  # frames go on beyond the halo
        narrow = cut and rounds * reach > halo
        out = events.assign(frame=events["at"] + first)
        out = out[out.frame // block == number]
        r = []
        for a, u, s in zip(out["at"], out["unit"], out["shift"], strict=True):
            t = compressed.dense(int(np.flatnonzero(compressed.shifts == s)[0]), u)
            seen = wide[a : a + length]
            size = np.sqrt((t**2).sum() * (seen**2).sum())
            r.append(float((t * seen).sum() / size) if size > 0 else np.nan)
        out = out.assign(r=np.array(r, float), grp=grp, block=number, unit=units[out["unit"].to_numpy(int)] if len(out) else out["unit"])
        if gate is not None:
            out = out[out.r >= gate]
        if narrow:
            out = pd.DataFrame({"grp": [grp], "block": [number], "frame": [None], "unit": [None], "shift": [None], "scale": [None], "r": [None]})
        return out[["grp", "block", "frame", "unit", "shift", "scale", "r"]].astype({"frame": "Int64", "unit": "Int64"})

    shape = "grp long, block long, frame long, unit long, shift double, scale double, r double"

    def run(halo: int, wanted: DataFrame | None) -> DataFrame:
        low, high = F.floor((F.col("frame") - halo) / F.lit(block)), F.floor((F.col("frame") + halo) / F.lit(block))
        cut = trace.select("grp", "channel", "frame", "value", F.explode(F.sequence(low, high)).alias("block"))
        if wanted is not None:
            cut = cut.join(wanted, ["grp", "block"], "left_semi")
        if arrays:
            one = lambda pdf: matched(int(pdf.block.iloc[0]), int(pdf.grp.iloc[0]), pdf, np.arange(len(bank)), bank, halo)
            return cut.groupBy("grp", "block").applyInPandas(one, shape)

        def two(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(own):
                return pd.DataFrame({c: pd.Series(dtype="float64") for c in ("grp", "block", "frame", "unit", "shift", "scale", "r")})
            own = own.sort_values("unit")
            templates = np.stack([np.asarray(w, float) for w in own.wf]).reshape(len(own), length, -1)
            return matched(int(rows.block.iloc[0]), int(rows.grp.iloc[0]), rows, own.unit.to_numpy(), templates, halo)

        # a group's templates are few beside its blocks; every block gets them
        blocks = trace.groupBy("grp", F.floor(F.col("frame") / F.lit(block)).alias("block")).agg(F.count(F.lit(1)).alias("n"))
        blocks = blocks if wanted is None else blocks.join(wanted, ["grp", "block"], "left_semi")
        shown = blocks.select("grp", F.col("block").alias("at_block")).join(bank.select("grp", "unit", "wf"), "grp").withColumnRenamed("grp", "of_grp")
        return cut.groupBy("grp", "block").cogroup(shown.groupBy("of_grp", "at_block")).applyInPandas(two, shape)

    halo = ROUNDS * reach
    done = materialize(run(halo, None), "matches")
    out = done.where("frame is not null")
    while (narrow := done.where("frame is null").select("grp", "block")).limit(1).count():
        halo *= 2
        done = materialize(run(halo, materialize(narrow, "narrow-blocks")), "matches")
        out = out.unionByName(done.where("frame is not null"))
    return out.drop("block")

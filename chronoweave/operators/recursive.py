"""Zero-phase recursive filters over recordings of any length (SP2, SP3).

A recursive filter's output depends on all that came before, but only through its state: a few numbers. The
state after a block is a power of the filter's matrix times the state before it, plus what the block gives from
rest. So blocks first run from rest, in parallel; their states, a row a block, are combined in order; then blocks
run again from the states they really start in. The result is that of one pass over the whole channel. The
same is then done backwards. Ends are continued by odd reflection, and the filter starts settled on the first value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.storage import broadcast_if_small, materialize

BLOCK = 1 << 16
#: Samples whose outputs are one matrix product.
STEP = 128
MAX_CHANNELS = 100_000


def butterworth(order: int, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth filter; bounds are shares of the sampling rate.

    With ``high`` alone a low pass, with ``low`` alone a high pass, with both a band pass (of twice the order).
    """
    if order < 1 or (low is None and high is None):
        raise ValueError("a filter needs an order and a bound")
    for bound in (low, high):
        if bound is not None and not 0 < bound < 0.5:
            raise ValueError("bounds lie between 0 and half the sampling rate")
    k = np.arange(order)
    pole = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * np.tan(np.pi * f)
    if low is None:
        pole, at, gain, many = pole * warp(high), -1.0, warp(high) ** order, 0
    elif high is None:
        pole, at, gain, many = warp(low) / pole, 1.0, 1.0, order
    else:
        width, middle = warp(high) - warp(low), np.sqrt(warp(low) * warp(high))
        half = pole * width / 2
        root = np.sqrt(half**2 - middle**2)
        pole, at, gain, many = np.concatenate((half + root, half - root)), 0.0, width**order, order
    gain = float(np.real(gain * 2.0**many / np.prod(2 - pole)))
    pole = (2 + pole) / (2 - pole)
    # conjugates go together, then what is real by pairs
    upper = sorted(pole[pole.imag > 1e-12], key=lambda p: (abs(p), p.real))
    real = sorted(pole[np.abs(pole.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2, 2) for p in upper]
    pairs += [(-(a + b), a * b, 2) for a, b in zip(real[::2], real[1::2], strict=False)]
    pairs += [(-real[-1], 0.0, 1)] if len(real) % 2 else []
    zeros = {-1.0: {1: (1.0, 1.0, 0.0), 2: (1.0, 2.0, 1.0)}, 1.0: {1: (1.0, -1.0, 0.0), 2: (1.0, -2.0, 1.0)}, 0.0: {2: (1.0, 0.0, -1.0)}}[at]
    out = np.array([(*zeros[n], a1, a2) for a1, a2, n in pairs])
    out[0, :3] *= gain
    return out


class Cascade:
    """Sections in a row as one linear system: y = C z + D x, then z = A z + B x."""

    def __init__(self, sections: np.ndarray) -> None:
        self.sections = np.asarray(sections, float).reshape(-1, 5)
        size = 2 * len(self.sections)
        self.a, self.c = np.zeros((size, size)), np.zeros(size)
        for i in range(size):
            self.c[i], self.a[:, i] = self.step(np.eye(size)[i], 0.0)
        self.d, self.b = self.step(np.zeros(size), 1.0)
        self.settled = np.linalg.solve(np.eye(size) - self.a, self.b)  # the state that a constant of 1 keeps
        powers = [np.eye(size)]
        for _ in range(STEP):
            powers.append(self.a @ powers[-1])
        self.power = powers[STEP]
        self.seen = np.array([self.c @ p for p in powers[:STEP]])  # what a state adds to the outputs of a step
        self.left = np.array([powers[STEP - 1 - i] @ self.b for i in range(STEP)]).T  # what inputs add to the state after it
        answer = np.concatenate(([self.d], [self.c @ p @ self.b for p in powers[: STEP - 1]]))
        lag = np.arange(STEP)[:, None] - np.arange(STEP)[None, :]
        self.product = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)

    def step(self, z: np.ndarray, x: float) -> tuple[float, np.ndarray]:
        """One sample through all sections (transposed direct form)."""
        then = np.zeros_like(z)
        for i, (b0, b1, b2, a1, a2) in enumerate(self.sections):
            y = b0 * x + z[2 * i]
            then[2 * i] = b1 * x - a1 * y + z[2 * i + 1]
            then[2 * i + 1] = b2 * x - a2 * y
            x = y
        return x, then

    def run(self, x: np.ndarray, z: np.ndarray, outputs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, state after) of samples from a state."""
        whole = len(x) // STEP
        parts = x[: whole * STEP].reshape(whole, STEP)
        given, before = parts @ self.left.T, np.zeros((whole, len(z)))
        for i in range(whole):
            before[i] = z
            z = self.power @ z + given[i]
        y = (parts @ self.product.T + before @ self.seen.T).ravel() if outputs else np.zeros(0)
        tail = []
        for v in x[whole * STEP :]:
            out, z = self.step(z, float(v))
            tail.append(out)
        return (np.concatenate((y, tail)) if outputs else y), z


def _forward(trace: DataFrame, cascade: Cascade, block: int) -> DataFrame:
    """One pass over each channel in order of frames, from the state settled on its first value."""
    kind = trace.schema["channel"].dataType.simpleString()
    cut = trace.withColumn("block", F.floor(F.col("frame") / F.lit(block)))

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame").value.to_numpy(float)
        _, z = cascade.run(x, np.zeros(len(cascade.c)), outputs=False)
        return pd.DataFrame({"channel": pdf.channel.iloc[:1], "block": pdf.block.iloc[:1], "n": [len(x)], "state": [z.tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        z, starts, powers = cascade.settled * float(pdf.x.iloc[0]), [], {}
        for n, own in zip(pdf.n, pdf.state, strict=True):
            starts.append(z.tolist())
            if n not in powers:
                powers[n] = np.linalg.matrix_power(cascade.a, int(n))
            z = powers[n] @ z + np.asarray(own, float)
        return pd.DataFrame({"of_channel": pdf.channel.to_numpy(), "of_block": pdf.block.to_numpy(), "start": starts})

    states = cut.groupBy("channel", "block").applyInPandas(rest, f"channel {kind}, block long, n long, state array<double>")
    first = trace.groupBy("channel").agg(F.min_by("value", "frame").alias("x"))
    starts = materialize(states.join(first, "channel").groupBy("channel").applyInPandas(chain, f"of_channel {kind}, of_block long, start array<double>"), "filter-states")

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        y, _ = cascade.run(rows.value.to_numpy(float), np.asarray(own.start.iloc[0], float))
        return rows[["grp", "channel", "frame"]].assign(value=y)

    both = cut.groupBy("channel", "block").cogroup(starts.groupBy("of_channel", "of_block"))
    return both.applyInPandas(run, f"grp long, channel {kind}, frame long, value double")


def zero_phase(trace: DataFrame, sections: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(grp, channel, frame, value)``: the trace filtered forwards and backwards by second-order sections.

    Frames of a channel follow each other without gaps. Ends are continued by reflection about the end value, by
    three times the filter's length or as far as the channel goes.
    """
    cascade = Cascade(sections)
    pad = 3 * (2 * len(cascade.sections) + 1)
    rows = trace.select(F.col("grp").cast("long").alias("grp"), "channel", F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    ends = rows.groupBy("channel").agg(F.min("frame").alias("_a"), F.max("frame").alias("_z"), F.min_by("value", "frame").alias("_x"), F.max_by("value", "frame").alias("_y"))
    met = rows.join(broadcast_if_small(ends, MAX_CHANNELS), "channel")
    mirrored = F.array_compact(
        F.array(
            F.struct(F.col("frame"), F.col("value")),
            F.when((F.col("frame") > F.col("_a")) & (F.col("frame") <= F.col("_a") + pad), F.struct((2 * F.col("_a") - F.col("frame")).alias("frame"), (2 * F.col("_x") - F.col("value")).alias("value"))),
            F.when((F.col("frame") < F.col("_z")) & (F.col("frame") >= F.col("_z") - pad), F.struct((2 * F.col("_z") - F.col("frame")).alias("frame"), (2 * F.col("_y") - F.col("value")).alias("value"))),
        )
    )
    whole = met.select("grp", "channel", F.explode(mirrored).alias("s")).select("grp", "channel", "s.frame", "s.value")
    once = materialize(_forward(whole, cascade, block), "filtered-forwards")
    back = _forward(once.withColumn("frame", -F.col("frame")), cascade, block).withColumn("frame", -F.col("frame"))
    inside = back.join(broadcast_if_small(ends.select("channel", "_a", "_z"), MAX_CHANNELS), "channel").where("frame >= _a and frame <= _z")
    return inside.select("grp", "channel", "frame", "value")


def bandpass(trace: DataFrame, low: float, high: float, order: int = 2, block: int = BLOCK) -> DataFrame:
    """Zero-phase Butterworth band pass, bounds as shares of the sampling rate (SP2, SP3)."""
    return zero_phase(trace, butterworth(order, low, high), block)

"""The spectrum of an event train on every frequency of its span in a band (SP11), by a non-uniform Fourier transform.

A train of n events over N frames has a periodogram value at each multiple k of 1/N. Events are shifted down to the
band's middle and laid on a grid of twice the band's frequencies with a narrow Gaussian: a few cells an event,
added up by an aggregate before anything is shuffled. One transform of the grid and a division by the kernel's own
transform give all frequencies, so the cost is events plus frequencies, not their product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells on either side of an event; the error falls as exp(-pi / 3) to their power.
SPREAD = 14


def event_spectrum(train: DataFrame, start: int, frames: int, low: int, high: int) -> DataFrame:
    """``(unit, k, power)`` for every k from ``low`` to ``high``: the squared sum of the events' turns, over their number.

    k counts cycles in ``frames`` frames from ``start``; a frequency in Hz is k times the rate over ``frames``.
    Events outside of the span don't count.
    """
    return _by_unit(train, start, frames, low, high, "unit {unit}, k long, power double", lambda unit, power: pd.DataFrame({"unit": unit, "k": np.arange(low, high + 1), "power": power}))


def event_rate(train: DataFrame, start: int, frames: int, low: int, high: int) -> DataFrame:
    """``(unit, k, power, cycles, snr)``: the strongest frequency of the band (of equal ones the lowest).

    cycles: the top of the parabola through it and its neighbours, itself at the band's ends; snr: its power over
    the band's median (null where that is zero).
    """

    def peak(unit, power: np.ndarray) -> pd.DataFrame:
        at = int(np.argmax(power))
        cycles = float(low + at)
        if 0 < at < len(power) - 1:
            bend = power[at - 1] - 2 * power[at] + power[at + 1]
            cycles += 0.5 * (power[at - 1] - power[at + 1]) / bend if bend else 0.0
        middle = float(np.median(power))
        return pd.DataFrame({"unit": [unit], "k": [low + at], "power": [float(power[at])], "cycles": [cycles], "snr": [float(power[at]) / middle if middle > 0 else None]})

    return _by_unit(train, start, frames, low, high, "unit {unit}, k long, power double, cycles double, snr double", peak)


def _by_unit(train: DataFrame, start: int, frames: int, low: int, high: int, shape: str, use) -> DataFrame:
    if not 0 <= low <= high or frames < 1:
        raise ValueError("a band runs from 0 cycles or more upwards, in one frame or more")
    many = high - low + 1
    grid = 2 * max(many, SPREAD)  # the kernel must fit on it
    half = grid // 2
    middle = low + many // 2
    tau = math.pi * SPREAD / (half**2 * 2 * 1.5)
    h = 2 * math.pi / grid
    t = F.col("frame") - F.lit(start)
    inside = train.where((t >= 0) & (t < frames)).select("unit", t.alias("t"))
    # whole numbers as far as they go: the turn of an event is exact however long the span is
    turn = F.pmod(F.col("t") * F.lit(middle), F.lit(frames)) / F.lit(float(frames)) * (-2 * math.pi)
    place = F.col("t") * F.lit(float(grid)) / F.lit(float(frames))
    cell = F.floor(place)
    spread = inside.select("unit", turn.alias("turn"), cell.alias("cell"), (place - cell).alias("d"), F.explode(F.sequence(F.lit(1 - SPREAD), F.lit(SPREAD))).alias("l"))
    weight = F.exp(-F.pow((F.col("d") - F.col("l")) * h, 2) / (4 * tau))
    cells = spread.groupBy("unit", F.pmod(F.col("cell") + F.col("l"), F.lit(grid)).alias("cell")).agg(
        F.sum(weight * F.cos("turn")).alias("re"), F.sum(weight * F.sin("turn")).alias("im"), F.sum((F.col("l") == 0).cast("long")).alias("n")
    )
    k = np.arange(low, high + 1) - middle
    undo = math.sqrt(math.pi / tau) * np.exp(k.astype(float) ** 2 * tau) / grid

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(grid, complex)
        on[pdf.cell.to_numpy(np.int64)] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        return use(key[0], np.abs(np.fft.fft(on)[k % grid] * undo) ** 2 / max(1, int(pdf.n.sum())))

    # a unit's grid is twice its band, whatever the number of its events
    return cells.groupBy("unit").applyInPandas(run, shape.format(unit=train.schema["unit"].dataType.simpleString()))

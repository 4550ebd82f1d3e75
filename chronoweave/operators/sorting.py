"""A sorter in blocks: whitening by group, detection, snippets, and clusters whose number is found (EX1, IT11).

What is fitted is fitted on seeded samples of documented size, a group's sample in one task; all else (whitening,
detection, cutting, classification) runs over whole recordings as joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.signal import exclusive_peaks
from chronoweave.plans.storage import broadcast_if_small, materialize

SEED = 42
#: Snippets of a group that clusters are found on, at most; all others are classified by the nearest template.
TRAIN = 4000
COMPONENTS = 6
#: First parts of a sample, joined until no two are like one.
PARTS = 24
#: Distance of two distributions, times the root of the rows, from which a projection has two peaks.
DIP = 0.9
LEAST = 12
#: Rows of whitening matrices, and groups with all their templates, that are sent to every executor at most.
MAX_ENTRIES = 100_000
MAX_BANKS = 1000


def covariance(trace: DataFrame, block: int = 1 << 12, one_in: int = 1, seed: int = SEED) -> DataFrame:
    """``(grp, i, j, cov)``: covariances of a group's channels over seeded blocks of frames, one of ``one_in``, as one mergeable aggregate."""
    chosen = trace.where(F.pmod(F.xxhash64(F.lit(seed), "grp", F.floor(F.col("frame") / F.lit(block))), F.lit(one_in)) == 0)
    a = chosen.select("grp", "frame", F.col("channel").alias("i"), F.col("value").alias("x"))
    b = chosen.select("grp", "frame", F.col("channel").alias("j"), F.col("value").alias("y"))
    return a.join(b, ["grp", "frame"]).groupBy("grp", "i", "j").agg(F.covar_pop("x", "y").alias("cov"))


def whitening(cov: DataFrame, floor: float = 1e-9) -> DataFrame:
    """``(grp, i, j, w)``: the symmetric matrix that makes a group's channels uncorrelated, of variance one (ZCA).

    Directions of less than ``floor`` times the largest variance are left out. A group's matrix is channels by channels.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf.i)
        m = np.zeros((len(names),) * 2)
        m[np.searchsorted(names, pdf.i), np.searchsorted(names, pdf.j)] = pdf["cov"]
        size, axes = np.linalg.eigh((m + m.T) / 2)
        scale = np.where(size > floor * size.max(), 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        w = (axes * scale) @ axes.T
        i, j = np.meshgrid(names, names, indexing="ij")
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "i": i.ravel(), "j": j.ravel(), "w": w.ravel()})

    return cov.groupBy("grp").applyInPandas(run, "grp long, i long, j long, w double")


def whitened(trace: DataFrame, matrix: DataFrame) -> DataFrame:
    """The trace with each frame's channels multiplied by the group's matrix."""
    matrix = broadcast_if_small(matrix, MAX_ENTRIES)
    parts = trace.select("grp", F.col("channel").alias("j"), "frame", "value").join(matrix, ["grp", "j"])
    return parts.groupBy("grp", F.col("i").alias("channel"), "frame").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _rising(y: np.ndarray) -> np.ndarray:
    """The nearest sequence that doesn't fall, by pooling neighbours."""
    level: list[list[float]] = []
    for v in y:
        level.append([float(v), 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            v2, n2 = level.pop()
            v1, n1 = level.pop()
            level.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.repeat([v for v, _ in level], [int(n) for _, n in level])


def two_peaks(x: np.ndarray) -> tuple[float, float]:
    """(how far, where): the distance of a sample from the nearest distribution of one peak, times the root of its size, and its valley.

    The sample is counted in bins; the fit rises to some bin and falls from it, whichever leaves the least squares.
    """
    n = len(x)
    bins = int(np.clip(2 * np.cbrt(n), 8, 60))
    count, edges = np.histogram(x, bins)
    up = [_rising(count[: m + 1]) for m in range(bins)]
    down = [_rising(count[m:][::-1])[::-1] for m in range(bins)]
    error = [((up[m] - count[: m + 1]) ** 2).sum() + ((down[m + 1] - count[m + 1 :]) ** 2).sum() if m + 1 < bins else ((up[m] - count) ** 2).sum() for m in range(bins)]
    m = int(np.argmin(error))
    fit = np.concatenate((up[m], down[m + 1])) if m + 1 < bins else up[m]
    gap = np.abs(np.cumsum(count - fit)).max() / np.sqrt(n)
    # the valley: where counts lie furthest below the fit of one peak, smoothed over neighbours
    below = np.convolve(fit - count, [0.5, 1, 0.5], "same")
    v = int(np.argmax(below))
    return float(gap), float((edges[v] + edges[v + 1]) / 2)


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The direction that tells two clouds apart best, by their pooled covariance."""
    pooled = (np.cov(x.T, bias=True) * len(x) + np.cov(y.T, bias=True) * len(y)) / (len(x) + len(y))
    pooled = np.atleast_2d(pooled)
    return np.linalg.solve(pooled + np.eye(len(pooled)) * (1e-6 * np.trace(pooled) / len(pooled) + 1e-12), y.mean(axis=0) - x.mean(axis=0))


def split_clusters(y: np.ndarray, dip: float = DIP, least: int = LEAST, seed: int = SEED) -> np.ndarray:
    """Labels of rows, in order of first appearance; how many there are is found.

    Rows are first parted by k-means. Then neighbouring parts are compared on the line that tells them apart: with
    one peak they become one, with two they are parted anew at the valley, until no two neighbours are left
    that haven't been compared as they are. Parts of fewer than ``least`` rows join their nearest.
    """
    n, rng = len(y), np.random.default_rng(seed)
    middle = y[[int(rng.integers(n))]]
    while len(middle) < min(PARTS, max(1, n // least)):
        far = ((y[:, None] - middle[None]) ** 2).sum(axis=2).min(axis=1)
        if far.sum() <= 0:
            break
        middle = np.concatenate((middle, y[[int(rng.choice(n, p=far / far.sum()))]]))
    for _ in range(15):
        label = ((y[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([y[label == k].mean(axis=0) if (label == k).any() else middle[k] for k in range(len(middle))])
    version = dict.fromkeys(np.unique(label).tolist(), 0)
    done: set[tuple[int, int, int, int]] = set()
    while len(version) > 1:
        names = sorted(version)
        size = {k: int((label == k).sum()) for k in names}
        middle = np.array([y[label == k].mean(axis=0) for k in names])
        far = ((middle[:, None] - middle[None]) ** 2).sum(axis=2)
        np.fill_diagonal(far, np.inf)
        open_ = [(far[i, j], names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)) if (names[i], version[names[i]], names[j], version[names[j]]) not in done]
        if not open_:
            break
        _, a, b = min(open_)
        pair = np.flatnonzero((label == a) | (label == b))
        x, z = y[label == a], y[label == b]
        if min(size[a], size[b]) < least:
            gap = 0.0
        else:
            on = y[pair] @ _line(x, z)
            # a small part beside a large one is judged by what lies near it
            near = np.sort(on)
            keep = 4 * min(size[a], size[b])
            if keep < len(near):
                edge = np.median(x @ _line(x, z)) if size[a] < size[b] else np.median(z @ _line(x, z))
                near = near[np.argsort(np.abs(near - edge), kind="stable")[:keep]]
            gap, valley = two_peaks(near)
        if gap < dip:
            label[pair] = a
            version[a] += 1
            del version[b]
            continue
        new = np.where(on < valley, a, b)
        if 0 < (new == a).sum() < len(new) and (new != label[pair]).any() and version[a] + version[b] < 40:
            label[pair] = new
            version[a] += 1
            version[b] += 1
        done.add((a, version[a], b, version[b]))
    first = {k: i for i, k in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([first[k] for k in label.tolist()])


def cluster_templates(snippets: DataFrame, train: int = TRAIN, components: int = COMPONENTS, dip: float = DIP, seed: int = SEED) -> DataFrame:
    """``(grp, cluster, wf, n)``: mean snippets of the clusters of a group's seeded sample, largest first."""
    order = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(seed), "spike"), "spike")
    sample = snippets.select("grp", "spike", "wf").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= train)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("_n").wf.to_numpy()).astype(float)
        _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        axes = axes[:components] * np.where(axes[:components].sum(axis=1, keepdims=True) < 0, -1, 1)
        label = split_clusters((x - x.mean(axis=0)) @ axes.T, dip, seed=seed)
        n = np.bincount(label)
        names = np.argsort(-n, kind="stable")
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "cluster": range(len(n)), "wf": [x[label == k].mean(axis=0).tolist() for k in names], "n": n[names]})

    return sample.groupBy("grp").applyInPandas(run, "grp long, cluster long, wf array<double>, n long")


def nearest_template(snippets: DataFrame, bank: DataFrame, name: str) -> DataFrame:
    """``snippets`` with the ``name`` of the group's template at the smallest distance (of equal ones the smallest)."""
    shown = bank.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(name, "wf"))).alias("_bank"))
    gap = lambda t: F.aggregate(F.zip_with("wf", t["wf"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("_bank", lambda t: F.struct(gap(t).alias("gap"), t[name].alias("name"))))
    return snippets.join(broadcast_if_small(shown, MAX_BANKS), "grp").withColumn(name, best["name"]).drop("_bank")


def cluster(snippets: DataFrame, train: int = TRAIN, components: int = COMPONENTS, dip: float = DIP, seed: int = SEED) -> DataFrame:
    """``(grp, spike, cluster)``: clusters of a group's snippets ``(grp, spike, wf)``, found on a sample, given to all (EX1, IT11)."""
    bank = materialize(cluster_templates(snippets, train, components, dip, seed).select("grp", "cluster", "wf"), "clusters")
    return nearest_template(snippets.select("grp", "spike", "wf"), bank, "cluster").select("grp", "spike", "cluster")


def snippets(trace: DataFrame, peaks: DataFrame, before: int, after: int, channels: int) -> DataFrame:
    """``(grp, spike, wf)`` of peaks ``(grp, frame)``: ``before`` + ``after`` frames of the group's channels, sample by sample (EX1).

    A spike bears its frame's number; those whose frames are not all at hand go. Peaks meet the trace frame by frame.
    """
    wanted = peaks.select("grp", F.col("frame").alias("spike")).distinct()
    wanted = wanted.withColumn("frame", F.explode(F.sequence(F.col("spike") - before, F.col("spike") + (after - 1))))
    met = trace.join(wanted, ["grp", "frame"]).groupBy("grp", "spike").agg(F.array_sort(F.collect_list(F.struct("frame", "channel", "value"))).alias("_v"))
    return met.where(F.size("_v") == (before + after) * channels).select("grp", "spike", F.transform("_v", lambda s: s["value"]).alias("wf"))


def sort_trace(
    trace: DataFrame, least: float, dead: int, before: int, after: int, channels: int, block: int = 1 << 16, whiten: bool = True,
    train: int = TRAIN, dip: float = DIP, seed: int = SEED,
) -> DataFrame:
    """Whiten, detect, cut and cluster a trace by group: ``(grp, unit, frame)``; units count from 0 in their group (EX1).

    Peaks are those of :func:`chronoweave.operators.signal.exclusive_peaks`.
    """
    if whiten:
        trace = materialize(whitened(trace, materialize(whitening(covariance(trace, seed=seed)), "whitening")), "whitened")
    cut = materialize(snippets(trace, exclusive_peaks(trace, least, dead, block), before, after, channels), "snippets")
    return cluster(cut, train, dip=dip, seed=seed).select("grp", F.col("cluster").alias("unit"), F.col("spike").alias("frame"))

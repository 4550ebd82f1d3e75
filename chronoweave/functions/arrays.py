"""Array mathematics as column expressions: dot products, cosines, shifted cosines of flattened templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either is null or zero."""
    size = F.sqrt(norm_sq(a)) * F.sqrt(norm_sq(b))
    return F.when(size > 0, dot(a, b) / size)


def shifted_cosines(a: Column, b: Column, samples: int, channels: int, most: int) -> list[tuple[int, Column]]:
    """(shift, cosine) of templates stored sample by sample, over what overlaps at each shift."""
    out = []
    for s in range(-most, most + 1):
        size = F.lit((samples - abs(s)) * channels)
        left = F.slice(a, F.lit(1 + max(0, s) * channels), size)
        right = F.slice(b, F.lit(1 + max(0, -s) * channels), size)
        out.append((s, cosine(left, right)))
    return out


def max_shift_cosine(a: Column, b: Column, samples: int, channels: int, most: int) -> Column:
    """Largest cosine over shifts up to ``most`` samples; -1 where none is defined (FN4)."""
    return F.greatest(F.lit(-1.0), *[c for _, c in shifted_cosines(a, b, samples, channels, most)])


def masked(a: Column, channels: int, kept: list[int]) -> Column:
    """Dense to packed: only the kept channels of each sample (FN10)."""
    return F.filter(a, lambda x, i: (i % channels).isin(kept))


def unmasked(a: Column, samples: int, channels: int, kept: list[int]) -> Column:
    """Packed to dense, zeros for channels that aren't kept (FN10)."""
    rank = {c: i for i, c in enumerate(sorted(kept))}
    places = [s * len(kept) + rank[c] if c in rank else -1 for s in range(samples) for c in range(channels)]
    return F.transform(F.array(*map(F.lit, places)), lambda p: F.when(p >= 0, F.get(a, p)).otherwise(F.lit(0.0)))

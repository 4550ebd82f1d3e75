"""Numbers, running sums and quantiles over a whole table in order, without a window or an aggregate in one task.

For numbers and sums, rows are dealt by ranges of the order and written; a row per range carries the sum of what
comes before it. Quantiles are selected by refining histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.storage import broadcast_if_small, materialize


def running(rows: DataFrame, order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over all rows before, in the order; ties must not matter or not be."""
    dealt = rows.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_amount": amount})
    dealt = materialize(dealt, "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(sums, "_range")
    return out.withColumn(name, F.col(name) + F.col("_offset")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 in the order."""
    return running(rows, order, F.lit(1).cast("long"), name)


def previous(rows: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``column`` of the row before, in the order, in the group; null for the first.

    Groups of at most ``SORTED`` rows are sorted by a window. Where there are larger ones, rows are dealt by ranges of
    group and order; inside a range a window does, and a range's first row of a group gets its value from the last
    row of the group in the ranges before, of which there is one a range. Rows alike in the order may go either way.
    """
    largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0  # one number
    if largest <= SORTED:
        return rows.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    out = dealt.withColumns({name: F.lag(column).over(inside), "_first": F.row_number().over(inside) == 1})
    place = F.struct(*[F.col(c) for c in order])
    ends = dealt.groupBy(*by, "_range").agg(F.max_by(F.struct(F.col(column).alias("v")), place).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end.v").over(Window.partitionBy(*by).orderBy("_range"))).drop("_end")  # a row a range
    met = _same(out, ends, [*by, "_range"])
    return met.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name))).drop("_first", "_before", "_range")


#: Values of a group that one aggregate may hold; bins that an interval of more is cut into.
HELD = 1 << 16
#: Rows of a group that one window may sort.
SORTED = 1 << 20
BINS = 1 << 10
MAX_INTERVALS = 100_000


def _largest(base: DataFrame, by: list[str]) -> int:
    return base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0  # one number


def _values(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    return rows.select(*by, value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], name: str = "q") -> DataFrame:
    """``(*by, name)``: an array of the exact quantiles of each group, linear between neighbours; null and NaN values don't count.

    Groups of at most ``HELD`` values go through one aggregate; where there are larger ones, see :func:`selected`.
    """
    base = _values(rows, by, value)
    if _largest(base, by) <= HELD:
        return base.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(name))
    base = materialize(base, "values")
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    place = [F.lit(float(s)) * (F.col("_size") - 1) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    found = _refined(base, by, sizes.select(*by, F.explode(ranks).alias("_rank")))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))
    values = _same(values, sizes, by)
    at = lambda rank: F.element_at("_values", rank)
    between = [F.when(F.floor(p) == F.ceil(p), at(F.floor(p))).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))) for p in place]
    return values.select(*by, F.array(*between).alias(name))


def selected(rows: DataFrame, by: list[str], value: Column, ranks: DataFrame, name: str) -> DataFrame:
    """``(*by, rank, name)``: the value of each rank (0 is the smallest) in ``ranks`` ``(*by, rank)``; null and NaN values don't count.

    Selection refines histograms: values are counted in bins, of which those that hold a wanted rank are cut again
    between their smallest and largest value, until each holds ``HELD`` values at most or one value. A round
    is a scan with an aggregate of bins; no aggregate holds a group's values unless they are at most ``HELD``.
    """
    base, ranks = _values(rows, by, value), ranks.withColumnRenamed("rank", "_rank")
    if _largest(base, by) <= HELD:
        held = base.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        found = _same(ranks, held, by).select(*by, "_rank", F.get("_all", F.col("_rank").cast("int")).alias("_v"))
    else:
        found = _refined(materialize(base, "values"), by, ranks)
    return found.where("_v is not null").select(*by, F.col("_rank").alias("rank"), F.col("_v").alias(name))


def _refined(base: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """``(*by, _rank, _v)`` of :func:`selected`."""
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = _same(ranks, sizes, by).select(*by, "_rank", F.lit(0).cast("long").alias("_before"), "_size", "_lo", "_hi")
    wanted = materialize(wanted, "ranks")
    within = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]

    def inside(cut: DataFrame) -> DataFrame:
        """The values of each interval of ``cut``."""
        cut = broadcast_if_small(cut.select(*[F.col(c).alias(f"_{c}") for c in by], "_lo", "_hi").distinct(), MAX_INTERVALS)
        return base.join(cut, [*within, F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")]).select(*by, "_v", "_lo", "_hi")

    keys = [*by, "_lo", "_hi"]
    here = "_rank - _before >= _s and _rank - _before < _s + _k"
    while (wide := wanted.where(f"_size > {HELD} and _lo < _hi")).limit(1).count():
        # halved before the difference, which may be beyond the largest double
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = inside(wide).withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = bins.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # of bins
        bins = bins.withColumn("_s", F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
        met = _same(wide, bins, keys).where(here)
        narrow = met.select(*by, "_rank", (F.col("_before") + F.col("_s")).alias("_before"), F.col("_k").alias("_size"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
        wanted = materialize(narrow.unionByName(wanted.where(f"_size <= {HELD} or _lo = _hi")), "ranks")
    counts = inside(wanted).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_s", F.coalesce(F.sum("_k").over(earlier), F.lit(0)))
    return _same(wanted, counts, keys).where(here).select(*by, "_rank", "_v")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    other = b.select(*[F.col(c).alias(f"_other{c}") if c in keys else F.col(c) for c in b.columns])
    return a.join(other, [F.col(c).eqNullSafe(F.col(f"_other{c}")) for c in keys]).drop(*[f"_other{c}" for c in keys])


def median(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``(*by, name)``: the exact median of each group."""
    return quantiles(rows, by, value, [0.5]).select(*by, F.get("q", F.lit(0)).alias(name))

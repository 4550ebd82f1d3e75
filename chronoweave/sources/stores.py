"""Writers: partitioned traces, overwritten stores, checkpoints that resume, appended results, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.series import in_intervals


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table stands at the path (Spark's own success mark, in any file system)."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_trace(trace: DataFrame, path: str, group: str = "grp", order: str = "frame") -> None:
    """A folder per group, ordered by frame within files, so reads of a group or a time span skip the rest (SNK1).

    Rows are dealt by ranges of group and frame, so a long group is several files. For quantised blocks see
    :func:`chronoweave.sources.blocks.write_blocks`.
    """
    trace.repartitionByRange(group, order).sortWithinPartitions(group, order).write.mode("overwrite").option("compression", "zstd").partitionBy(group).parquet(path)


def open_traces(spark: SparkSession, path: str) -> DataFrame:
    """A written trace with ``channel_name``: its own, else ``channel_names``, else the channel's number as text (SRC9).

    Places (x, y) and labels stay as they are; nothing is read before a query asks for it.
    """
    rows = spark.read.parquet(path)
    held = [F.col(c).cast("string") for c in ("channel_name", "channel_names", "channel") if c in rows.columns]
    if not held:
        raise ValueError(f"{path} has no channels")
    return rows.withColumn("channel_name", F.coalesce(*held)).drop("channel_names")


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def materialize_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; made first if it isn't finished (SNK4, SNK6)."""
    if force or not exists(spark, path):
        overwrite(make(), path)
    return spark.read.parquet(path)


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds a lock file beside the table at ``path``; an error if another writer holds it.

    The file system creates it in one step or refuses. A writer that dies leaves it, to be deleted by hand.
    """
    jvm = spark.sparkContext._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.lock")
    files = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.createNewFile(lock):
        raise RuntimeError(f"{path} is being written: {lock.toString()} exists")
    try:
        yield
    finally:
        files.delete(lock, False)


def append_new(results: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table doesn't have yet; how many there were (SNK10). Writers take turns by a lock."""
    spark = results.sparkSession
    with locked(spark, path):
        if exists(spark, path):
            results = results.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        results = results.persist()
        n = results.count()
        if n:
            results.write.mode("append").parquet(path)
        results.unpersist()
    return n


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """CSV or JSON lines, appended (SNK8)."""
    writer = df.write.mode("append")
    (writer.option("header", True).csv if form == "csv" else writer.json)(path)


def manifest(items: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """One JSON text per item with its provenance (SNK9)."""
    known = F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())])
    return items.select(F.to_json(F.struct(known.alias("provenance"), F.struct(*items.columns).alias("item"))).alias("value"))


def spike_table(events: DataFrame, segments: DataFrame, rate: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, time, unit_id, tetrode)`` by a join of frames to the segments that hold them (SNK5, JN16)."""
    met = in_intervals(events, segments.withColumn("_from", F.col("start_sample")), "frame", "start_sample", "end_sample", ["t_start", "_from"])
    time = F.col("t_start") + (F.col("frame") - F.col("_from")) / F.lit(rate)
    return met.select(*keep, time.alias("time"), F.col("unit").cast("int").alias("unit_id"), F.concat(F.lit("TT"), (F.col("grp") + 1).cast("string")).alias("tetrode"))

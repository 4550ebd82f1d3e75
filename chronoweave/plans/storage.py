"""Lineage cuts and size checks that hold on a cluster.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every executor and the
driver share. Only where that setting is absent and one machine does all (tests) is a temporary folder made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, made up only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="chronoweave-")
    return _LOCAL[app]


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; :func:`clear_tables` deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system its path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if any(path.endswith(made.rpartition("/")[2]) for made in _MADE.get(spark.sparkContext.applicationId, [])):
            _delete(spark, path)


def clear_tables(spark: SparkSession) -> int:
    """Delete every table the session has made so far; results that still read them must be written first."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        _delete(spark, path)
    return len(made)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` unchanged.

    The check runs one bounded job (``limit(max_rows + 1)``); beyond the bound Spark joins by shuffle.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, chosen by exact spelling.

    Other columns are dropped before any expression sees them, so neither extra columns nor columns whose
    names differ only in case (or repeat) can make a reference ambiguous; of repeated ones the first counts.
    """
    columns = df.columns
    places = [f"_c{i}" for i in range(len(columns))]
    renamed = df.toDF(*places)
    return renamed.select(*[F.col(places[columns.index(n)]).alias(n) for n in names])

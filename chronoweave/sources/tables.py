"""The driver's tables as recordings: event trains, template banks and regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds.
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
GROUPS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, unit, frame, value, kind, event_id)``: users are units, frames are microseconds."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % GROUPS).alias("grp"),
        F.col("user_id").alias("unit"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("frame"),
        "value",
        F.col("event_type").alias("kind"),
        "event_id",
    )


#: The same in SQL, as a common table expression.
EVENTS = (
    f"ev AS (SELECT user_id % {GROUPS} AS grp, user_id AS unit, epoch_us(ts) AS frame, value, event_type AS kind, event_id FROM events)"
)


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, unit, wf array<double>)``: labels are groups, vectors are templates."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("grp"), F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("wf")
    )


TEMPLATES = "tp AS (SELECT label AS grp, vec_id AS unit, embedding::DOUBLE[] AS wf FROM embeddings)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(channel, day, value)``: the quantity each supplier ships on each day."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("channel"), day.alias("day"))
        .agg(F.sum("l_quantity").alias("value"))
    )


DAILY = """dl AS (SELECT l_suppkey AS channel, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day,
    sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""

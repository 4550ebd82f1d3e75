"""A recording from chunks to chained units as one run that can be resumed (IT5, EX1, EX4, SRC14).

Each chunk is sorted, its units' templates are averaged, and the chunk is matched with them; its tables stand in
folders ``chunk=NNNNNN`` of the store, the templates last. Units of neighbouring chunks are then linked where
they overlap, chained, and spliced. A run that was killed does only the chunks that it hadn't finished.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.carry import mean_templates
from chronoweave.operators.matcher import match_recording
from chronoweave.operators.tracking import chunk_edges, spliced
from chronoweave.plans.storage import exists, materialize, own_path

EVENTS = "grp long, unit long, frame long"
BANK = "grp long, unit long, wf array<double>, n long, snr double"


class Session(NamedTuple):
    """train ``(grp, global_id, frame)``, edges as of :func:`chronoweave.operators.tracking.chunk_edges`, and the chunks' own tables."""

    train: DataFrame
    edges: DataFrame
    events: DataFrame
    bank: DataFrame


def load_chunks(spark: SparkSession, store: str, table: str, shape: str) -> DataFrame:
    """A table of all finished chunks of a store, with ``chunk``; only finished ones, whatever else lies there (SRC14)."""
    path = f"{store}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{shape}, chunk long")
    rows = spark.read.schema(f"{shape}, chunk long").parquet(path)
    if table == "bank":
        return rows
    done = load_chunks(spark, store, "bank", BANK).select("chunk").distinct()
    return rows.join(F.broadcast(done), "chunk", "left_semi")  # a row a chunk


def track_recording(
    trace: DataFrame, chunks: DataFrame, sorter: Callable[[DataFrame], DataFrame], samples: int, channels: int, tol: int, *, least: float = 0.5,
    alike: float = 0.9, shifts: int = 0, least_events: int = 1, factor: float | None = None, threshold: float | None = None, gate: float | None = None,
    store: str | None = None, block: int = 1 << 15, **given,
) -> Session:
    """Chunks of a recording sorted, matched, chained and spliced.

    trace: ``(grp, channel, frame, value)``; chunks: ``(chunk, start_frame, end_frame)``, overlapping; the sorter gives
    ``(grp, unit, frame)`` of a chunk's trace, frames where templates start. Units of fewer than ``least_events`` events
    have no template. Neighbours are linked as in :func:`chronoweave.operators.tracking.chunk_edges`.
    """
    spark = trace.sparkSession
    store = store or own_path(spark, "session")
    for c in chunks.orderBy("chunk").collect():  # a row a chunk
        place = f"chunk={c.chunk:06d}"
        if exists(spark, f"{store}/bank/{place}/_SUCCESS"):
            continue
        part = trace.where((F.col("frame") >= c.start_frame) & (F.col("frame") < c.end_frame))
        bank = materialize(mean_templates(part, sorter(part), samples, channels).where(F.col("n") >= least_events), "chunk-bank")
        found = match_recording(part, bank, threshold, factor=factor, gate=gate, samples=samples, block=block, **given)
        found.select("grp", "unit", "frame").write.mode("overwrite").parquet(f"{store}/events/{place}")
        bank.select("grp", "unit", "wf", "n", "snr").write.mode("overwrite").parquet(f"{store}/bank/{place}")
    events, bank = load_chunks(spark, store, "events", EVENTS), load_chunks(spark, store, "bank", BANK)
    edges = materialize(chunk_edges(events, chunks, tol, least, bank, alike, (samples, channels, shifts)), "chunk-edges")
    return Session(spliced(events, chunks, edges), edges, events, bank)

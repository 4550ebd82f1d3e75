"""Traces as quantised blocks of a group's channels over a span of frames (SNK1), and their reader.

A block holds whole numbers: values over a step of the channel, as differences from frame to frame, compressed.
A task writes one file of blocks with an index at its end; the table is what the manifest names. Tasks write
files that nobody reads, and the driver, once all have ended, puts the manifest in place in one step: a write
that is killed leaves the former table, or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from chronoweave.sources.pushdown import Bounds, Wanted, enable
from chronoweave.sources.recordings import file_system

SHAPE = "grp long, channel int, frame long, value float"
MANIFEST = "_manifest.json"
CODEC = "zstd"
#: Steps of a channel's largest value where no step is given.
STEPS = 32767
#: Bytes at a file's end that say how long its index is.
TAIL = 8


def quantise(values: np.ndarray, step: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers, step of each channel) of (channels, frames); no value moves by more than half a step. NaNs become zero."""
    known = np.nan_to_num(values.astype(float), nan=0.0)
    largest = np.abs(known).max(axis=1, initial=0.0)
    steps = np.full(len(known), step) if step else np.where(largest > 0, largest / STEPS, 1.0)
    return np.rint(known / steps[:, None]).astype(np.int64), steps


def packed(values: np.ndarray, step: float | None) -> tuple[bytes, dict]:
    """A block's bytes and what its reader has to know."""
    whole, steps = quantise(values, step)
    change = np.diff(whole, axis=1, prepend=0)
    width = next(w for w in ("<i1", "<i2", "<i4", "<i8") if not change.size or (np.iinfo(w).min <= change.min() and change.max() <= np.iinfo(w).max))
    absent = np.isnan(values)
    raw = change.astype(width).tobytes() + (np.packbits(absent).tobytes() if absent.any() else b"")
    data = pa.compress(raw, CODEC, asbytes=True)
    return data, {"steps": steps.tolist(), "width": width, "raw": len(raw), "absent": bool(absent.any()), "frames": values.shape[1]}


def unpacked(data: bytes, about: dict) -> np.ndarray:
    channels, frames = len(about["steps"]), about["frames"]
    raw = pa.decompress(data, decompressed_size=about["raw"], codec=CODEC, asbytes=True)
    size = channels * frames * np.dtype(about["width"]).itemsize
    whole = np.cumsum(np.frombuffer(raw[:size], about["width"]).reshape(channels, frames), axis=1, dtype=np.int64)
    out = (whole * np.array(about["steps"])[:, None]).astype(np.float32)
    if about["absent"]:
        out[np.unpackbits(np.frombuffer(raw[size:], np.uint8), count=channels * frames).reshape(channels, frames).astype(bool)] = np.nan
    return out


@dataclass
class Written(WriterCommitMessage):
    name: str
    blocks: int
    grp: tuple[int, int]
    frame: tuple[int, int]


class TraceBlocks(DataSource):
    """``spark.read.format("trace_blocks")``; written by :func:`write_blocks`. Options: path; step, block (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "trace_blocks"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("blocks are overwritten whole, not appended to")
        return _Writer(self.options["path"], int(self.options["block"]), float(self.options["step"]) if "step" in self.options else None)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, block: int, step: float | None) -> None:
        self.path, self.block, self.step, self.job = path.rstrip("/"), block, step, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come sorted by group and block; a block is held, no more."""
        name = f"blocks-{self.job}-{uuid.uuid4().hex}.bin"  # an attempt's own, so that a second one doesn't meet the first
        files, inside = file_system(self.path)
        index: list[dict] = []
        out = None
        at = 0

        def close(key: tuple[int, int], parts: list[np.ndarray]) -> bytes:
            rows = np.concatenate(parts, axis=1)
            channels, row = np.unique(rows[0].astype(np.int64), return_inverse=True)
            frame = rows[1].astype(np.int64)
            first = int(frame.min())
            values = np.full((len(channels), int(frame.max()) - first + 1), np.nan)
            values[row, frame - first] = rows[2]
            data, about = packed(values, self.step)
            index.append(about | {"grp": key[0], "first": first, "last": int(frame.max()), "channels": channels.tolist(), "at": at, "size": len(data)})
            return data

        held: list[np.ndarray] = []
        key: tuple[int, int] | None = None
        for batch in iterator:
            grp, channel, frame, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "channel", "frame", "value"))
            number = frame // self.block
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(number) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
                if a == b:
                    continue
                now = (int(grp[a]), int(number[a]))
                if key is not None and now != key:
                    out = out or self._open(files, inside, name)
                    at += out.write(close(key, held))
                    held = []
                key = now
                held.append(np.stack((channel[a:b].astype(float), frame[a:b].astype(float), value[a:b].astype(float))))
        if key is None:
            return Written("", 0, (0, 0), (0, 0))
        out = out or self._open(files, inside, name)
        at += out.write(close(key, held))
        tail = json.dumps(index).encode()
        out.write(tail + len(tail).to_bytes(TAIL, "little"))
        out.close()
        span = lambda a, b: (min(x[a] for x in index), max(x[b] for x in index))
        return Written(name, len(index), span("grp", "grp"), span("first", "last"))

    @staticmethod
    def _open(files: pafs.FileSystem, inside: str, name: str):
        files.create_dir(inside, recursive=True)
        return files.open_output_stream(f"{inside}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of the tasks that counted, then lets go of those of the table before."""
        files, inside = file_system(self.path)
        files.create_dir(inside, recursive=True)
        before = [x["name"] for x in _manifest(self.path)]
        names = [{"name": m.name, "grp": m.grp, "frame": m.frame} for m in messages if m is not None and m.blocks]
        pending = f"{inside}/_pending-{self.job}"
        with files.open_output_stream(pending) as f:
            f.write(json.dumps(names).encode())
        files.move(pending, f"{inside}/{MANIFEST}")
        for name in before:
            files.delete_file(f"{inside}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        files, inside = file_system(self.path)
        for m in messages:
            if m is not None and m.blocks:
                files.delete_file(f"{inside}/{m.name}")


def _manifest(path: str) -> list[dict]:
    files, inside = file_system(path)
    if files.get_file_info(f"{inside}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with files.open_input_file(f"{inside}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    name: str | None


class _Reader(DataSourceReader):
    """A file is a partition; files, blocks and channels that no filter wants are not read."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.wanted = Wanted({"grp": Bounds(), "frame": Bounds(), "channel": Bounds()})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted.take(filters)
        yield from filters

    def partitions(self) -> list[InputPartition]:
        w = self.wanted.columns
        return [_File(x["name"]) for x in _manifest(self.path) if w["grp"].wants(*x["grp"]) and w["frame"].wants(*x["frame"])] or [_File(None)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        w = self.wanted.columns
        files, inside = file_system(self.path)
        with files.open_input_file(f"{inside}/{partition.name}") as f:
            size = f.size()
            length = int.from_bytes(f.read_at(TAIL, size - TAIL), "little")
            for about in json.loads(f.read_at(length, size - TAIL - length)):
                channels = w["channel"].among(about["channels"])
                if not channels or not w["grp"].wants(about["grp"], about["grp"]) or not w["frame"].wants(about["first"], about["last"]):
                    continue
                values = unpacked(f.read_at(about["size"], about["at"]), about)
                for channel in channels:
                    row = values[about["channels"].index(channel)]
                    at = np.flatnonzero(~np.isnan(row))
                    arrays = [pa.array(np.full(len(at), about["grp"], np.int64)), pa.array(np.full(len(at), channel, np.int32)), pa.array(about["first"] + at), pa.array(row[at])]
                    yield pa.RecordBatch.from_arrays(arrays, ["grp", "channel", "frame", "value"])


def write_blocks(trace: DataFrame, path: str, block: int, step: float | None = None) -> None:
    """Writes ``(grp, channel, frame, value)`` as blocks of ``block`` frames, in place of what is at the path (SNK1).

    Values are rounded to whole steps, of ``step`` or of 1/32767 of the channel's largest value in the block.
    Null and NaN values are absent rows. A task sorts blocks and holds one, however long a group is.
    """
    spark = trace.sparkSession
    spark.dataSource.register(TraceBlocks)
    rows = trace.select(F.col("grp").cast("long"), F.col("channel").cast("int"), F.col("frame").cast("long"), F.col("value").cast("float")).where("value is not null and not isnan(value)")
    number = F.floor(F.col("frame") / F.lit(block))
    rows = rows.repartition("grp", number).sortWithinPartitions("grp", number, "channel", "frame")
    options = {"path": path, "block": str(block)} | ({} if step is None else {"step": repr(step)})
    rows.write.format("trace_blocks").options(**options).mode("overwrite").save()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(grp, channel, frame, value)`` of a table of blocks; filters on group, channel and frame spare files and blocks."""
    enable(spark)
    spark.dataSource.register(TraceBlocks)
    return spark.read.format("trace_blocks").option("path", path).load()

"""Readers of raw acquisitions: channel maps, settings, sync anchors, session trees, raw samples, parameters."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.window import Window

from chronoweave.sources.pushdown import Bounds, Wanted, enable

PER_GROUP = 4
_STREAM = "CUSTOM_PARAMETERS struct<STREAM: struct<CH: array<struct<_index: int, _enabled: int>>>>"
_PROCESSOR = f"_name string, {_STREAM}"


def channel_map(xml: DataFrame, text_col: str = "value") -> DataFrame:
    """``(pos, oe_index, enabled, tetrode)`` of the ``Channel Map`` processor in a settings text (SRC1).

    Tetrode k holds positions 4(k - 1) to 4k - 1; channels of an incomplete last tetrode are left out.
    """
    one = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)(<PROCESSOR\b.*?</PROCESSOR>)"), 1)
    processors = xml.select(F.explode(one).alias("x")).select(F.from_xml("x", _PROCESSOR).alias("p")).where("p._name = 'Channel Map'")
    channels = processors.select(F.posexplode("p.CUSTOM_PARAMETERS.STREAM.CH").alias("pos", "ch"), F.size("p.CUSTOM_PARAMETERS.STREAM.CH").alias("n"))
    whole = F.col("pos") < F.col("n") - F.col("n") % PER_GROUP
    return channels.where(whole).select(
        "pos", F.col("ch._index").alias("oe_index"), F.col("ch._enabled").alias("enabled"), (F.floor(F.col("pos") / PER_GROUP) + 1).cast("int").alias("tetrode")
    )


def settings_name(experiment: int | str) -> str:
    """Settings file of an experiment: the first has no number (SRC2)."""
    number = int(re.sub(r"\D", "", str(experiment)) or 0)
    if number < 1:
        raise ValueError(f"experiments count from 1, not {experiment!r}")
    return "settings.xml" if number == 1 else f"settings_{number}.xml"


def settings_names(experiment: Column) -> Column:
    """As :func:`settings_name`, of a column; null where there is no number from 1 on."""
    number = F.regexp_replace(experiment.cast("string"), r"\D", "").try_cast("int")
    return F.when(number == 1, "settings.xml").when(number > 1, F.concat(F.lit("settings_"), number.cast("string"), F.lit(".xml")))


def settings_for_block(folder: str, block: int) -> str:
    """Path of the settings of the ``block``-th experiment folder, in numeric order (SRC2); in any file system."""
    files, inside = file_system(folder)
    names = [x.base_name for x in files.get_file_info(pafs.FileSelector(inside))]
    numbers = sorted(int(m[1]) for name in names if (m := re.fullmatch(r"experiment(\d+)", name)))
    if not 0 <= block < len(numbers):
        raise IndexError(f"block {block} of {len(numbers)}")
    return f"{folder.rstrip('/')}/{settings_name(numbers[block])}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*:/", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def attach_map(channels: DataFrame, mapping: DataFrame, selected: list[int] | None = None, spacing: float = 300.0, geometry: bool = True) -> DataFrame:
    """Channels in map order with group, label and place (PRJ2).

    channels: ``(oe_index, channel)``. group counts the requested tetrodes from 0, in the requested order.
    A map index that no channel has is an error when the result is computed.
    """
    wanted = selected if selected is not None else None
    m = mapping if wanted is None else mapping.where(F.col("tetrode").isin(wanted))
    if wanted is None:
        group = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("tetrode")) - 1  # a row per channel
    else:
        group = F.array_position(F.array(*map(F.lit, wanted)), F.col("tetrode")) - 1
    x = m.withColumn("grp", group.cast("int")).join(channels, "oe_index", "left")
    known = F.when(F.col("channel").isNull(), F.raise_error(F.lit("channel map and recording are inconsistent")).cast("string")).otherwise(F.col("channel"))
    out = x.select("grp", "pos", "oe_index", "enabled", known.alias("channel"), F.concat(F.lit("TT"), F.col("tetrode").cast("string")).alias("label"))
    if geometry:
        out = out.withColumns({"x": F.col("grp") * F.lit(spacing) + (F.col("pos") % 2) * 10.0, "y": F.floor((F.col("pos") % PER_GROUP) / 2) * 10.0})
    return out


def lead_channels(channels: DataFrame) -> DataFrame:
    """First channel of each group (PRJ3)."""
    if not {"grp", "label"} & set(channels.columns):
        raise ValueError("channels have neither a group nor a label")
    by = "grp" if "grp" in channels.columns else "label"
    return channels.groupBy(by).agg(F.min_by("channel", "pos").alias("channel"))


def software_time(line: Column) -> Column:
    """Seconds of the epoch in a sync message, null where there is none (SRC7)."""
    found = F.nullif(F.regexp_extract(line, r"Software Time[^:]*:\s*(\d+)", 1), F.lit(""))
    return found.try_cast("bigint") / 1000


def detect_threshold(line: Column, default: float = 5.0) -> Column:
    """The number after ``detect_threshold:``, else the default (SRC17)."""
    found = F.nullif(F.regexp_extract(line, r"detect_threshold:\s*([-+0-9.eE]+)", 1), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(default))


def find_recording(segments: DataFrame, experiment: int, recording: int) -> DataFrame:
    """The one segment of a pair; an error that lists the pairs at hand if there is none (SRC3)."""
    found = segments.where((F.col("experiment") == experiment) & (F.col("recording") == recording))
    if not found.limit(1).count():
        pairs = [tuple(r) for r in segments.select("experiment", "recording").distinct().orderBy("experiment", "recording").limit(1000).collect()]
        raise KeyError(f"no recording ({experiment}, {recording}); there are {pairs}")
    return found


def session_tree(files: DataFrame) -> DataFrame:
    """Catalog of a session from its files' paths and lengths: node, experiment, recording, stream, bytes (SRC4, SRC8).

    files: ``(path, length)``, as the ``binaryFile`` reader gives them.
    """
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    x = files.select(
        part(r"/(Record Node[^/]*)/").alias("node"), part(r"/experiment(\d+)/").cast("int").alias("experiment"), part(r"/recording(\d+)/").cast("int").alias("recording"),
        part(r"/continuous/([^/]+)/").alias("stream"), "length",
    )
    return x.where("stream <> ''").groupBy("node", "experiment", "recording", "stream").agg(F.sum("length").alias("bytes"))


@dataclass
class ExperimentParams:
    """Parameters of an experiment (D16); unknown keys of a file are ignored (SRC16), ``t0`` is derived (SNK7)."""

    subject: str
    experiment: str
    timezone: str = "UTC"
    openephys_session: str | None = None
    lfp_store: str | None = None
    t0_unix: float | None = None
    lightsOn: list[str] = field(default_factory=list)
    lightsOff: list[str] = field(default_factory=list)
    novel_objects_start: str | None = None
    novel_objects_end: str | None = None
    badChannels: list[str] = field(default_factory=list)
    badTetrodes: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> ExperimentParams:
        files, inside = file_system(path)
        with files.open_input_file(inside) as f:
            raw = json.loads(f.read())
        return cls(**{k: v for k, v in raw.items() if k in {x.name for x in fields(cls)}})

    def save(self, path: str) -> None:
        from datetime import UTC, datetime

        out = asdict(self)
        if self.t0_unix is not None:
            out["t0"] = datetime.fromtimestamp(self.t0_unix, UTC).isoformat()
        files, inside = file_system(path)
        files.create_dir(os.path.dirname(inside), recursive=True)
        with files.open_output_stream(inside) as f:
            f.write(json.dumps(out, indent=2).encode())


def params_of(text: Column) -> Column:
    """Experiment parameters of JSON texts as a struct, with the defaults of :class:`ExperimentParams` (SRC16); null for no JSON."""
    kinds = {"t0_unix": "double", "lightsOn": "array<string>", "lightsOff": "array<string>", "badChannels": "array<string>", "badTetrodes": "array<string>"}
    names = [x.name for x in fields(ExperimentParams)]
    raw = F.from_json(text, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))
    empty = lambda n: F.array().cast("array<string>") if kinds.get(n) == "array<string>" else F.lit("UTC")
    held = [F.coalesce(raw[n], empty(n)) if n == "timezone" or kinds.get(n) == "array<string>" else raw[n] for n in names]
    return F.when(raw.isNotNull(), F.struct(*[x.alias(n) for x, n in zip(held, names, strict=True)]))


def experiment_path(subject: str, experiment: str, root: str = "data") -> str:
    return "/".join((root, subject, experiment, "experiment_params.json"))


def experiment_paths(subject: Column, experiment: Column, root: str = "data") -> Column:
    """As :func:`experiment_path`, of columns."""
    return F.concat_ws("/", F.lit(root), subject, experiment, F.lit("experiment_params.json"))


def session_seconds(local: Column, zone: str, t0: float) -> Column:
    """Seconds since the session's start of a naive local time in a zone (FN2)."""
    return F.unix_micros(F.to_utc_timestamp(local, zone)) / 1e6 - t0


def local_time(seconds: Column, zone: str, t0: float) -> Column:
    """Back from session seconds to a naive local time (FN2)."""
    return F.from_utc_timestamp(F.timestamp_micros(((seconds + t0) * 1e6).cast("long")), zone)


@dataclass
class _Chunk(InputPartition):
    first: int
    last: int


class RawSamples(DataSource):
    """Little-endian int16 samples, frame by frame: ``spark.read.format("raw_samples")`` (SRC5, SRC6).

    The path may be a URI of any file system that Arrow knows (``file:``, ``hdfs:``, object stores).

    Options: path, channels (in a frame), gains (comma-separated, or one), selected (channel numbers, in
    order), start and end frames, chunk (frames in a partition). Rows are (channel, frame, value): only the
    selected channels and frames are read, a partition at a time. Filters on frame spare partitions and reads,
    filters on channel spare rows.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_samples"

    def schema(self) -> str:
        return "channel int, frame long, value float"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.channels = options["path"], int(options["channels"])
        gains = [float(x) for x in options.get("gains", "1").split(",")]
        self.gains = gains * self.channels if len(gains) == 1 else gains
        self.selected = [int(x) for x in options.get("selected", ",".join(map(str, range(self.channels)))).split(",")]
        if bad := [c for c in self.selected if not 0 <= c < self.channels]:
            raise ValueError(f"no channels {bad} among {self.channels}")
        files, inside = file_system(self.path)
        frames = files.get_file_info(inside).size // (2 * self.channels)
        self.first, self.last = int(options.get("start", 0)), min(int(options.get("end", frames)), frames)
        self.chunk = int(options.get("chunk", 1 << 20))
        self.wanted = Wanted({"channel": Bounds(), "frame": Bounds()})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted.take(filters)
        frame = self.wanted.columns["frame"]
        self.first = self.first if frame.low is None else max(self.first, frame.low)
        self.last = self.last if frame.high is None else min(self.last, frame.high + 1)
        self.selected = self.wanted.columns["channel"].among(self.selected)
        yield from filters

    def partitions(self) -> list[InputPartition]:
        frame = self.wanted.columns["frame"]
        cut = [(a, min(a + self.chunk, self.last)) for a in range(self.first, self.last, self.chunk)] if self.selected else []
        return [_Chunk(a, b) for a, b in cut if frame.wants(a, b - 1)] or [_Chunk(0, 0)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // max(1, len(self.selected)))
        files, inside = file_system(self.path)
        gain = np.array([self.gains[c] for c in self.selected], np.float32)
        with files.open_input_file(inside) as f:
            for a in range(partition.first, partition.last, step):
                b = min(a + step, partition.last)
                data = f.read_at(2 * (b - a) * self.channels, 2 * a * self.channels)
                raw = np.frombuffer(data, "<i2").reshape(-1, self.channels)
                value = raw[:, self.selected].astype(np.float32) * gain
                frame = np.repeat(np.arange(a, b), len(self.selected))
                channel = np.tile(np.array(self.selected, np.int32), b - a)
                yield pa.RecordBatch.from_arrays([pa.array(channel), pa.array(frame), pa.array(value.ravel())], ["channel", "frame", "value"])


def read_raw(spark: SparkSession, path: str, channels: int, **options) -> DataFrame:
    enable(spark)
    spark.dataSource.register(RawSamples)
    return spark.read.format("raw_samples").options(path=path, channels=str(channels), **{k: str(v) for k, v in options.items()}).load()


def with_layout(trace: DataFrame, layout: str) -> DataFrame:
    """Long rows, rows of a group with an array over its channels, or of a frame with all of them (SRC5, D2)."""
    if layout == "long":
        return trace
    by = {"grouped": ["grp", "frame"], "wide": ["frame"]}.get(layout)
    if by is None:
        raise ValueError(f"unknown layout {layout!r}")
    values = F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda s: s["value"])
    return trace.groupBy(*by).agg(values.alias("values"))

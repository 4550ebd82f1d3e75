"""Operator 3: SentencePiece encoding and decoding.

The pieces' Aho-Corasick automaton drives a single-pass Viterbi programme (see :mod:`pieces`). Work is a
map over documents: no shuffle, one Arrow batch in memory, a lost executor's tasks simply run again. The
model file (size-checked) goes to the executors with the task.

Cases: a null or empty text has no pieces and decodes to the empty text; a null doc_id is kept; repeated
rows give repeated results; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.pieces import PieceModel, loaded, read_model
from chronoweave.plans.storage import pick

MODEL = "piece_bpe_32k.model"
#: Rows handled at once within an Arrow batch.
ROWS = 256


def model_bytes(path: str | None = None) -> bytes:
    return read_model(path or str(public_tokenizers.path(MODEL)))


def _encoded(model: PieceModel, texts: pa.Array) -> tuple[list[str | None], list[bytes]]:
    plain = texts.to_pylist()
    return plain, [model.encode_bytes(t) for t in plain]


def _lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(coded) + 1, dtype=np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=ends[1:])
    values = np.frombuffer(b"".join(coded), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""
    raw = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                _, coded = _encoded(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(coded)], ["doc_id", "ids"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of every list of piece ids; a null list gives a null text."""
    raw = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [None if ids is None else model.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = pick(coded, id_col, ids_col).toDF("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Encode and decode in one pass.

    ``(doc_id, n_pieces, ids, ids_sha256, decoded_sha256, exact)``: ids_sha256 digests the ids as 32-bit
    little-endian integers, decoded_sha256 the decoded text; exact: the decoded text equals the text (its
    U+2581, if any, as spaces; null as empty). ``with_ids=False`` leaves out the ids.
    """
    raw = model_bytes(model_path)
    names = ["doc_id", "n_pieces", *["ids"] * with_ids, "ids_sha256", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                plain, coded = _encoded(model, part.column(1))
                back = [model.decode(memoryview(c).cast("i")) for c in coded]
                exact = [b == (t or "").replace("▁", " ") for b, t in zip(back, plain, strict=True)]
                columns = [
                    part.column(0),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    *[_lists(coded)] * with_ids,
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array(exact),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = "ids array<int>, " if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces long, {ids}ids_sha256 string, decoded_sha256 string, exact boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

"""Operator 4: token counts by prefix dynamic programming.

The programme of :mod:`pieces` stores the exact count at every prefix of a chunk, and chunks add up, so
counts, truncation points and budget questions are answered without encoding anything again. A map over
documents, without shuffle.

Cases: a null or empty text has no tokens and no bytes; a null doc_id is kept; repeated rows give repeated
results; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.pieces import loaded
from chronoweave.llm.sentencepiece_codec import ROWS, model_bytes
from chronoweave.plans.storage import pick

LIMIT = 4096


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, model_path: str | None = None
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)``; fit_chars: characters of the longest prefix of at most ``limit`` tokens."""
    raw = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [model.count(t) for t in texts]
                fits = [len(t) if n <= limit else model.fit(t, limit) for t, n in zip(texts, counts, strict=True)]
                columns = [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                    pa.array(fits, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``(doc_id, counts array<int>)``: tokens of every prefix of each text, the empty one first."""
    raw = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = [list(model.prefix_counts(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

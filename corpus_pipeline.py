"""A corpus clean-up pipeline of training-data operators, stage after stage over Parquet tables.

Each stage works on all that the one before it kept: toxic documents go, repeated lines go from texts, one
document of each group of near-duplicates stays, contaminated documents go, and what is left is encoded.

Cases: a null text is no toxic sentence, no line and no benchmark item; it stays null up to the encoder, which
gives it no pieces, and is a near-duplicate of other texts without words, of which one stays. Rows with a null doc_id pass all
stages like others, but where near copies of theirs have doc_ids, one of those stays. Rows alike in doc_id and
text stay or go together, but for near-duplicates of a smaller doc_id; ties in any order go to the smaller doc_id. Texts are taken whole. Extra columns stay, whatever their names, up to the
encoder. Empty ``documents`` give an empty result; with no labels, or labels of one kind, no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.decontaminate import remove_contaminated
from chronoweave.llm.line_dedup import dedup_lines
from chronoweave.llm.sentencepiece_codec import round_trip
from chronoweave.llm.simhash import keep_one
from chronoweave.llm.toxicity import reject_toxic
from chronoweave.plans.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, trained on ``labels``, doesn't reject."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of windows of three lines."""
    return dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, reworded or not."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document left."""
    return round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Training and Viterbi encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs

"""Row keys for operators that send findings back to their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from chronoweave.plans.storage import broadcast_if_small, materialize

#: Missing doc_ids sort after all others and count as one document.
LAST = (1 << 63) - 1
INTEGERS = (ByteType, ShortType, IntegerType, LongType)
#: Metadata of t where doc_ids repeat.
REPEATED = "repeated"
#: Doc_ids that are sent to every executor rather than joined by shuffle, at most.
MAX_BROADCAST_IDS = 500_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(doc_id, text, k, t)``, and with ``whole`` every input column too as ``_c0``, ``_c1``, ...

    k orders documents as their doc_ids are ordered, whatever the type; doc_ids that are no integers are
    numbered in their order first. (k, t) names a row. t tells apart rows that share a doc_id by their text;
    where no two do (one job over the doc_ids finds out) it is 0 everywhere and costs nothing in a shuffle.
    Rows alike in doc_id and text share a key.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    rest = rows.columns if whole else []
    if not isinstance(rows.schema[f"_c{names.index(id_col)}"].dataType, INTEGERS):
        ids = rows.select(doc_id.alias("_id")).where("_id is not null").distinct().orderBy("_id")
        ids = materialize(ids.withColumn("_k", F.monotonically_increasing_id()), "doc-ids")
        rows = rows.join(ids, doc_id == F.col("_id"), "left")
        k = F.coalesce("_k", F.lit(LAST))
    else:
        k = F.coalesce(doc_id.cast("long"), F.lit(LAST))
    repeated = rows.select(k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    t = text_hash(text) if repeated else F.lit(0).cast("long")
    return rows.select(*rest, doc_id.alias("doc_id"), text.alias("text"), k.alias("k"), t.alias("t", metadata={REPEATED: bool(repeated)}))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a written table ``(doc_id, t)`` doesn't name by doc_id and the text's hash.

    A null doc_id matches null, and a null text counts as empty; all columns of ``docs`` stay as they are.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    gone = broadcast_if_small(gone.toDF("_gone", "_t"), MAX_BROADCAST_IDS)
    # the hash is the equi-join key: it spreads rows without a doc_id too
    same = (text_hash(text) == F.col("_t")) & doc_id.eqNullSafe(F.col("_gone"))
    return rows.join(gone, same, "left_anti").toDF(*names)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))

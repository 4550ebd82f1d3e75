"""Operator 1: line dedup over overlapping windows of three lines.

Lines end at newlines and are compared as they are. Each three consecutive lines are a window, known by a
96-bit hash. The first occurrence of a window (smallest doc_id, then smallest position) stays; later ones,
in the same document or another, are removed: a line goes if any later occurrence covers it.

Windows are counted with map-side pre-aggregation, and only those that repeat meet their occurrences again
in a plain equi-join, which adaptive execution splits where one window holds many rows. Texts are shuffled
once, to meet their findings.

Cases: a null text stays null with no lines; an empty text is one empty line; documents of one or two lines
have no window and stay whole; rows that share a doc_id are one document, so what occurs first in it stays
in each of them; null doc_ids sort last and count as one document; extra columns of the input are kept by
:func:`dedup_lines` and ignored by :func:`line_findings`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.rowkeys import keyed
from chronoweave.plans.storage import materialize

WINDOW = 3
#: Lines of a document at most, as a power of two; orders (document, line) in one number.
LINES = 1 << 31


def _windows(rows: DataFrame) -> DataFrame:
    """``(k, t, pos, h1, h2)`` of every window."""
    lines = rows.select("k", "t", F.split("text", "\n", -1).alias("lines"))
    full = lines.where(F.size("lines") >= WINDOW)
    at = F.sequence(F.lit(0), F.size("lines") - WINDOW)

    def hashed(i):
        window = [F.get("lines", i + j) for j in range(WINDOW)]
        return F.struct(F.xxhash64(*window).alias("h1"), F.hash(*window).alias("h2"))

    hashes = full.select("k", "t", F.transform(at, hashed).alias("hashes"))
    # outer: an inner explode makes the optimizer repeat the whole expression in a filter below
    spread = hashes.select("k", "t", F.posexplode_outer("hashes").alias("pos", "h"))
    return spread.select("k", "t", "pos", "h.h1", "h.h2")


def _order():
    return F.col("k").cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)") + F.col("pos")


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` with n_lines, n_removed and kept."""
    windows = _windows(rows)
    # one number per occurrence keeps the aggregation in fixed-width buffers (hash aggregation)
    first = windows.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own: the join then has an exchange on both sides, and a hot window's rows can be split
    first = materialize(first, "repeated-lines")
    later = windows.join(first, ["h1", "h2"]).where(_order() > F.col("first"))
    found = later.groupBy("k", "t").agg(F.collect_set("pos").alias("starts"))
    joined = rows.join(found, ["k", "t"], "left").withColumn("lines", F.split("text", "\n", -1))
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + j for j in range(WINDOW)])))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    parts = joined.withColumn("left", F.when(F.col("starts").isNotNull(), left))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    removed = F.when(F.col("left").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long")
    return parts.withColumns({"n_lines": n, "n_removed": removed, "kept": F.when(F.col("left").isNull(), F.col("text")).otherwise(kept)})


def line_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)`` of every row; kept is the text without the lines removed."""
    return _kept(keyed(docs, id_col, text_col)).select("doc_id", "n_lines", "n_removed", "kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text replaced by what :func:`line_findings` keeps of it, all other columns as they are."""
    place = docs.columns.index(text_col)
    out = _kept(keyed(docs, id_col, text_col, whole=True))
    return out.select(*["kept" if i == place else f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), p AS (
    SELECT doc_id, lines, unnest(range(1, greatest(len(lines) - 1, 1))) AS i FROM l
), w AS (
    SELECT doc_id, i,
        row_number() OVER (PARTITION BY lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] ORDER BY doc_id, i) AS rn
    FROM p
), c AS (
    SELECT DISTINCT doc_id, i + j AS pos FROM w CROSS JOIN (VALUES (0), (1), (2)) v(j) WHERE rn > 1
), n AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l
)
SELECT n.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
    sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.pos = c.pos
GROUP BY n.doc_id
"""

"""Operator 10: approximate nearest neighbours by cross-polytope hashing.

Each table applies fast pseudo-rotations (sign flips and Hadamard transforms, three times) to the unit
vectors and assigns each to the nearest signed axis. A query probes, in every table, the axes nearest to
it; the vectors found there are ranked exactly. With 4 tables and 24 of 128 axes probed, near-random
vectors of 64 components keep a recall above 0.95 (measured against brute force in tests and README).

Work is done in blocks: an axis is cut by the hash of vec_id into blocks of about ``BLOCK`` candidates and
``BLOCK`` queries, whatever its size, so no task holds more than two blocks, and a block gives the nearest
few of each query instead of its pairs. Equal vectors are ranked by vec_id, so of each distinct vector only
the ``k`` + 1 smallest vec_ids can be answers; the others are dropped before the tables are built, which
is exact and leaves large groups of copies with a few rows. Queries that meet fewer than k vectors, though
more of their length exist, are ranked against all of these.

Cases: vectors that are null, zero or hold null or non-finite components take no part, and no query of
theirs has rows; vectors of different lengths are never compared; fewer than k candidates: all are given;
null vec_ids take no part; ties go to the smaller vec_id; rows that repeat a vec_id count once, with the smallest vector; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.storage import materialize, pick

TABLES = 4
#: Axes probed in each table, as a share of all signed axes.
PROBED = 24 / 128
NEAREST = 5
EVERY = 50
#: Candidates or queries in a block.
BLOCK = 4096
SEED = 20240
#: Candidates of a block that are ranked anew with one fixed order of summing, and those within this of the last of them.
RERANKED = 16
ROUNDING = 1e-9
#: Candidates whose components are gathered at once.
TIED = 1 << 14


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of every row (a power of two long), by butterflies."""
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(rows, size)
        step *= 2
    return x / np.sqrt(size)


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of unit rows for a table, padded to a power of two."""
    size = max(2, 1 << (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, table, size]).choice([-1.0, 1.0], (3, size))
    for flip in signs:
        x = _hadamard(x * flip)
    return x


def axes(unit: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The nearest signed axes of every row, best first: axis i is 2i, its opposite 2i + 1."""
    x = rotated(unit, table)
    both = np.stack((x, -x), axis=2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes] if probes > 1 else both.argmax(axis=1)[:, None]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part, one of each vec_id."""
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _spread(queries: bool, probed: float):
    """Rows of a vector in each table (and, for queries, at each probed axis)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            sizes = np.array([len(x) for x in raw.to_pylist()])
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(chosen))
                v = _matrix(part.column(1))
                unit = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                width = max(2, 1 << (unit.shape[1] - 1).bit_length())
                probes = max(1, int(np.ceil(2 * width * probed))) if queries else 1
                for table in range(TABLES):
                    found = axes(unit, table, probes)
                    keys = (np.int64(size // 8) << 40) + (np.int64(table) << 32) + found.ravel()
                    rows = pa.array(np.repeat(np.arange(len(chosen)), found.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), part.column(0).take(rows), part.column(1).take(rows)], ["key", "vec_id", "raw"]
                    )

    return run


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, summed in the same order for equal rows."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _rank_block(keep: int):
    """Nearest candidates of the queries of one block; a group holds both."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flags = table.column("is_query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        rows = _matrix(table.column("raw").combine_chunks() if table.num_rows else table.column("raw"))
        q, c = np.flatnonzero(flags), np.flatnonzero(~flags)
        c = c[np.argsort(ids[c], kind="stable")]
        out_q, out_c, out_s = [], [], []
        # by powers of two, so that no square overflows or vanishes and cosines keep every bit
        if len(rows):
            rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
        norm = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        wide = max(keep, RERANKED)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            if not len(c):
                break
            near = norm[part] @ norm[c].T
            near[ids[part][:, None] == ids[c][None, :]] = -np.inf
            last = -np.partition(-near, min(wide, len(c)) - 1, axis=1)[:, min(wide, len(c)) - 1]
            row, column = np.nonzero((near >= last[:, None] - ROUNDING) & np.isfinite(near))
            a, b = part[row], c[column]
            # thousands may tie at the cut: their components are gathered a slice at a time
            cut = range(0, max(1, len(a)), TIED)
            score = np.concatenate([_cosines(rows[a[s : s + TIED]], rows[b[s : s + TIED]]) for s in cut])
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            first = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1)) if len(a) else np.zeros(0, int)
            number = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate((first, [len(a)]))))
            best = number < keep
            out_q.append(ids[a[best]])
            out_c.append(ids[b[best]])
            out_s.append(score[best])
        gather = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query_id": gather(out_q, np.int64), "vec_id": gather(out_c, np.int64), "score": gather(out_s, np.float64)})

    return run


def nearest(
    vectors: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found of every row whose vec_id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector_col)
    to_bytes = rows.mapInArrow(_pack, "vec_id long, raw binary")
    to_bytes = materialize(to_bytes, "vectors")
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = to_bytes.withColumns({"h1": F.xxhash64("raw"), "h2": F.xxhash64(F.lit(1), "raw")})
    kept = kept.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("vec_id", "raw")
    asked = to_bytes.where(F.col("vec_id") % every == 0)
    index = materialize(kept.mapInArrow(_spread(False, probed), "key long, vec_id long, raw binary"), "axes")
    found = materialize(_ranked(index, materialize(asked.mapInArrow(_spread(True, probed), "key long, vec_id long, raw binary"), "probes"), k), "nearest")
    # queries whose axes hold too few are asked again of all vectors of their length: exact, in blocks as before
    width = F.length("raw").alias("key")
    whole = kept.select(width, "vec_id", "raw")
    most = whole.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("met"))
    # of itself and n vectors kept, a query has at least n - 1 to meet; a query that was dropped as a copy has n
    had = kept.select("vec_id", F.lit(1).alias("own"))
    few = asked.select(width, "vec_id", "raw").join(met, "vec_id", "left").join(F.broadcast(most), "key").join(had, "vec_id", "left")
    few = few.where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("n") - F.coalesce("own", F.lit(0))))
    few = materialize(few.select(F.col("key").cast("long"), "vec_id", "raw"), "queries-asked-again")
    if few.limit(1).count():
        again = _ranked(whole.select(F.col("key").cast("long"), "vec_id", "raw"), few, k)
        found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def _ranked(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the nearest ``k`` of the vectors of each query's keys; rows are (key, vec_id, raw)."""
    # tables x signed axes rows: how many blocks an axis takes
    cut = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = F.broadcast(cut(index, "cs").join(cut(probes, "qs"), "key"))
    c = index.join(blocks, "key").withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.col("cs")).cast("int"))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).withColumn("is_query", F.lit(False))
    q = probes.join(blocks, "key").withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("qs")).cast("int"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))).withColumn("is_query", F.lit(True))
    columns = ["key", "cb", "qb", "is_query", "vec_id", "raw"]
    both = c.select(*columns).unionByName(q.select(*columns))
    found = both.groupBy("key", "cb", "qb").applyInArrow(_rank_block(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their components."""
    for batch in batches:
        column = batch.column(1)
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        raw = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

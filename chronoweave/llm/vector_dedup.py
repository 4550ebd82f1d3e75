"""Operator 13: near-duplicate embeddings by int8 tile products with an error bound of each vector.

A unit vector x is stored as bytes q and a scale s; e = |x - s q| is its error, computed, not assumed. Then
x.y differs from s_x s_y q_x.q_y by at most e_x + (1 + e_x) e_y, so a pair whose product plus that bound stays
below the threshold can't link, and the bytes alone rule it out. Products of bytes are whole numbers that
floating-point matrix products hold exactly. Vectors are dealt to blocks; every two blocks meet once and are
multiplied tile by tile. First with bytes only: the result names the vectors of the two blocks that some pair
may link (at most one row each). Only these are sent again to their two blocks, with all components; the pairs
that the bound leaves open are computed in double precision, and those within rounding of the threshold once
more in a fixed order of summing. All links are found, none is guessed.

No pair becomes a row: two blocks give the number of links of a vector and a forest of their links (at most a
row each per vector), and forests have the components that all links have. Equal vectors enter once, with
their number, so copies cost nothing.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing and are kept;
vectors of different lengths never link; rows that repeat a vec_id count once, with the smallest usable
vector; rows without vec_id are left out; ties and copies go to the smallest vec_id; extra columns are
ignored; an empty table gives an empty result. Work grows with the square of the different vectors, at one byte a
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.ann import _cosines, _matrix, _pack
from chronoweave.operators.graph import connected_components
from chronoweave.plans.storage import broadcast_if_small, materialize, pick

THRESHOLD = 0.95
#: Vectors of a block, at most about; a small table has up to ``PARTS`` blocks, so that every core has work.
BLOCK = 1 << 17
PARTS = 12
SMALL_BLOCK = 2048
#: Rows of a tile.
TILE = 1024
#: What double rounding can add to a bound; it widens what is computed in full.
SLACK = 1e-6
#: A product this near the threshold is summed anew, in a fixed order.
ROUNDING = 1e-9
MAX_LENGTHS = 10_000


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by powers of two first, so that no square overflows or vanishes."""
    rows = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, error) of unit rows: ``error`` bounds the length of what the bytes leave out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, error


def open_pairs(qx: np.ndarray, sx: np.ndarray, ex: np.ndarray, qy: np.ndarray, sy: np.ndarray, ey: np.ndarray, threshold: float) -> np.ndarray | None:
    """Which pairs of two tiles the bound can't rule out; None where it rules out all."""
    kind = np.float32 if qx.shape[1] <= 1040 else np.float64  # 1040 x 127 x 127 < 2 to the 24th
    product = qx.astype(kind) @ qy.astype(kind).T
    least = (threshold - SLACK - ex - (1 + ex) * ey.max()) / sx
    if not (product.max(axis=1) * sy.max() >= least).any():
        return None
    open_ = product * sy >= least[:, None]
    return open_ if open_.any() else None


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
        for size in np.unique(sizes):
            part = batch.take(pa.array(np.flatnonzero(sizes == size)))
            q, scale, error = quantised(unit_rows(_matrix(part.column(1))))
            columns = [part.column(0), pa.array(np.full(len(q), size // 8, np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "q", "scale", "error"])


def _sides(key: tuple[pa.Scalar, ...], table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray, np.ndarray]:
    same = key[1].as_py() == key[2].as_py()
    side = table.column("side").to_numpy()
    q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(side), -1)
    a, b = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    return a, b, same, q, table.column("scale").to_numpy(), table.column("error").to_numpy()


def _tiles(a: np.ndarray, b: np.ndarray, same: bool, q: np.ndarray, scale: np.ndarray, error: np.ndarray, threshold: float):
    """(rows, rows, open pairs) of tiles that hold open pairs; of one block with itself, a pair once and none with itself."""
    for at in range(0, len(a), TILE):
        x = a[at : at + TILE]
        for to in range(at if same else 0, len(b), TILE):
            y = b[to : to + TILE]
            open_ = open_pairs(q[x], scale[x], error[x], q[y], scale[y], error[y], threshold)
            if open_ is not None and same and at == to:
                open_ = np.triu(open_, 1)
            if open_ is not None and open_.any():
                yield x, y, open_


def _flag(threshold: float):
    """The vectors of two blocks that are in open pairs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flagged = np.zeros(table.num_rows, bool)
        for x, y, open_ in _tiles(*_sides(key, table), threshold):
            flagged[x] |= open_.any(axis=1)
            flagged[y] |= open_.any(axis=0)
        some = table.filter(pa.array(flagged))
        keys = {name: pa.array(np.full(some.num_rows, key[i].as_py(), np.int32)) for i, name in enumerate(("size", "x", "y"))}
        return pa.table(keys | {"node": some.column("node"), "side": some.column("side")})

    return run


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the labels of positions a and b, pair by pair; a label is the smallest position that reaches it."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        x, y = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        to = np.arange(len(label))
        np.minimum.at(to, y, x)
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def _link(threshold: float):
    """Numbers of links (node, null, n) and a forest of the links (node, other, null) of the flagged vectors of two blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, same, q, scale, error = _sides(key, table)
        raw = _matrix(table.column("raw").combine_chunks())
        unit, node, copies = unit_rows(raw), table.column("node").to_numpy(), table.column("copies").to_numpy()
        n, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for x, y, open_ in _tiles(a, b, same, q, scale, error, threshold):
            x, y, open_ = x[rows := open_.any(axis=1)], y[columns := open_.any(axis=0)], open_[rows][:, columns]
            exact = unit[x] @ unit[y].T
            linked = open_ & (exact >= threshold)
            i, j = np.nonzero(open_ & (np.abs(exact - threshold) < ROUNDING))
            for part in range(0, len(i), TILE):
                p, r = i[part : part + TILE], j[part : part + TILE]
                linked[p, r] = _cosines(raw[x[p]], raw[y[r]]) >= threshold
            n[x] += linked @ copies[y]
            n[y] += copies[x] @ linked
            i, j = np.nonzero(linked)
            merge(label, x[i], y[j])
        some, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
        return pa.table(
            {
                "node": pa.array(np.concatenate((node[some], node[moved]))),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[label[moved]], pa.int64())]),
                "n": pa.concat_arrays([pa.array(n[some]), pa.nulls(len(moved), pa.int64())]),
            }
        )

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vec_id: links at a cosine of ``threshold`` (above 0) or more."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>")).where("vec_id is not null")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.when(good, F.col("v"))).alias("v"))
    packed = materialize(one.withColumn("v", F.coalesce("v", F.array().cast("array<double>"))).mapInArrow(_pack, "vec_id long, raw binary"), "vectors")
    usable = packed.where(F.length("raw") > 0)
    nodes = usable.groupBy("raw").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes, "different-vectors")
    bytes_ = nodes.select("node", "raw").mapInArrow(_packed_rows, "node long, size int, q binary, scale double, error double")
    bytes_ = materialize(bytes_, "quantised")
    n = F.count(F.lit(1))
    blocks = bytes_.groupBy("size").agg(F.greatest(F.ceil(n / BLOCK), F.least(F.lit(PARTS), F.ceil(n / SMALL_BLOCK))).cast("int").alias("blocks"))
    dealt = bytes_.join(broadcast_if_small(blocks, MAX_LENGTHS), "size").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side")]
    dealt = dealt.select("size", *pair, "node", "q", "scale", "error")
    flagged = dealt.groupBy("size", "x", "y").applyInArrow(_flag(threshold), "size int, x int, y int, node long, side int")
    flagged = materialize(flagged, "open-vectors")
    whole = flagged.join(bytes_.drop("size"), "node").join(nodes, "node")
    found = whole.groupBy("size", "x", "y").applyInArrow(_link(threshold), "node long, other long, n long")
    found = materialize(found, "vector-links")
    labels = connected_components(found.where("other is not null"), "node", "other")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    classes = nodes.join(labels, "node", "left").join(counts, "node", "left")
    classes = classes.select("raw", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # a table of its own: a large group of copies can then be split in the join
    members = usable.join(materialize(classes, "vector-classes"), "raw").select("vec_id", "n_links", "component_id")
    rest = packed.where(F.length("raw") == 0).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def keep_one_vector(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``vectors`` whose vec_id is the smallest of its near-duplicates; rows without vec_id stay."""
    gone = near_duplicate_vectors(vectors, id_col, vector_col, threshold).where("not kept").select(F.col("vec_id").alias("_gone"))
    names = vectors.columns
    rows = vectors.toDF(*[f"_c{i}" for i in range(len(names))])
    return rows.join(materialize(gone, "near-vectors"), F.col(f"_c{names.index(id_col)}") == F.col("_gone"), "left_anti").toDF(*names)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

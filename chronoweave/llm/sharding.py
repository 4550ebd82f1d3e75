"""Operator 5: sharding by vector bin packing.

Groups of equal texts are placed, largest first, into the shard whose residual capacity in bytes, tokens
and rows has the largest dot product with the group's own vector (each measure as a share of its total).
The law is ``bytes``: shards are near equal in bytes, and so, as far as groups allow, in tokens and rows.

What is packed is bounded whatever the input: groups of more than 1/``BUNDLES`` of any measure are items of
their own (at most 3 x ``BUNDLES`` exist), all others are hashed into ``BUNDLES`` bundles. A group of more
than a shard's fair share can't stay together; it is dealt by doc_id into parts of a quarter share. The
packing sees at most 4 x ``BUNDLES`` + 12 x shards sums; documents meet their shard in a map against that
bounded table, and no text is shuffled. Slots come from counts per shard and slice of documents, so no task
takes a whole shard.

Cases: a null text has no bytes (size 1), crc32 0 and shares a group with the empty text; a null doc_id is
placed and sorts first; repeated rows share a shard (if their group does) and take neighbouring slots; ties
go to the smaller shard; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.plans.storage import materialize, pick

SHARDS = 16
BUNDLES = 4096
#: Rows of a slice, about: slices of a shard are numbered apart, each by one task, and written as a file.
SLICE_ROWS = 1 << 18
#: Relative pull of the measures; the law is on bytes.
WEIGHTS = (1.0, 0.25, 0.25)
#: Rounds of moves and swaps that even out what the greedy placement leaves.
ROUNDS = 2000


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every item: largest item first, to the largest dot product with what a shard has left."""
    total = np.maximum(vectors.sum(axis=0), 1e-12)
    share = vectors / total * np.sqrt(np.array(WEIGHTS[: vectors.shape[1]]))
    residual = np.tile(share.sum(axis=0) / shards, (shards, 1))
    place = np.zeros(len(vectors), dtype=np.int64)
    for item in np.lexsort((np.arange(len(share)), -share[:, 0])):
        best = int(np.argmax(np.round(residual @ share[item] / max(share[item] @ share[item], 1e-300), 12)))
        place[item] = best
        residual[best] -= share[item]
    return _even(vectors[:, 0], place, shards)


def _even(size: np.ndarray, place: np.ndarray, shards: int) -> np.ndarray:
    """Moves an item from the fullest shard to the emptiest while that narrows their gap in bytes."""
    load = np.bincount(place, size, shards)
    for _ in range(ROUNDS if len(size) else 0):
        full, empty = int(np.argmax(load)), int(np.argmin(load))
        gap = load[full] - load[empty]
        own, other = np.flatnonzero(place == full), np.flatnonzero(place == empty)
        order = other[np.argsort(size[other], kind="stable")]
        ladder = np.concatenate(([0.0], size[order]))
        # the item to give back (or none) that leaves the gap nearest to closed
        want = size[own] - gap / 2
        near = np.clip(np.searchsorted(ladder, want), 1, max(1, len(ladder) - 1)) if len(ladder) > 1 else np.zeros(len(own), int)
        below = np.maximum(near - 1, 0)
        pick_at = np.where(np.abs(ladder[near] - want) < np.abs(ladder[below] - want), near, below)
        moved = size[own] - ladder[pick_at]
        left = np.abs(gap - 2 * moved)
        best = int(np.argmin(left))
        if left[best] >= gap * (1 - 1e-9):
            break
        place[own[best]] = empty
        if pick_at[best]:
            place[order[pick_at[best] - 1]] = full
        load[full] -= moved[best]
        load[empty] += moved[best]
    return place


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, tokens, g1, g2)`` of every row; g1 and g2 name the group of equal texts."""
    rows = pick(docs, id_col, text_col, *[tokens_col] * bool(tokens_col))
    rows = rows.toDF("doc_id", "text", *["tokens"] * bool(tokens_col)).withColumn("text", F.coalesce("text", F.lit("")))
    tokens = F.coalesce("tokens", F.lit(0)) if tokens_col else F.size(F.split("text", "[\\x20\\t-\\r]+"))
    return rows.select(
        "doc_id",
        (F.octet_length("text") + F.lit(1)).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        tokens.cast("long").alias("tokens"),
        F.xxhash64("text").alias("g1"),
        F.xxhash64(F.lit(1), "text").alias("g2"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, id_col, text_col, tokens_col), "shard-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = rows.groupBy("g1", "g2").agg(*sums)
    total = rows.agg(*sums).first()
    whole = [total["bytes"] or 1, total["tokens"] or 1, total["rows"] or 1]
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(("bytes", "tokens", "rows"), whole, strict=True)])
    # at most 3 x BUNDLES groups hold more than 1 / BUNDLES of a measure
    heavy = groups.withColumn("share", share).where(F.col("share") > 1.0 / BUNDLES)
    parts = F.when(F.col("share") > 1.0 / shards, F.ceil(F.col("share") * (4 * shards))).otherwise(1)
    heavy = materialize(heavy.select("g1", "g2", parts.cast("int").alias("parts")), "shard-heavy")
    named = rows.join(F.broadcast(heavy), ["g1", "g2"], "left")
    named = named.withColumn("bundle", F.when(F.col("parts").isNull(), F.pmod("g1", F.lit(BUNDLES)))).withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).otherwise(0)
    )
    light = F.col("bundle").isNotNull()
    named = named.withColumns({"k1": F.when(light, F.col("bundle")).otherwise(F.col("g1")), "k2": F.when(light, F.lit(0)).otherwise(F.col("g2"))})
    key = ["k1", "k2", "part", "light"]
    named = named.withColumn("light", light).drop("parts", "bundle")
    items = named.groupBy(*key).agg(*sums).orderBy(*key).collect()  # bounded: see above
    vectors = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in items], dtype=np.float64).reshape(-1, 3)
    place = pack(vectors, shards)
    table = [(r["k1"], r["k2"], r["part"], r["light"], int(p)) for r, p in zip(items, place, strict=True)]
    placed = spark.createDataFrame(table, "k1 long, k2 long, part int, light boolean, shard int")
    out = named.join(F.broadcast(placed), key)
    return with_slots(out.select("doc_id", "size", "text_crc32", "shard", "g1"), -(-whole[2] // (shards * SLICE_ROWS)) * 4).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_slots(rows: DataFrame, slices: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard: documents are numbered in slices, each after those before it."""
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(slices)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))  # shards x slices rows
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "g1", "text_crc32")
    numbered = rows.withColumn("number", F.row_number().over(inside))
    return numbered.join(counts, ["shard", "slice"]).withColumn("slot", F.col("before") + F.col("number") - 1)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` to one folder per shard: files of about ``SLICE_ROWS`` rows, each a run of slots in order."""
    placed = assign(docs, shards, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    placed = placed.dropDuplicates(["_id", "_crc"])
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.drop("shard", "slot").join(placed, F.col(id_col).eqNullSafe(F.col("_id")) & (crc == F.col("_crc"))).drop("_id", "_crc")
    run = F.floor(F.col("slot") / F.lit(SLICE_ROWS))
    joined.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))

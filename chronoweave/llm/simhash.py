"""Operator 2: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. One differing bit changes one
count by one, so the Manhattan distance of two embeddings never exceeds their Hamming distance. The grid:
the segments form 7 blocks; two embeddings at Manhattan distance 4 or less agree on at least 3 blocks, so
they meet in the same cell of at least one of the 35 grids that three blocks span. Within a cell the
Manhattan distance bounds from below which pairs can link, and the fingerprints themselves decide.

Only distinct fingerprints enter the grids, so copies cost nothing, and a cell yields a spanning forest of
its links (at most one row per fingerprint) rather than its pairs. The forests of all cells have the same
components as all links, so none is lost. A cell's search drops what it has reached: a dense cell is read
a few times over instead of once per pair. Cells need 16 bytes for each distinct fingerprint in them; one of
more than ``CELL`` is dealt to blocks, and each pair of blocks is a cell of its own.

Cases: a null text counts as empty; texts without words have the fingerprint zero and link like any other;
rows with a null doc_id take part and get the component of their fingerprint (null if no row linked to them
has a doc_id); repeated rows give repeated results; extra input columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.anchors import mixed
from chronoweave.llm.rowkeys import text_hash, without
from chronoweave.operators.graph import connected_components
from chronoweave.plans.storage import materialize, pick

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENT_BITS = 2
BLOCKS = 7
AGREEING = BLOCKS - MAX_BITS
#: Wide fingerprints: words of 64 bits, differing bits of pairs that are tried first, and of pairs that are tried at all.
WIDE = 4
WIDE_SHINGLE = 5
WIDE_BITS = 46
FAR_BITS = 84
#: One in so many texts tells which shingles are frequent, and how many of these go last in the order of a set. Any order finds all links.
SAMPLED = 64
MAX_COMMON = 1 << 16
#: Cells that a text knows it has, to leave pairs to the smallest of their cells; pairs that share none of these are compared wherever they meet.
FIRSTS = 16
#: Rows of a cell whose pairs are all compared at once.
SMALL = 6
#: Rows of a cell that one task holds; a cell of more becomes cells of two blocks.
CELL = 1 << 17
#: Rows of hash bits counted at once.
BIT_ROWS = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles (A-Z lower-cased, split at ASCII white space), repeats included."""
    words = (text or "").encode("utf-8", errors="replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        part = hashes[at : at + BIT_ROWS]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; zero without words."""
    return int(majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every whole text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, one column each."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of every fingerprint in every grid."""
    counts = segment_counts(fps).astype(np.int64)
    block_of = np.arange(counts.shape[1]) * BLOCKS // counts.shape[1]
    code, size = [], []
    for block in range(BLOCKS):
        columns = np.flatnonzero(block_of == block)
        code.append(counts[:, columns] @ 3 ** np.arange(len(columns)))
        size.append(3 ** len(columns))
    out = []
    for number, chosen in enumerate(combinations(range(BLOCKS), AGREEING)):
        cell = np.zeros(len(fps), dtype=np.int64)
        for block in chosen:
            cell = cell * size[block] + code[block]
        out.append(cell * 64 + number)
    return np.concatenate(out), np.tile(fps, len(out))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Positions (a, b) of links that join what any links within the cell join."""
    embedded = segment_counts(fps).astype(np.int8)
    left = np.arange(1, len(fps))
    queue, links = [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        here = queue.pop()
        lower = np.abs(embedded[left] - embedded[here]).sum(axis=1)
        near = np.flatnonzero(lower <= MAX_BITS)
        near = near[np.bitwise_count(fps[left[near]] ^ fps[here]) <= MAX_BITS]
        if len(near):
            reached = left[near]
            links += [(here, int(x)) for x in reached]
            queue += reached.tolist()
            left = np.delete(left, near)
    return links


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the cells of a partition whose rows are sorted by cell."""
    held_cell, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = False
    batches = iter(batches)
    while not end:
        batch = next(batches, None)
        end = batch is None
        if not end:
            held_cell = np.concatenate((held_cell, batch.column(0).to_numpy()))
            held = np.concatenate((held, batch.column(1).to_numpy()))
        if not len(held):
            continue
        edges = np.concatenate(([0], np.flatnonzero(np.diff(held_cell)) + 1, [len(held)]))
        whole = len(edges) - 1 if end else len(edges) - 2  # the last cell may go on in the next batch
        sizes = np.diff(edges)[:whole]
        fps = held.view(np.uint64)
        pairs = edges[:whole][sizes == 2]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= MAX_BITS]
        a, b = [held[pairs]], [held[pairs + 1]]
        for at in np.flatnonzero(sizes > 2):
            first = edges[at]
            links = np.array(forest(fps[first : edges[at + 1]]), dtype=np.int64).reshape(-1, 2) + first
            a.append(held[links[:, 0]])
            b.append(held[links[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        held_cell, held = held_cell[edges[whole] :], held[edges[whole] :]


def _bounded(cells_: DataFrame, member: str) -> DataFrame:
    """The rows of cells, with cells of more than ``CELL`` rows as cells of every two blocks of theirs."""
    dense = cells_.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_blocks")).where("_blocks > 1")
    dense = materialize(dense, "dense-cells")
    if not dense.limit(1).count():
        return cells_
    names = [c for c in cells_.columns if c != "cell"]
    dealt = cells_.join(dense, "cell", "left").withColumn("_x", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks") - 1, F.lit(0)))))
    pair = F.xxhash64("cell", F.least("_x", "_y"), F.greatest("_x", "_y"))
    return dealt.select(F.when(F.col("_blocks").isNull(), F.col("cell")).otherwise(pair).alias("cell"), *names)


def links(distinct_fps: DataFrame) -> DataFrame:
    """``(a, b)``: links between different fingerprints that keep all components."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp = cells(batch.column(0).to_numpy().copy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64))], ["cell", "fp"])

    spread_out = _bounded(distinct_fps.mapInArrow(spread, "cell long, fp long"), "fp")
    sorted_cells = spread_out.repartition("cell").sortWithinPartitions("cell", "fp")
    return sorted_cells.mapInArrow(_cell_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``; component_id is the smallest doc_id that links reach, its own included."""
    found = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    classes = _classes(found.withColumnRenamed("fp", "node"), first.withColumnRenamed("fp", "node"), links(first.select("fp")))
    return classes.select("doc_id", F.col("node").alias("fp"), "component_id")


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """A SimHash of ``WIDE`` words of 64 bits; each word takes another mix of the same different shingle hashes."""
    out = np.zeros(WIDE, np.uint64)
    for word in range(WIDE if len(found) else 0):
        out[word] = majority(mixed(found * np.uint64(2 * word + 1) + np.uint64(word)) if word else found)
    return out


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, as many as any set of similarity 0.8 must share one of; of no shingles, zero.

    Such a set shares at least 0.8 of these n, so one of the first n - ceil(0.8 n) + 1 of either set, in any
    order that all sets agree on: here ``common`` (most common first) goes last, and hashes decide otherwise.
    """
    if not len(found):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(found), np.int64)
    if len(common):
        by = np.argsort(common)
        at = np.minimum(np.searchsorted(common, found, sorter=by), len(common) - 1)
        rank = np.where(common[by[at]] == found, len(common) - by[at], 0)
    return found[np.lexsort((found, rank))[: len(found) + 1 - -(-4 * len(found) // 5)]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of different hashes is 0.8 or more; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _wide_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows are near: the Manhattan distance of bit counts first, as it bounds from below, then the bits."""
    lower = np.abs(np.bitwise_count(a).astype(np.int16) - np.bitwise_count(b).astype(np.int16)).sum(axis=1)
    near = lower <= WIDE_BITS
    if near.any():
        near[near] = np.bitwise_count(a[near] ^ (b[near] if len(b) == len(a) else b)).sum(axis=1) <= WIDE_BITS
    return near


def _wide_forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """As :func:`forest`, of wide fingerprints."""
    left = np.arange(1, len(fps))
    queue, links = [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        here = queue.pop()
        near = _wide_near(fps[left], fps[here : here + 1])
        if near.any():
            reached = left[near]
            links += [(here, int(x)) for x in reached]
            queue += reached.tolist()
            left = left[~near]
    return links


def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the wide cells of a partition whose rows (cell, node, words) are sorted by cell and node."""
    names = ["cell", "node", *[f"f{i}" for i in range(WIDE)]]
    held = np.zeros((0, len(names)), np.int64)
    end = False
    batches = iter(batches)
    while not end:
        batch = next(batches, None)
        end = batch is None
        if not end:
            held = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in range(len(names))], axis=1)))
        if not len(held):
            continue
        cell, node = held[:, 0], held[:, 1]
        fps = np.ascontiguousarray(held[:, 2:]).view(np.uint64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(held)]))
        whole = len(edges) - 1 if end else len(edges) - 2  # the last cell may go on in the next batch
        sizes = np.diff(edges)[:whole]
        size = np.repeat(sizes, sizes)
        a, b = [], []
        for lag in range(1, min(SMALL, len(size))):  # cells of a few rows: all pairs at once
            first = np.flatnonzero((size[:-lag] <= SMALL) & (cell[: len(size) - lag] == cell[lag : len(size)]))
            first = first[_wide_near(fps[first], fps[first + lag])]
            a.append(node[first])
            b.append(node[first + lag])
        for at in np.flatnonzero(sizes > SMALL):
            first = edges[at]
            links = np.array(_wide_forest(fps[first : edges[at + 1]]), dtype=np.int64).reshape(-1, 2) + first
            a.append(node[links[:, 0]])
            b.append(node[links[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        held = held[edges[whole] :]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition sorted by its first column whose value there another row has too."""
    held = None
    batches = iter(batches)
    end = False
    while not end:
        batch = next(batches, None)
        end = batch is None
        if not end:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if held is None or not held.num_rows:
            continue
        cell = held.column(0).to_numpy()
        same = cell[1:] == cell[:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        whole = len(cell) if end else int(np.flatnonzero(cell == cell[-1])[0])
        if more[:whole].any():
            yield held.slice(0, whole).filter(pa.array(more[:whole]))
        held = held.slice(whole)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(numbers, first cells, rows) of each cell; rows (cell, node, words, n, label, firsts, ...) are sorted by cell and node."""
    numbers = WIDE + 4
    held = None
    batches = iter(batches)
    end = False
    while not end:
        batch = next(batches, None)
        end = batch is None
        if not end:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        cell = held.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
        whole = len(edges) - 1 if end else len(edges) - 2
        for first, last in zip(edges[:whole], edges[1 : whole + 1], strict=True):
            part = held.slice(first, last - first)
            firsts = np.full((part.num_rows, FIRSTS), cell[first], np.int64)
            for row, cells_ in zip(firsts, part.column(numbers).to_pylist(), strict=True):
                row[: len(cells_)] = cells_
            yield np.stack([part.column(i).to_numpy() for i in range(numbers)], axis=1), firsts, part
        held = held.slice(edges[whole])


def _candidates(rows: np.ndarray, firsts: np.ndarray, label: np.ndarray, i: int) -> np.ndarray:
    """Later rows of a cell that may be similar to row i and bear another label, but for pairs that a smaller cell has too."""
    fps, n = rows[:, 2 : 2 + WIDE].view(np.uint64), rows[:, 2 + WIDE]
    other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
    other = other[(5 * n[other] >= 4 * n[i]) & (5 * n[i] >= 4 * n[other])]
    other = other[np.bitwise_count(fps[other] ^ fps[i]).sum(axis=1) <= FAR_BITS]
    smaller = firsts[i][firsts[i] < rows[i, 0]]
    return other[~np.isin(firsts[other], smaller).any(axis=1)] if len(smaller) and len(other) else other


def _wide_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that :func:`_candidates` pairs."""
    for rows, firsts, part in _cells(batches):
        some = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            other = _candidates(rows, firsts, rows[:, -1], i)
            some[other] = True
            some[i] |= len(other) > 0
        if some.any():
            yield from part.filter(pa.array(some)).combine_chunks().to_batches()


def _set_links(sets: list[np.ndarray], rows: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Positions (a, b) of similar sets that join what any similar sets of different labels join, of the pairs that are this cell's."""
    n = np.array([len(x) for x in sets])
    start, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    label, links = rows[:, -1].copy(), []
    for i in range(len(sets) - 1):
        other = _candidates(rows, firsts, label, i)
        if not len(other):
            continue
        here = np.zeros(len(shingles), bool)
        here[code[start[i] : start[i] + n[i]]] = True
        if 4 * len(other) > len(sets):
            both = np.bincount(owner, here[code], len(sets)).astype(np.int64)[other]
        else:
            both = np.array([np.count_nonzero(here[code[start[j] : start[j] + n[j]]]) for j in other])
        for j in other[5 * both >= 4 * (n[i] + n[other] - both)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((i, int(j)))
    return links


def _common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, most common first, as a sample of the texts shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), shingle)).view(np.int64))], ["h"])

    sample = texts.where(F.pmod("node", F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    often = sample.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2").orderBy(F.col("c").desc(), "h").limit(MAX_COMMON)
    return np.array([r.h for r in often.collect()], np.int64).view(np.uint64)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, bits: bool = False) -> DataFrame:
    """``(doc_id, t, component_id)``, t the text's 64-bit hash, where texts link at a Jaccard similarity of 0.8 or more of their shingles.

    With ``bits`` texts link by :func:`near_duplicates` too, at fingerprints of ``MAX_BITS`` or fewer differing bits, and classes are those of both.

    At that similarity fingerprints differ in some 15 % of bits, too many for 64 bits to tell or for grids of
    segments to find. So texts meet in cells of a rare shingle (:func:`prefix`, which misses no link), and every
    link is a pair whose sets of shingles were compared. Cells first give forests of fingerprints of ``WIDE``
    words at ``WIDE_BITS`` or fewer differing bits, so a large group of near copies is joined by few pairs; then
    sets of different groups so found are compared within their cells, but those of sizes too unlike or of more
    than ``FAR_BITS`` differing bits: that alone can lose a link, at 0.8 fewer than 1 pair in 10 million (measured, not proven). A pair that meets in
    several cells is compared in the smallest: rows know the ``FIRSTS`` smallest cells of their text.
    """
    words = [f"f{i}" for i in range(WIDE)]
    longs = ", ".join(f"{w} long" for w in words)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", text_hash(F.col("text")).alias("t"), "text")
    found = rows.select("doc_id", "t", F.col("t").alias("node"))
    texts = rows.groupBy(F.col("t").alias("node")).agg(F.min("doc_id").alias("first"), F.first("text").alias("text"))
    texts = materialize(texts, "distinct-texts")
    common = _common_shingles(texts, shingle)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for at in range(0, len(node), 256):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)[at : at + 256]]
                cells_ = [prefix(x, common) for x in sets]
                times = [len(x) for x in cells_]
                fps = np.stack([wide_fingerprint(x) for x in sets]).view(np.int64)
                columns = [node[at : at + 256], *fps.T, np.array([len(x) for x in sets])]
                arrays = [np.concatenate(cells_).view(np.int64), *[np.repeat(x, times) for x in columns]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["cell", "node", *words, "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ((np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(i)) for i in (2, 3))
            near = pa.array([similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(near)

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, firsts, part in _cells(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column("text")]
            if links := _set_links(sets, rows, firsts):
                yield pa.RecordBatch.from_arrays([pa.array(rows[np.array(x), 1]) for x in zip(*links, strict=True)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        sides = sides.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return sides.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_cell = lambda df: df.repartition("cell").sortWithinPartitions("cell", "node")
    shape = f"cell long, node long, {longs}, n long"
    met = materialize(by_cell(texts.select("node", "text").mapInArrow(spread, shape)).mapInArrow(_met, shape), "shingle-cells")
    met = _bounded(met, "node")
    tried = by_cell(met.select("cell", "node", *words)).mapInArrow(_wide_links, "a long, b long")
    tried = materialize(ordered(tried), "near-pairs")
    labels = materialize(connected_components(verified(tried)), "near-components")
    label = F.coalesce("component", "node").alias("label")
    labelled = materialize(met.join(labels, "node", "left").select("cell", "node", *words, "n", label), "labelled-cells")
    several = labelled.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cell")
    open_ = materialize(labelled.join(materialize(several, "cells-of-several"), "cell"), "open-cells")
    firsts = open_.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("cell")), 1, FIRSTS).alias("firsts"))
    shape += ", label long, firsts array<long>"
    rest = by_cell(open_.join(firsts, "node").select("cell", "node", *words, "n", "label", "firsts"))
    rest = materialize(rest.mapInArrow(_wide_rest, shape), "cells-to-compare")
    rest = rest.join(texts.select("node", "text"), "node").select("cell", "node", *words, "n", "label", "firsts", "text")
    more = by_cell(rest).mapInArrow(in_cells, "a long, b long")
    linked = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    if bits:
        by_bits = near_duplicates(texts.select("node", "text"), "node", "text").where("doc_id <> component_id")
        linked = linked.unionByName(by_bits.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    return _classes(found, texts.select("node", "first"), linked).select("doc_id", "t", "component_id")


def _classes(found: DataFrame, first: DataFrame, met: DataFrame) -> DataFrame:
    """Adds component_id to rows with a ``node``, from the nodes' smallest doc_ids and their links."""
    labels = connected_components(met)
    linked = first.join(labels, "node")
    # a table of its own: the join then has an exchange on both sides, and a large component can be split
    smallest = materialize(linked.groupBy("component").agg(F.min("first").alias("component_id")), "components")
    of_node = linked.join(smallest, "component").select("node", "component_id", F.lit(True).alias("linked"))
    whole = first.join(of_node, "node", "left")
    whole = whole.select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    # likewise: copies share a node, and a large group's rows can be split
    return found.join(materialize(whole, "node-components"), "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those of a component of near-duplicates other than its smallest doc_id's.

    Texts link by their fingerprints, as :func:`near_duplicates` finds them in its grids, and beyond the reach of 64 bits by their sets of shingles.
    Rows without doc_id stay only where nothing linked to them has one. Repeated rows of the one kept stay.
    """
    classes = similar_texts(docs, id_col, text_col, shingle, bits=True)
    gone = classes.where("doc_id <> component_id or doc_id is null and component_id is not null")
    return without(docs, materialize(gone.select("doc_id", "t").distinct(), "near-duplicates"), id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

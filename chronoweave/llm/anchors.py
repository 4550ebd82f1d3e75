"""Finding what repeats in a corpus: windows of fixed length, brought together by content-chosen anchors.

A window is ``width`` consecutive symbols (words or bytes) of a document. Its anchor is the gram of
``gram`` symbols inside it with the smallest hash, the leftmost of equal ones. Equal windows have equal
anchors at equal offsets, so windows need comparing only with windows of the same anchor. Consecutive
windows with one anchor make a segment, and within a segment all windows differ. Hence:

* an anchor that occurs once proves its windows unique; segments are counted by anchor with map-side
  pre-aggregation, and only those of repeating anchors go on;
* equal segments (a 64-bit hash of the content beside the anchor's) are one kind with a multiplicity, so a
  copy costs a row here and nothing in a comparison;
* kinds are cut out of their first texts, gathered by anchor into reference shards of bounded size and
  compared there by the operator's own kernel (suffix automata for words, suffix arrays for bytes), which
  takes multiplicities; its findings go back to every copy of a kind;
* an anchor with more than ``KINDS`` kinds would make a shard too large. All windows of an anchor know the
  same stretch of symbols, and need ``rest`` more, left and right of it. So either half of ``rest`` lies to
  the left, and the stretch grows by these, or the other half lies to the right: each kind splits into two
  parts under longer stretches. That is repeated for the stretches that are still too frequent. A part never
  becomes a row per window unless its window is all known, and after log2(width) rounds all are.

Everything is keyed by hashes and spread by them; the joins back to segments are plain equi-joins that
adaptive execution splits where an anchor is hot.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.rowkeys import REPEATED
from chronoweave.plans.storage import materialize

#: Symbols handled at once, and bits that name a place among them.
PLACE_BITS = 20
BLOCK = 1 << 19
#: Bytes of text gathered before symbols are made.
SLICE = 1 << 19
#: Kinds of one anchor (or longer stretch) that are compared in a shard, at most; shards are of this size and that of their last stretch.
KINDS = 2000

_ODD = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
_BASE = 0x9E3779B97F4A7C15
_POWER: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _POWER or len(_POWER["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWER[name] = np.cumprod(steps)
    return _POWER["up"][:n], _POWER["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _SHIFT)
    x *= _MULTIPLY
    x ^= x >> _SHIFT
    return x


def range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges from the running sum of symbols times powers; equal for equal content anywhere."""
    return mixed((total[end] - total[start]) * powers(len(total))[1][start])


def running(symbols: np.ndarray) -> np.ndarray:
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=total[1:])
    return total


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` symbols from each place (a power of two), by doubling."""
    out, span = symbols, 1
    while span < gram:
        out = mixed(out[:-span] * _ODD + out[span:])
        span *= 2
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def block_segments(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int, contents: bool = True):
    """Segments of the documents that ``bounds`` cuts out of one block: (anchor, content, document, start, windows, anchor's place in it)."""
    n = len(symbols)
    if n < width:
        return None
    grams = gram_hashes(symbols, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    place = (least & mask).astype(np.int64)
    step = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(bounds) >= width)
    step[bounds[long]] += 1
    step[bounds[long + 1] - width + 1] -= 1
    valid = np.cumsum(step[: len(place)]).astype(bool)
    change = np.concatenate(([True], place[1:] != place[:-1]))
    began = np.concatenate(([True], ~valid[:-1]))
    start = np.flatnonzero(valid & (change | began))
    if not len(start):
        return None
    anchor = grams[place[start]]
    if not contents:
        return (anchor,)
    stops = np.flatnonzero(~valid | change)
    stops = np.append(stops, len(place))
    end = stops[np.searchsorted(stops, start, "right")]
    content = range_hash(running(symbols), start, end - 1 + width)
    document = np.searchsorted(bounds, start, "right") - 1
    return anchor, content, document, start - bounds[document], end - start, place[start] - start


class Unit(ABC):
    """What windows are made of, and how kinds of one anchor are compared."""

    width: int
    gram: int
    #: Whether a window's first occurrence is no repeat.
    keep_first: bool
    #: Symbols in a reference shard, about.
    shard: int

    @abstractmethod
    def symbols(self, raw: bytes) -> np.ndarray:
        """Hashes of a text's symbols."""

    @abstractmethod
    def cut(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        """The symbols from and to the places of each span, as bytes."""

    @abstractmethod
    def compare(self, kinds: list[bytes], times: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(kind, first, last + 1, every) of runs of windows that repeat, in the shard or by a kind's ``times``.

        ``order`` ranks the kinds by the place of their first copy. Not ``every``: the first copy's windows
        are the first of the shard, and only the other copies repeat them.
        """

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchor of every segment; rows are (k, t, text)."""
        for symbols, bounds, _, _, _ in self._blocks(batches):
            if found := block_segments(symbols, bounds, self.width, self.gram, False):
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64))], ["h"])

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of whole texts; rows are (k, t, text)."""
        for symbols, bounds, before, k, t in self._blocks(batches):
            found = block_segments(symbols, bounds, self.width, self.gram)
            if found is None:
                continue
            anchor, content, document, start, windows, place = found
            packed = ((start + before[document]) << 32) | (windows << 16) | place
            columns = [anchor.view(np.int64), content.view(np.int64), k[document], t[document], packed]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "g", "k", "t", "p"])

    def _blocks(self, batches: Iterator[pa.RecordBatch]):
        """(symbols, bounds of documents, symbols of each document before this block, k, t) of texts in blocks of bounded size."""
        for batch in batches:
            texts = batch.column(2)
            k, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held: list[np.ndarray] = []
            rows: list[int] = []
            size = 0
            for row in range(batch.num_rows + 1):
                if row < batch.num_rows:
                    text = texts[row].as_py()
                    found = self.symbols((text or "").encode("utf-8", errors="replace"))
                    if len(found) < self.width:
                        continue
                if held and (row == batch.num_rows or size + len(found) > BLOCK):
                    symbols = held[0] if len(held) == 1 else np.concatenate(held)
                    bounds = np.cumsum([0] + [len(x) for x in held])
                    # one text may be longer than a block: blocks overlap by a window less a symbol
                    for at in range(0, len(symbols) - self.width + 1, BLOCK - self.width + 1):
                        part = symbols[at : at + BLOCK]
                        yield part, np.clip(bounds - at, 0, len(part)), np.maximum(0, at - bounds[:-1]), k[rows], t[rows]
                    held, rows, size = [], [], 0
                if row < batch.num_rows:
                    held.append(found)
                    rows.append(row)
                    size += len(found)

    def _cut_out(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contents of kinds; rows are (text, k, t, kinds)."""
        for batch in batches:
            for row in range(batch.num_rows):
                raw = (batch.column(0)[row].as_py() or "").encode("utf-8", errors="replace")
                own = batch.column(3).slice(row, 1).flatten().flatten()  # h, g, p, c
                p = own[2].to_numpy()
                start, windows = p >> 32, (p >> 16) & 0xFFFF
                content = self.cut(raw, list(zip(start.tolist(), (start + windows - 1 + self.width).tolist(), strict=True)))
                k, t = (pa.array(np.full(len(p), batch.column(i)[row].as_py())) for i in (1, 2))
                arrays = [own[0], own[1], k, t, pa.array(p), own[3], pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "g", "k", "t", "p", "c", "content"])

    def _halves(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of kinds under longer stretches; rows are (h, g, known, from, at, c, content, ...), see :func:`_leaves`."""
        for batch in batches:
            out: list[tuple] = []
            keep: list[int] = []
            h, _, known, first, at, c, content = (batch.column(i).to_pylist() for i in range(7))
            for row, raw in enumerate(content):
                symbols = self.symbols(raw)
                total = running(symbols)
                lo, size = at[row], known[row]
                rest = self.width - size
                half = -(-rest // 2)
                last = len(symbols) - self.width  # windows start at 0 to last, each holds the stretch from lo
                sides = []
                if half and lo - half >= 0:
                    sides.append((0, min(last, lo - half), lo - half, lo, size + half, lo - half))
                if rest and lo - half + 1 <= last:
                    start = max(0, lo - half + 1)
                    sides.append((start, last, lo + size, lo + size + rest - half + 1, size + rest - half + 1, lo - start))
                for a, b, new, until, longer, place in sides:
                    key = range_hash(total, np.array([new]), np.array([until]))
                    side = np.uint64(longer if new < lo else longer + self.width)
                    key = mixed(mixed(key + side) ^ np.uint64(h[row] * int(_ODD) & (1 << 64) - 1))
                    whole = range_hash(total, np.array([a]), np.array([b + self.width]))
                    out.append((int(key.view(np.int64)[0]), int(whole.view(np.int64)[0]), longer, first[row] + a, place, c[row], (raw, (a, b + self.width))))
                    keep.append(row)
            if out:
                *numbers, parts = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                columns = [pa.array(x, kind) for x, kind in zip(numbers, kinds, strict=True)]
                columns.append(pa.array([self.cut(raw, [span])[0] for raw, span in parts], pa.binary()))
                rest = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*columns, *rest.columns[7:]], batch.schema.names)

    def _shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares kinds (h, g, k, t, s, c, content) sorted by h, those of one h together, in shards of bounded size."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size >= self.shard and row[0] != held[-1][0]:
                    yield self._compared(held)
                    held, size = [], 0
                held.append(row)
                size += self.length(row[6])
        if held:
            yield self._compared(held)

    @abstractmethod
    def length(self, content: bytes) -> int:
        """Symbols of a content that :meth:`cut` made."""

    def _compared(self, held: list[tuple]) -> pa.RecordBatch:
        rank = sorted(range(len(held)), key=lambda i: held[i][2:5])
        order = np.empty(len(held), np.int64)
        order[rank] = np.arange(len(held))
        found = self.compare([x[6] for x in held], np.array([x[5] for x in held], np.int64), order)
        row, a, b, every = zip(*found, strict=True) if found else ((), (), (), ())
        of = [held[i] for i in row]
        columns = [*(pa.array([x[i] for x in of], pa.int64()) for i in range(4)), pa.array([x[4] for x in of], pa.int32())]
        columns += [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(every, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["h", "g", "k", "t", "s", "a", "b", "every"])

    def _merged(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans (k, t, s, e) sorted by k, t and s, as one row (k, t, spans) a document: pairs of 32-bit places, those that touch made one."""
        key, runs, end = None, [], 0
        for batch in batches:
            made = []
            for k, t, s, e in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, t) != key:
                    if key is not None:
                        made.append((*key, np.array([*runs, end], np.int32).tobytes()))
                    key, runs, end = (k, t), [s], e
                elif s <= end:
                    end = max(end, e)
                else:
                    runs += (end, s)
                    end = e
            yield self._spans(made)
        if key is not None:
            yield self._spans([(*key, np.array([*runs, end], np.int32).tobytes())])

    def _spans(self, made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k", "t", "spans"])


_SPANS = "h long, g long, k long, t long, s int, a int, b int, every boolean"


def _repeats(unit: Unit, kinds: DataFrame) -> DataFrame:
    """``(h, g, k, t, s, a, b, every)``: runs of windows that repeat, of kinds ``(h, g, k, t, s, c, content)`` with few to an h."""
    sorted_ = kinds.select("h", "g", "k", "t", "s", "c", "content").repartition("h").sortWithinPartitions("h", "k", "t", "s")
    return sorted_.mapInArrow(unit._shards, _SPANS)


def _leaves(unit: Unit, kinds: DataFrame) -> DataFrame:
    """As :func:`_repeats`, of all kinds ``(h, g, k, t, p, c, content)``: anchors of many kinds go by longer stretches."""
    place = F.col("p").bitwiseAND(0xFFFF).cast("int")
    start = F.shiftright("p", 32).cast("int")
    frequent = lambda df: df.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > KINDS).select("h")
    hot = materialize(frequent(kinds), "hot-anchors")
    if not hot.limit(1).count():
        return _repeats(unit, kinds.withColumn("s", start))
    out = _repeats(unit, kinds.join(hot, "h", "left_anti").withColumn("s", start))
    # parts: stretch h, content g, symbols known, place of the part in its kind, place of the stretch in the part; of the kind: h, g, k, t, s
    parts = kinds.join(hot, "h", "left_semi").select(
        "h", "g", F.lit(unit.gram).alias("known"), F.lit(0).alias("from"), place.alias("at"), "c", "content",
        F.col("h").alias("kh"), F.col("g").alias("kg"), "k", "t", start.alias("s"),
    )
    shape = "h long, g long, known int, from int, at int, c long, content binary, kh long, kg long, k long, t long, s int"
    while True:
        parts = materialize(parts.mapInArrow(unit._halves, shape), "parts")
        # a stretch that one part of one copy has is done: nothing repeats it
        met = parts.groupBy("h", "g").agg(F.sum("c").alias("c")).groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds"))
        met = materialize(met.where("c > 1").select("h", (F.col("kinds") > KINDS).alias("hot")), "stretches")
        few = parts.join(met.where("not hot").select("h"), "h")
        first = F.min(F.struct("k", "t", (F.col("s") + F.col("from")).alias("s"), "content"))
        alike = few.groupBy("h", "g").agg(F.sum("c").alias("c"), first.alias("f"))
        alike = materialize(alike.select("h", "g", "c", "f.k", "f.t", "f.s", "f.content"), "part-kinds")
        spans = materialize(_repeats(unit, alike).toDF("h", "g", "k1", "t1", "s1", "a", "b", "every"), "part-spans")
        # a part that isn't its kind's first copy at the first place of all repeats it, in every copy
        back = few.select("h", "g", "from", "kh", "kg", "k", "t", "s").join(spans, ["h", "g"])
        same = (F.col("k") == F.col("k1")) & (F.col("t") == F.col("t1")) & (F.col("s") + F.col("from") == F.col("s1"))
        out = out.unionByName(
            back.select(
                F.col("kh").alias("h"), F.col("kg").alias("g"), "k", "t", "s",
                (F.col("a") + F.col("from")).alias("a"), (F.col("b") + F.col("from")).alias("b"), (F.col("every") | ~same).alias("every"),
            )
        )
        hot = met.where("hot").select("h")
        if not hot.limit(1).count():
            return out
        parts = parts.join(hot, "h", "left_semi")


def repeated_spans(rows: DataFrame, unit: Unit) -> DataFrame:
    """``(k, t, spans)``: which symbols are covered by windows that repeat, of keyed rows; :func:`covered` reads spans."""
    plain = rows.select("k", "t", "text")
    seen = plain.mapInArrow(unit.anchors, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    # a table of its own: the join then has an exchange on both sides, and a hot anchor's rows can be split
    seen = materialize(seen, "anchors")
    found = plain.mapInArrow(unit.segments, "h long, g long, k long, t long, p long")
    hits = materialize(found.join(seen, "h"), "segments")
    # copies collapse before they are shuffled
    kinds = hits.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "t", "p")).alias("f"))
    wanted = kinds.groupBy("f.k", "f.t").agg(F.collect_list(F.struct("h", "g", "f.p", "c")).alias("kinds"))
    cut = plain.join(wanted, ["k", "t"]).select("text", "k", "t", "kinds")
    if rows.schema["t"].metadata.get(REPEATED):
        cut = cut.dropDuplicates(["k", "t"])
    cut = materialize(cut.mapInArrow(unit._cut_out, "h long, g long, k long, t long, p long, c long, content binary"), "kinds")
    runs = _leaves(unit, cut).toDF("h", "g", "k0", "t0", "s0", "a", "b", "every")
    copies = hits.join(materialize(runs, "repeats"), ["h", "g"])
    s = F.shiftright("p", 32).cast("int")
    if unit.keep_first:
        copies = copies.where(F.col("every") | (F.col("k") != F.col("k0")) | (F.col("t") != F.col("t0")) | (s != F.col("s0")))
    spans = copies.select("k", "t", (s + F.col("a")).alias("s"), (s + F.col("b") + F.lit(unit.width - 1)).cast("int").alias("e"))
    return spans.repartition("k", "t").sortWithinPartitions("k", "t", "s").mapInArrow(unit._merged, "k long, t long, spans binary")


def covered(spans: bytes | None, size: int) -> np.ndarray:
    """Which of ``size`` symbols the spans cover."""
    step = np.zeros(size + 1, np.int8)
    if spans:
        places = np.frombuffer(spans, np.int32).reshape(-1, 2)
        step[places[:, 0]] += 1
        step[places[:, 1]] -= 1
    return np.cumsum(step[:size], dtype=np.int8).astype(bool)

"""Operator 11: periodic runs of words by Lyndon arrays, in linear time, with comparisons of words only.

A run is a longest stretch of words in which words some period apart are the same. Every run holds a Lyndon
word as long as its period, under one of two opposite orders of the words, that reaches from a word to its
next smaller suffix. :func:`next_smaller` finds these for all words of a stretch in one pass, with the number
of words that match from either end. Matches are reused twice over. On the stack of open suffixes, neighbours'
matches tell most others without a look at a word; and inside the furthest stretch that was matched before,
what its first copy gave holds again, so a comparison starts where that stretch ends. Words are looked at
only where nobody has looked before, so time is linear in any order of words. No suffix tree, suffix array or
hash is made; words become numbers in order of first appearance, which is the order.

Before that, texts are cut at words that no run can hold: a run of exponent e holds each of its words at least
floor(e) times, so words that are rarer between two cuts are cuts themselves. What is left between cuts goes
through the Lyndon arrays.

A map over documents without shuffle; memory is a text's words. Cases: a null or empty text has no words and
no runs; a null doc_id is kept; repeated rows give repeated results; of ties each run counts once, in order of
start and period; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.plans.storage import pick

LEAST = 6
EXPONENT = 4
#: Rounds of cuts at rare words; any number gives the same runs.
CUTS = 6
#: Bytes of text worked on at once, unless one text is longer.
SLICE = 4 << 20
WORD = "[^\\x20\\x09-\\x0D]+"


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """(next, match): of each suffix the start of the next smaller one, and how many words the two share from their starts.

    ``s`` ends with a number smaller than all others, which has no entry.
    """
    n = len(s) - 1
    nxt, match = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, likewise
    same = [0] * (n + 1)
    for j in range(n - 1, 0, -1):
        if s[j - 1] == s[j]:
            same[j] = same[j + 1] + 1
    lo = hi = end = 0  # the words from hi to end are those from lo
    for j in range(1, n):
        i, m = j - 1, same[j]
        while True:
            if j + m > end or (j + m == end and j > hi):
                lo, hi, end = i, j, j + m
            if s[i + m] < s[j + m]:
                before[j], shared[j] = i, m
                break
            nxt[i], match[i] = j, m
            known, i = shared[i], before[i]
            if i < 0:
                break
            if known < m:
                before[j], shared[j] = i, known
                break
            if known == m:
                if j + m < end and i >= hi:
                    a, b = i - (hi - lo), j - (hi - lo)
                    got = match[a] if nxt[a] == b else shared[b] if before[b] == a else None
                    if got is not None and got < end - j:
                        m = got
                        continue
                    if got is not None:
                        m = end - j
                while s[i + m] == s[j + m]:
                    m += 1
    return nxt, match


def runs_of(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``exponent`` (2 or more) periods, in order."""
    n, found = len(codes), set()
    for s in (codes, codes.max() - codes) if n else ():
        s = s.tolist()
        s.append(-1)
        nxt, match = next_smaller(s)
        after, m = np.array(nxt), np.array(match)
        period = after - np.arange(n)
        # a run's first Lyndon word starts less than a period after the run
        for i in np.flatnonzero(m + 2 * period - 1 >= np.maximum(least, exponent * period)).tolist():
            p = nxt[i] - i
            if i >= p and nxt[i - p] == i and match[i - p] >= p:
                continue
            start = i
            while start and s[start - 1] == s[start + p - 1]:
                start -= 1
            length = i - start + p + match[i]
            if length >= max(least, exponent * p):
                found.add((start, length, p))
    return sorted(found)


def _stretches(codes: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches that hold each of their words at least ``times`` times, of ``least`` words or more (after ``CUTS`` rounds at most)."""
    if len(codes) < least:
        return []
    kept = np.bincount(codes)[codes] >= times
    for left in range(CUTS, -1, -1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= least
        starts, stops = starts[long], stops[long]
        if not left or not len(starts):
            break
        sizes = stops - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, which, n = np.unique(owner * (codes.max() + 1) + codes[places], return_inverse=True, return_counts=True)
        rare = n[which] < times
        if not rare.any():
            break
        kept = np.zeros(len(codes), bool)
        kept[places[~rare]] = True
    return list(zip(starts.tolist(), stops.tolist(), strict=True))


def word_runs(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """As :func:`runs_of`, of a whole text: the runs of each stretch between cuts."""
    out = []
    for first, last in _stretches(codes, exponent, least):
        part = np.unique(codes[first:last], return_inverse=True)[1]
        out += [(first + start, length, period) for start, length, period in runs_of(part, least, exponent)]
    return out


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of a text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``(doc_id, runs array<struct<start, length, period>>, collapsed)`` of every whole text, in words.

    ``collapsed`` is the text with what each run repeats left out, words joined by one space.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = pc.fill_null(part.column(1), "").cast(pa.large_string())
                pieces = pc.ascii_split_whitespace(texts)
                ends, words = pieces.offsets.to_numpy(), pieces.values
                real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
                seen = np.concatenate(([0], np.cumsum(real)))
                ends, words = seen[ends], words.filter(pa.array(real))
                kept, found = np.ones(len(words), bool), []
                for first, last in zip(ends[:-1], ends[1:], strict=True):
                    codes = words.slice(first, last - first).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    runs = word_runs(codes, least, exponent)
                    for start, length, period in runs:
                        kept[first + start + period : first + start + length] = False
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left = np.concatenate(([0], np.cumsum(kept)))[ends]
                joined = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(kept)))
                collapsed = pc.binary_join(joined, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, run_type), collapsed], ["doc_id", "runs", "collapsed"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _with_period(text: Column, doc_id: Column) -> Column:
    """The text of the query's contract: in one document of ten, what follows some word repeats with some period."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n, h = F.size(words), F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    times = F.ceil(rest / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when(h % 10 == 0, F.when(n > 0, planted).otherwise(text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = periodic_runs(docs.select("doc_id", _with_period(F.col("text"), F.col("doc_id")).alias("text")))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.withColumns({"best": F.array_max(order), "listed": text})
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

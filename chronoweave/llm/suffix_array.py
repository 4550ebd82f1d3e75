"""Operator 7: suffix-array dedup by bucket-pointer refinement.

Every byte covered by a 100-byte string that also starts earlier (smaller doc_id, or earlier in the same
document) goes. :mod:`anchors` gathers segments of strings that could be equal into reference shards, each
different segment once with its number of copies; a shard's suffix array starts from buckets of 8-grams, and each pass sorts the suffixes within a bucket by the
bucket pointers at a later offset. Pointers are updated as buckets split, so each pass doubles the depth
that the next one reuses; only buckets of several suffixes are sorted again, and refinement stops at depth
100, where suffixes share a bucket exactly if their 100 bytes are equal.

Cases: null and empty texts have no bytes; null doc_ids count as one document that sorts last; rows alike in
doc_id and text are one document, so neither removes bytes of the other; rows that share a doc_id but not
the text follow each other in the order of their text's hash; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.anchors import Unit, covered, repeated_spans
from chronoweave.llm.rowkeys import keyed

LENGTH = 100
GRAM = 8
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, bucket pointer of each suffix) of bytes, told apart by their first ``depth`` bytes.

    A bucket's pointer is the place of its first suffix; suffixes beyond the end count as smaller than any.
    """
    n = len(data)
    known = min(GRAM, depth)
    padded = np.zeros(n + known, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for i in range(known):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    pointer = np.full(n + depth + 1, -1, np.int64)
    key = key[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begins, n))
    pointer[order] = np.repeat(begins, size)
    place = np.flatnonzero(np.repeat(size > 1, size))  # places in the array whose bucket can still split
    while known < depth and len(place):
        step = min(known, depth - known)
        own = order[place]
        key = (pointer[own] << 32) | (pointer[own + step] + 1)
        sort = np.argsort(key)
        own, key = own[sort], key[sort]
        order[place] = own
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(own)))
        pointer[own] = np.repeat(place[first], size)
        place = place[np.repeat(size > 1, size)]
        known += step
    return order, pointer[:n]


class Bytes(Unit):
    def __init__(self, width: int = LENGTH, gram: int = 32, shard: int = 1 << 20):
        self.width, self.gram, self.shard, self.keep_first = width, gram, shard, True

    def symbols(self, raw: bytes) -> np.ndarray:
        return _SYMBOL[np.frombuffer(raw, np.uint8)]

    def cut(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        return [raw[a:b] for a, b in spans]

    def length(self, content: bytes) -> int:
        return len(content)

    def compare(self, kinds: list[bytes], times: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int, bool]]:
        # a kind of several copies repeats itself: all but its first copy go
        out = [(int(i), 0, len(kinds[i]) - self.width + 1, False) for i in np.flatnonzero(times > 1)]
        data = np.frombuffer(b"".join(kinds), np.uint8)
        start = np.cumsum([0] + [len(x) for x in kinds])
        array, pointer = buckets(data, self.width)
        bucket = pointer[array]
        # only suffixes that share their bucket, and whose bytes all belong to their kind
        alike = np.concatenate(([False], bucket[1:] == bucket[:-1]))
        alike[:-1] |= alike[1:]
        place, bucket = array[alike], bucket[alike]
        kind = np.searchsorted(start, place, "right") - 1
        whole = place + self.width <= start[kind + 1]
        place, bucket, kind = place[whole], bucket[whole], kind[whole]
        if not len(place):
            return out
        when = order[kind] * (1 << 32) + (place - start[kind])
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        late = when > np.repeat(np.minimum.reduceat(when, first), np.diff(np.append(first, len(when))))
        place = np.sort(place[late])
        kind = np.searchsorted(start, place, "right") - 1
        if not len(place):
            return out
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(kind) != 0)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
        ends = zip(kind[first].tolist(), (place[first] - start[kind[first]]).tolist(), (place[last] - start[kind[last]] + 1).tolist(), strict=True)
        return out + [(*x, True) for x in ends]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bytes_left: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row; with ``bytes_left`` also ``kept`` (binary)."""
    rows = keyed(docs, id_col, text_col)
    gone = repeated_spans(rows, Bytes(length))
    joined = rows.join(gone, ["k", "t"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * bytes_left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", errors="replace")
                left, holes = raw, 0
                if spans.is_valid:
                    hidden = covered(spans.as_py(), len(raw))
                    left = np.frombuffer(raw, np.uint8)[~hidden].tobytes()
                    holes = int(np.count_nonzero(np.diff(np.concatenate(([False], hidden)).astype(np.int8)) == 1))
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(holes)
                kept.append(left)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                *[pa.array(kept, pa.binary())] * bytes_left,
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    shown = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, shown + ", kept binary" * bytes_left)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Texts are cut into overlapping pieces of 500 strings each, all of them, as slices of long texts are slow.
OP7_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0), 500)) AS base FROM h
), c AS (SELECT doc_id, base, x[2 * base + 1:2 * base + 1198] AS y FROM b
), p AS (SELECT doc_id, base, y, unnest(range(0, len(y) // 2 - 99)) AS j FROM c
), w AS (SELECT doc_id, base + j AS i, row_number() OVER (PARTITION BY y[2 * j + 1:2 * j + 200] ORDER BY doc_id, base + j) AS rn FROM p
), l AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w WHERE rn > 1
), r AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l
), s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY 1, 2
), k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), o AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(x[2 * before + 1:2 * a], '' ORDER BY a) AS kept FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY 1)
SELECT h.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM h LEFT JOIN o ON o.doc_id = h.doc_id
"""

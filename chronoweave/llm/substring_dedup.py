"""Operator 6: substring dedup by suffix automata of reference shards.

A window is 35 consecutive words; every word covered by a window whose words also start anywhere else goes,
in all places. :mod:`anchors` routes segments of windows that could be equal to the same reference shard, each
different segment once with its number of copies; a shard's suffix automaton (over words) counts the
occurrences of everything in it, the segments are streamed through it for matching statistics, and runs of windows at or above the length threshold that occur twice
become spans. The automata are built where their shard's segments are gathered instead of being broadcast:
broadcasting every shard to every document would cost shards x corpus, and shards grow with the corpus.

Cases: null and empty texts have no words; null doc_ids count as one document that sorts last; repeated
rows repeat each other's windows and so lose them; words are cut at ASCII white space and compared as they
are; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.anchors import SLICE, Unit, covered, mixed, powers, range_hash, repeated_spans
from chronoweave.llm.rowkeys import keyed

WINDOW = 35
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word; long texts are taken in slices that end at white space."""
    if len(raw) > 2 * SLICE:
        parts, at = [], 0
        while at < len(raw):
            end = at + SLICE
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
            parts.append(word_hashes(raw[at:end]) if end - at <= 2 * SLICE else _one_slice(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return _one_slice(raw)


def _one_slice(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = ~_BLANK[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=total[1:])
    return mixed(range_hash(total, start, end) + (end - start).astype(np.uint64))


class Automaton:
    """The suffix automaton of several sequences, with occurrence counts; each sequence counts ``times``."""

    def __init__(self, sequences: list[list[int]], times: list[int] | None = None):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for sequence, often in zip(sequences, times or [1] * len(sequences), strict=True):
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                ends.append((last, often))
        self.count = [0] * len(self.link)
        for state, often in ends:
            self.count[state] += often
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _extend(self, last: int, symbol: int) -> int:
        next_, link, length = self.next, self.link, self.length
        known = next_[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        new = len(link)
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state != -1 and symbol not in next_[state]:
            next_[state][symbol] = new
            state = link[state]
        if state != -1:
            known = next_[state][symbol]
            link[new] = known if length[known] == length[state] + 1 else self._split(state, symbol, known)
        return new

    def _split(self, state: int, symbol: int, known: int) -> int:
        """A state for the strings of ``known`` that are no longer than those of ``state`` and the symbol."""
        copy = len(self.link)
        self.next.append(dict(self.next[known]))
        self.link.append(self.link[known])
        self.length.append(self.length[state] + 1)
        self.link[known] = copy
        while state != -1 and self.next[state].get(symbol) == known:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def repeats(self, sequence: list[int], width: int) -> list[bool]:
        """For each window of the streamed sequence whether it occurs at least twice in the automaton's."""
        next_, link, length, count = self.next, self.link, self.length, self.count
        out = []
        state = matched = 0
        for place, symbol in enumerate(sequence, 1):
            while state and symbol not in next_[state]:
                state = link[state]
                matched = length[state]
            if symbol in next_[state]:
                state = next_[state][symbol]
                matched += 1
            if matched >= width:
                while length[link[state]] >= width:
                    state = link[state]
                matched = min(matched, length[state])
            if place >= width:
                out.append(matched >= width and count[state] >= 2)
        return out


class Words(Unit):
    def __init__(self, width: int = WINDOW, gram: int = 8, shard: int = 60_000):
        self.width, self.gram, self.shard, self.keep_first = width, gram, shard, False

    def symbols(self, raw: bytes) -> np.ndarray:
        return word_hashes(raw)

    def cut(self, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        words = raw.split()
        return [b" ".join(words[a:b]) for a, b in spans]

    def length(self, content: bytes) -> int:
        return content.count(b" ") + 1

    def compare(self, kinds: list[bytes], times: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int, bool]]:
        names: dict[bytes, int] = {}
        sequences = [[names.setdefault(w, len(names)) for w in x.split(b" ")] for x in kinds]
        automaton = Automaton(sequences, times.tolist())
        out = []
        for number, sequence in enumerate(sequences):
            flags = np.array([False, *automaton.repeats(sequence, self.width), False])
            edge = np.flatnonzero(np.diff(flags))
            out += [(number, int(a), int(b), True) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, texts: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row; with ``texts`` also ``kept``, the words left."""
    rows = keyed(docs, id_col, text_col)
    gone = repeated_spans(rows, Words(width))
    joined = rows.join(gone, ["k", "t"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", errors="replace").split()
                hidden = covered(spans.as_py(), len(words)) if spans.is_valid else np.zeros(len(words), bool)
                left = [w for w, x in zip(words, hidden.tolist(), strict=True) if not x] if spans.is_valid else words
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                *[pa.array([x.decode() for x in kept], pa.string())] * texts,
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w
), c AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS n FROM p
), x AS (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), y AS (
    SELECT x.doc_id, x.pos, x.word, max(CASE WHEN c.n > 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.pos
)
SELECT w.doc_id, count(y.pos) AS n_words, coalesce(sum(y.gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(y.word, ' ' ORDER BY y.pos) FILTER (WHERE y.gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN y ON y.doc_id = w.doc_id
GROUP BY w.doc_id
"""

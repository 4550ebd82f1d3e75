"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a linear model over hashed words and stems;
the document's is their noisy-or, 1 - prod(1 - p). The model is trained from document labels through the
noisy-or, so that labels of whole documents teach which sentences offend; those are then located.

Only rows whose crc32(doc_id as text) mod 3 is not 1 teach. Training takes at most ``SAMPLE`` labelled rows
of either class, those with the smallest hash of doc_id. Executors count which features part the classes
(2^BITS exist) and reduce each text to its chosen features; the driver trains on those. Scoring is a map over whole texts, without shuffle.

Cases: a null or empty text has one empty sentence and so the score of the bias; labels that are null or of
documents not at hand teach nothing; with no label of one class every score is 0.5; null doc_ids are kept
and count as held out = false; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.plans.storage import materialize, pick

#: Labelled rows of either class that teach, at most.
SAMPLE = 4000
BITS = 18
#: Words also count by their first bytes, so that inflected forms teach together.
STEMS = (4, 6)
THRESHOLD = 0.7
EPOCHS = 900
RATE = 0.5
#: Weight of the squared word weights in the loss.
DECAY = 1e-6
#: A feature teaches if its shares of both classes' documents differ by this many standard errors.
LEAST_Z = 5.0
#: Bytes of text, and rows of a batch, handled at once.
SLICE = 1 << 19
ROWS = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Characters that belong to words: letters and digits of ASCII, and every byte beyond.
_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE | np.uint64(1), np.uint64))))
    return _POWERS[:n]


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, position) of every word of lower-cased bytes and of its stems, features in ``BITS`` bits."""
    inside = _WORD[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int32), starts
    power = _powers(len(data) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    # a word's hash is brought to one common power, so that its place does not matter
    place = power[len(data) - starts] * _inverse(len(data))
    features, owners = [], []
    for kind, stem in enumerate((0, *STEMS)):
        chosen = np.flatnonzero(ends - starts > stem) if stem else slice(None)
        first = starts[chosen]
        last = first + stem if stem else ends
        mixed = (total[last] - total[first]) * place[chosen] + np.uint64(kind)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        features.append((mixed & np.uint64((1 << BITS) - 1)).astype(np.int32))
        owners.append(first)
    return np.concatenate(features), np.concatenate(owners)


def _inverse(n: int) -> np.uint64:
    """The inverse of the base's n-th power modulo 2^64."""
    base = int(_BASE | np.uint64(1))
    return np.uint64(pow(pow(base, -1, 1 << 64), n, 1 << 64))


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, as (feature, sentence), and the document of each sentence."""
    data = _FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
    features, starts = hashed_words(data)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    cuts = np.union1d(np.flatnonzero(_STOP[data]) + 1, first)
    sentence = np.searchsorted(cuts, starts, "right") - 1
    used, sentence = np.unique(sentence, return_inverse=True)
    owner = np.searchsorted(first, cuts[used], "right") - 1
    return features, sentence, owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def screened(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features that part the classes by more than chance, from their document counts in both."""
    n1, n0 = max(1, n_toxic), max(1, n_clean)
    q = (toxic + clean + 0.5) / (n1 + n0 + 1)
    return np.flatnonzero(np.abs(toxic / n1 - clean / n0) >= LEAST_Z * np.sqrt(q * (1 - q) * (1 / n1 + 1 / n0)))


def train(features: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Word weights and bias that fit the documents' labels through the noisy-or (Adagrad, whole batch)."""
    sentences, documents = len(owner), len(label)
    used, column = np.unique(features, return_inverse=True)
    weight, bias = np.zeros(len(used)), -4.0
    seen, seen_bias = np.full(len(used), 1e-8), 1e-8
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    for _ in range(EPOCHS):
        p = _sigmoid(np.bincount(sentence, weight[column], sentences) + bias)
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), documents)
        whole = np.maximum(-np.expm1(clean), 1e-9)
        pull = p * (1 - (label / whole)[owner]) * share[owner]
        slope = np.bincount(column, pull[sentence], len(used)) + DECAY * weight
        slope_bias = pull.sum()
        seen += slope**2
        seen_bias += slope_bias**2
        weight -= RATE * slope / np.sqrt(seen)
        bias -= RATE * slope_bias / np.sqrt(seen_bias)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = weight
    return out, float(bias)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", errors="replace")


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``SLICE`` bytes, with the place of the first."""
    held, size, first = [], 0, 0
    for place, text in enumerate(texts):
        raw = _raw(text)
        if held and size + len(raw) > SLICE:
            yield first, held
            held, size, first = [], 0, place
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def sentence_scores(texts: list[bytes], weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability, document) of every sentence that has words."""
    features, sentence, owner = bags(texts)
    return _sigmoid(np.bincount(sentence, weight[features], len(owner)) + bias), owner


def scores(texts: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Noisy-or of each text's sentences; a text without words scores as one empty sentence."""
    p, owner = sentence_scores(texts, weight, bias)
    clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)).astype(float)  # of nothing it counts in integers
    empty = np.bincount(owner, minlength=len(texts)) == 0
    clean[empty] = np.log1p(-_sigmoid(np.float64(bias)))
    return -np.expm1(clean)


def _batch_scores(column: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(column))
    for at in range(0, len(column), ROWS):
        for first, texts in _slices(column.slice(at, ROWS).to_pylist()):
            out[at + first : at + first + len(texts)] = scores(texts, weight, bias)
    return out


def _below(batch: pa.RecordBatch, place: int, weight: np.ndarray, bias: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text scores below the threshold, some at a time, so that texts of a batch aren't held twice."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part.filter(pa.array(_batch_scores(part.column(place), weight, bias) < threshold))


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows that aren't held out, ``SAMPLE`` of either class at most."""
    marks = pick(labels, id_col, label_col).toDF("doc_id", "label").where("label in (0, 1) and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).where(~is_held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = marks.where("label = 1").orderBy(*order).limit(SAMPLE).unionByName(marks.where("label = 0").orderBy(*order).limit(SAMPLE))
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "text", "label")

    rows = materialize(rows, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
            for label, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(bags([_raw(text)])[0])
                (toxic if label else clean)[own] += 1
            seen = np.flatnonzero(toxic + clean)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(toxic[seen]), pa.array(clean[seen])], ["feature", "toxic", "clean"])

    # at most 2^BITS rows
    counts = rows.mapInArrow(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic"), F.sum("clean")).toPandas()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    by_class = np.zeros((2, 1 << BITS))
    by_class[0, counts["feature"]], by_class[1, counts["feature"]] = counts["sum(toxic)"], counts["sum(clean)"]
    chosen = screened(by_class[0], by_class[1], sizes[1], sizes[0]).astype(np.int32)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sentences, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                features, sentence, owner = bags([_raw(text)])
                used = np.isin(features, chosen)
                words.append(features[used].astype(np.int32).tobytes())
                sentences.append(sentence[used].astype(np.int32).tobytes())
                sizes.append(len(owner))
            columns = [batch.column(0), batch.column(2), pa.array(words, pa.binary()), pa.array(sentences, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "words", "sentences", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(reduce, f"doc_id {kind}, label int, words binary, sentences binary, n int").collect()
    found.sort(key=lambda r: (r.doc_id, r.n, r.words))
    base = np.concatenate(([0], np.cumsum([r.n for r in found])[:-1]))
    sentence = np.concatenate([np.frombuffer(r.sentences, np.int32) + b for r, b in zip(found, base, strict=True)])
    features = np.concatenate([np.frombuffer(r.words, np.int32) for r in found])
    label = np.array([r.label for r in found], dtype=np.int64)
    return train(features, sentence, np.repeat(np.arange(len(label)), [r.n for r in found]), label)


def located(text: str | None, weight: np.ndarray, bias: float, threshold: float) -> list[tuple[str, float]]:
    """(sentence, probability) of the sentences of a text whose own probability reaches the threshold."""
    raw = _raw(text)
    cuts = np.concatenate(([0], np.flatnonzero(_STOP[np.frombuffer(raw, np.uint8)]) + 1, [len(raw)]))
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if raw[a:b].strip()]
    p = scores(parts, weight, bias) if parts else []
    return [(s.decode(errors="replace").strip(), float(x)) for s, x in zip(parts, p, strict=True) if x >= threshold]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", worst: bool = False) -> DataFrame:
    """``(doc_id, score)`` of every whole text; with ``worst`` also the sentence that offends most where score is ``THRESHOLD`` or more.

    ``worst_sentence`` and ``worst_p`` are null below; the first of equal sentences counts.
    """
    weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _batch_scores(batch.column(1), weight, bias)
            columns = [batch.column(0), pa.array(out)]
            if worst:
                top: list[tuple] = [(None, None)] * len(out)
                for row in np.flatnonzero(out >= THRESHOLD):
                    found = located(batch.column(1)[row].as_py(), weight, bias, 0.0)
                    top[row] = max(found, key=lambda x: x[1]) if found else (None, None)
                columns += [pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", *["worst_sentence", "worst_p"] * worst])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double" + ", worst_sentence string, worst_p double" * worst)


def offending_sentences(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``(doc_id, sentence, p)`` of every sentence whose own probability reaches the threshold."""
    weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(doc_id, *x) for x in located(text, weight, bias, threshold)]
            ids, sentence, p = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(sentence, pa.string()), pa.array(p, pa.float64())],
                ["doc_id", "sentence", "p"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sentence string, p double")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns kept."""
    weight, bias = fit(docs, labels, id_col, text_col)
    names = docs.columns
    place = names.index(text_col)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _below(batch, place, weight, bias, threshold)

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return score(docs, model, worst=True).select("doc_id", is_held_out().alias("held_out"), "score", predicted, "worst_sentence", "worst_p")

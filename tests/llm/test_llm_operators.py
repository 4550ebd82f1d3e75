"""Each operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from chronoweave.llm import ann, anchors, decontaminate, line_dedup, sentencepiece_codec, sharding, simhash, substring_dedup, suffix_array, token_counts, toxicity
from chronoweave.llm.pieces import BYTE, CONTROL, NORMAL, UNKNOWN, PieceModel, loaded

SHAPE = "doc_id long, text string"


def corpus(seed=0, n=60, words=30):
    """Texts with copies, shared passages, repeated lines, nulls, an empty text and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = line(60)
    shared = [line(6) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        if i % 4 == 0:
            parts[1:1] = shared
        if i % 7 == 0 and out:
            out.append((i, rng.choice(out)[1]))
            continue
        out.append((i, "\n".join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, passage), (None, None), (n + 3, "x " * 400), (n + 4, line(2000)), out[3], out[3], (out[5][0], line(50))]
    return out


def frame(spark, rows, parts=3):
    extra = [(d, t, 1, "q", d) for d, t in rows]
    return spark.createDataFrame(extra, SHAPE + ", h int, Text2 string, shard long").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SHAPE)


def words_of(t):
    return (t or "").encode().split()


# pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def odd_texts(n=400):
    rng = random.Random(1)
    bits = ["a", "b", "the", "  ", " ", "\n", "é", "ü", "1", "23", "<s>", "</s>", "<unk>", "▁", "日本", "😀", "\t", "ing", "tion", ".", "--", "((", "\x00", "aaaa", "    "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "  a  ", "x" * 5000, "ab " * 3000]


def test_pieces_equal_the_library(library):
    model = loaded(sentencepiece_codec.model_bytes())
    for text in odd_texts():
        want = library.encode(text)
        assert model.encode(text) == want
        assert model.count(text) == len(want)
        assert model.decode(want) == text.replace("▁", " ")


def test_prefix_counts_and_budgets_equal_the_library(library):
    model = loaded(sentencepiece_codec.model_bytes())
    for text in odd_texts(40)[:40]:
        counts = list(model.prefix_counts(text))
        assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        for budget in (0, 1, 3, 10, 1000):
            assert model.fit(text, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_unigram_viterbi_equals_brute_force():
    rng = random.Random(2)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(12)} | {"▁", "▁a"}
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)] + [(t, -rng.random() * 5 - 0.5, NORMAL) for t in sorted(texts)]
    model = PieceModel(pieces, bpe=False)
    score = {p: s for p, s, k in pieces if k == NORMAL}
    floor = min(score.values()) - 10

    def best(s):
        top = [0.0] + [None] * len(s)
        for end in range(1, len(s) + 1):
            ways = [top[end - k] + score[s[end - k : end]] for k in range(1, end + 1) if s[end - k : end] in score]
            top[end] = max(ways + ([top[end - 1] + floor] if s[end - 1] not in score else []))
        return top[-1]

    for _ in range(200):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))
        marked = "▁" + text.replace(" ", "▁")
        got = sum(pieces[i][1] if pieces[i][2] == NORMAL else floor for i in model.encode(text))
        assert got == pytest.approx(best(marked))


def test_unknown_characters_fall_back_to_bytes():
    pieces = [("<unk>", 0.0, UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)] + [("▁", -1.0, NORMAL), ("a", -2.0, NORMAL)]
    model = PieceModel(pieces, bpe=True)
    assert model.decode(model.encode("aé a")) == "aé a" and model.count("é") == 3


def test_codec_tables(spark, docs, rows, nothing, library):
    out = sentencepiece_codec.round_trip(docs).collect()
    assert len(out) == len(rows) and all(r.exact for r in out)
    want = collections.Counter((d, tuple(library.encode(t or ""))) for d, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out) == want
    coded = sentencepiece_codec.encode(docs)
    assert collections.Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(coded).collect()) == collections.Counter((d, t or "") for d, t in rows)
    assert sentencepiece_codec.round_trip(nothing).count() == 0


def test_token_counts_table(docs, rows, nothing, library):
    got = collections.Counter(tuple(r)[:4] for r in token_counts.token_counts(docs, limit=50).collect())
    want = collections.Counter((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for d, t in rows)
    assert got == want and token_counts.token_counts(nothing).count() == 0
    assert {r.doc_id: r.counts for r in token_counts.prefix_counts(docs).where("doc_id = 61").collect()} == {61: [0]}


# lines


def test_line_dedup(docs, rows, nothing):
    last = 1 << 63
    seen = {}
    for d, t in rows:
        lines = (t or "").split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            seen[key] = min(seen.get(key, (last + 1, 0)), (last if d is None else d, i))
    want = collections.Counter()
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = {i + j for i in range(len(lines) - 2) if (last if d is None else d, i) > seen[tuple(lines[i : i + 3])] for j in range(3)}
        want[d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None] += 1
    assert collections.Counter(tuple(r) for r in line_dedup.line_findings(docs).collect()) == want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter({(k[0], k[3]): 0 for k in want}) + collections.Counter([(k[0], k[3]) for k in want.elements()])
    assert line_dedup.line_findings(nothing).count() == 0


# near-duplicates


def plain_fingerprint(text, k=4):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, docs, rows, nothing):
    rng = random.Random(4)
    base = " ".join(str(rng.random()) for _ in range(300)).split()
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = str(rng.random())
        near.append((1000 + i, " ".join(w)))
    both = rows + near
    fps = [plain_fingerprint(t) for _, t in both]
    group = list(range(len(both)))
    for i in range(len(both)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    smallest = {}
    for g, (d, _) in zip(group, both, strict=True):
        if d is not None:
            smallest[g] = min(smallest.get(g, d), d)
    want = collections.Counter((d, f, smallest.get(g)) for (d, _), f, g in zip(both, fps, group, strict=True))
    got = simhash.near_duplicates(frame(spark, both))
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == want
    assert len({g for g in group[-40:]}) < 40
    assert simhash.near_duplicates(nothing).count() == 0


def test_manhattan_distance_bounds_hamming_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    lower = np.abs(simhash.segment_counts(a).astype(int) - simhash.segment_counts(b).astype(int)).sum(axis=1)
    assert (lower <= np.bitwise_count(a ^ b)).all()


def test_grids_miss_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    cells_a, cells_b = (simhash.cells(x)[0].reshape(35, 300) for x in (a, b))
    assert (cells_a == cells_b).any(axis=0).all()


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[i % 3] ^ (np.uint64(1) << rng.integers(0, 64, 1).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1).astype(np.uint64)) for i in range(200)]))
    links = simhash.forest(fps)
    assert len(links) == len(fps) - 3
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 4 for a, b in links)


def test_similar_texts_keep_one(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(30)]
    rows = list(enumerate(texts))
    for i in range(10):
        w = texts[i].split()
        for j in range(4):
            w[37 * j + i] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, None), (201, ""), (None, texts[0]), (None, "lonely words"), (5, texts[5])]
    left = simhash.keep_one(frame(spark, rows))
    kept = sorted((-1 if r.doc_id is None else r.doc_id) for r in left.collect())
    assert kept == sorted([*range(30), 5, 200, -1])
    assert left.columns == ["doc_id", "text", "h", "Text2", "shard"]


def test_keep_one_links_by_fingerprints_too(spark):
    rng = random.Random(9)
    while True:
        base = [str(rng.randrange(10**6)) for _ in range(120)]
        other = list(base)
        for i in range(2, 120, 25):
            other[i] = "changed"
        x, y = " ".join(base), " ".join(other)
        if (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() <= simhash.MAX_BITS:
            break
    sets = [np.unique(simhash.shingle_hashes(t, simhash.WIDE_SHINGLE)) for t in (x, y)]
    assert not simhash.similar(*sets)
    far = " ".join(str(rng.randrange(10**6)) for _ in range(120))
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, [(1, x), (2, y), (3, far)])).collect()) == [1, 3]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 40])
def test_wide_links_of_one_cell(n):
    import pyarrow as pa

    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, simhash.WIDE)
    rows = [(7, i, *(base ^ (i & 1))) for i in range(n)]
    columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    names = ["cell", "node", *[f"f{i}" for i in range(simhash.WIDE)]]
    batch = pa.RecordBatch.from_arrays(columns, names)
    for batches in ([batch], [batch.slice(0, n // 2), batch.slice(n // 2)]):
        group = list(range(n))
        for out in simhash._wide_links(iter(batches)):
            for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                group = [group[b] if g == group[a] else g for g in group]
        assert len(set(group)) == 1


def at_similarity(rng, shared, own):
    """Two texts of one-word lines whose five-word shingles share ``shared`` and have ``own`` of their own each."""
    word = lambda: str(rng.randrange(10**9))
    head = [word() for _ in range(shared + 4)]
    return [" ".join(head + [word() for _ in range(own)]) for _ in range(2)]


@pytest.mark.parametrize("common", [False, True])
def test_similar_texts_are_exact_near_the_threshold(spark, monkeypatch, common):
    if common:
        monkeypatch.setattr(simhash, "SAMPLED", 1)
    rng = random.Random(11)
    shapes = [(4, 0), (8, 1), (80, 10), (81, 10), (82, 9), (240, 30), (255, 24), (79, 10), (70, 15), (75, 13), (239, 30)]
    rows, alike = [], {}
    passage = " ".join(str(rng.randrange(10**9)) for _ in range(8))
    for shape, (shared, own) in enumerate(shapes):
        for _ in range(12):
            a, b = at_similarity(rng, shared, own)
            if own > 9 and common:
                a, b = a.split(), b.split()
                a[50:58] = b[50:58] = passage.split()  # shared by many pairs, changes no similarity
                a, b = " ".join(a), " ".join(b)
            alike[len(rows)] = 5 * shared >= 4 * (shared + 2 * own)
            rows += [(len(rows), a), (len(rows) + 1, b)]
    # repeated words: the set of shingles counts, not how often
    rows += [(len(rows), "a b c d e f g h i j k l"), (len(rows) + 1, "a b c d e f g h i j k l " * 1 + "a b c d e f g h i j k l")]
    group = {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, rows)).collect()}
    recall = [group[i + 1] == i for i, near in alike.items() if near]
    wrong = [group[i + 1] == i for i, near in alike.items() if not near]
    assert all(recall) and not any(wrong) and len(recall) == 7 * 12 and len(wrong) == 4 * 12


def test_similar_texts_of_a_group_are_exact(spark):
    rng = random.Random(12)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for place in rng.sample(range(200), rng.randint(1, 6)):
            w[place] = str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(frame(spark, rows)).collect()} == dict(enumerate(group))


def test_dense_cells_are_dealt_to_blocks(spark, monkeypatch):
    rng = random.Random(21)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for place in rng.sample(range(60), rng.randint(0, 3)):
            w[place] = str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    d = frame(spark, rows)
    groups = lambda: {r.doc_id: r.component_id for r in simhash.similar_texts(d).collect()}
    prints = lambda: {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    want = groups(), prints()
    monkeypatch.setattr(simhash, "CELL", 7)
    assert (groups(), prints()) == want and len(set(want[0].values())) < 80
    # the smallest cells that a text knows spare comparisons and decide none
    monkeypatch.setattr(simhash, "FIRSTS", 1)
    assert groups() == want[0]


# sharding


def test_shards(docs, rows, nothing):
    out = sharding.assign(docs, 4).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    load = collections.Counter()
    for r in out:
        load[r.shard] += r.size
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    assert sharding.assign(nothing).count() == 0


def test_bytes_are_balanced_with_a_hot_group(spark):
    rng = random.Random(0)
    rows = [(i, "hot text " * 20) for i in range(400)] + [(1000 + i, "w" * rng.randrange(20, 900)) for i in range(800)]
    out = sharding.assign(frame(spark, rows), 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [r.b for r in out]
    assert len(out) == 16 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16
    one = sharding.assign(frame(spark, rows[300:]), 16).where("size = 181").select("shard").distinct().count()
    assert one >= 1


def test_packing_is_near_even():
    rng = np.random.default_rng(0)
    v = np.stack([rng.lognormal(5, 1.5, 2000), rng.lognormal(3, 1, 2000), np.ones(2000)], axis=1)
    load = np.bincount(sharding.pack(v, 16), v[:, 0], 16)
    assert load.max() / load.min() < 1.001


def test_packing_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(sharding, "ROUNDS", 0)
    rng = random.Random(4)
    for n, shards in ((0, 3), (1, 3), (60, 4), (200, 7)):
        v = [[rng.randrange(1, 900), rng.randrange(0, 90), rng.randrange(1, 5)] for _ in range(n)]
        total = [max(sum(x[m] for x in v), 1e-12) for m in range(3)]
        share = [[x[m] / total[m] * sharding.WEIGHTS[m] ** 0.5 for m in range(3)] for x in v]
        left = [[sum(x[m] for x in share) / shards for m in range(3)] for _ in range(shards)]
        place = [0] * n
        for i in sorted(range(n), key=lambda i: (-share[i][0], i)):
            square = sum(x * x for x in share[i])
            fit = [round(sum(a * b for a, b in zip(r, share[i], strict=True)) / square, 12) for r in left]
            place[i] = fit.index(max(fit))
            left[place[i]] = [a - b for a, b in zip(left[place[i]], share[i], strict=True)]
        assert sharding.pack(np.array(v, float).reshape(-1, 3), shards).tolist() == place


def test_shards_in_slices_and_files(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 8)
    out = sharding.assign(docs, 4).collect()
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(rows)


# repeated passages


def brute_words(rows, width):
    count = collections.Counter(tuple(w[i : i + width]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - width + 1))
    for d, t in rows:
        w = words_of(t)
        gone = {i + j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(width)}
        yield d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup(docs, rows, nothing, monkeypatch, most):
    monkeypatch.setattr(anchors, "KINDS", most)
    got = collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == collections.Counter(brute_words(rows, 35))
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_cuts_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(700))) for i in range(4)]
    rows += [(9, rows[0][1] + " " + rows[1][1]), (10, "a a " * 300)]
    monkeypatch.setattr(anchors, "BLOCK", 100)
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    unit = substring_dedup.Words()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["k", "t", "text"])
    segments = pa.Table.from_batches(list(unit.segments([batch]))).to_pylist()
    for d, t in rows:
        own = sorted((s["p"] >> 32, s["p"] >> 16 & 0xFFFF) for s in segments if s["k"] == d)
        assert [x for s, n in own for x in range(s, s + n)] == list(range(len(t.split()) - 34))
    assert np.array_equal(substring_dedup.word_hashes(rows[4][1].encode()), np.concatenate([substring_dedup.word_hashes(w) for w in rows[4][1].encode().split()]))


@pytest.mark.parametrize("unit", [substring_dedup.Words(), suffix_array.Bytes()])
def test_segments_of_one_anchor_are_told_apart_by_64_bits(monkeypatch, unit):
    import pyarrow as pa

    rng = random.Random(13)
    passage = " ".join(str(rng.randrange(50)) for _ in range(40))
    texts = [" ".join([*(str(rng.randrange(50)) for _ in range(20)), passage, *(str(rng.randrange(50)) for _ in range(20))]) for _ in range(50)]
    real = anchors.range_hash
    # contents that differ in their upper 33 bits only
    monkeypatch.setattr(anchors, "range_hash", lambda *x: real(*x) & ~np.uint64(0x7FFFFFFF))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(texts)], ["k", "t", "text"])
    found = [s for out in unit.segments([batch]) for s in out.to_pylist()]
    contents = collections.defaultdict(set)
    for s in found:
        start, windows = s["p"] >> 32, s["p"] >> 16 & 0xFFFF
        contents[s["h"], s["g"]] |= set(unit.cut(texts[s["k"]].encode(), [(start, start + windows - 1 + unit.width)]))
    assert len({h for h, _ in contents}) < len(contents)
    assert all(len(x) == 1 for x in contents.values())


def test_automaton_counts():
    rng = random.Random(1)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(20)]
    automaton = substring_dedup.Automaton(sequences)
    for width in (1, 3, 6):
        count = collections.Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
        for s in [*sequences, [9, 0, 1, 2, 0, 1], [0] * 12]:
            want = [count[tuple(s[i : i + width])] >= 2 for i in range(len(s) - width + 1)]
            assert automaton.repeats(s, width) == want


def brute_bytes(rows, width):
    last = 1 << 63
    key = lambda d, t: (last if d is None else d)
    # texts that share a doc_id follow each other by the hash that the operator uses
    order = sorted({(key(d, t), xxh(t), t or "") for d, t in rows})
    first = {}
    for k, h, t in order:
        b = t.encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (k, h, i))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != (key(d, t), xxh(t), i):
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def xxh(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("most", [2000, 1])
def test_suffix_array_dedup(docs, rows, nothing, monkeypatch, most):
    monkeypatch.setattr(anchors, "KINDS", most)
    got = collections.Counter(tuple(r) for r in suffix_array.remove_repeats(docs).collect())
    assert got == collections.Counter(brute_bytes(rows, 100))
    assert suffix_array.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("unit", [substring_dedup.Words(35, 8), suffix_array.Bytes(100, 32)])
def test_kinds_of_a_frequent_line_split_without_a_row_per_window(spark, monkeypatch, unit):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(4))
    line = [word() for _ in range(30)]
    around = [[word() for _ in range(30)] for _ in range(12)]
    # contexts repeat in parts: to the left of the line, to its right, or on both sides by only a few words
    rows = []
    for i in range(150):
        left, right = (rng.choice(around)[-rng.randrange(1, 30) :], rng.choice(around)[: rng.randrange(1, 30)])
        rows.append((i, " ".join([word(), *left, *line, *right, word(), str(i)])))
    monkeypatch.setattr(anchors, "KINDS", 4)
    made = collections.defaultdict(list)
    real = anchors.materialize

    def watched(df, name):
        out = real(df, name)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(anchors, "materialize", watched)
    operator = suffix_array if unit.keep_first else substring_dedup
    got = collections.Counter(tuple(r) for r in operator.remove_repeats(frame(spark, rows)).collect())
    assert got == collections.Counter(brute_bytes(rows, 100) if unit.keep_first else brute_words(rows, 35))
    rounds = [*made["kinds"], *made["parts"]]
    assert made["hot-anchors"] != [0] and len(rounds) > 2
    assert all(b <= 2 * a for a, b in zip(rounds, rounds[1:]))


def test_doc_ids_of_any_type_order_documents(spark):
    rows = [r for r in corpus(4, 40) if r[0] is not None]
    # the order of the texts of ids is that of the numbers
    named = frame(spark, rows).withColumn("doc_id", F.format_string("n%05d", "doc_id"))
    for findings in (line_dedup.line_findings, substring_dedup.remove_repeats, suffix_array.remove_repeats):
        got = collections.Counter((int(r[0][1:]), *r[1:]) for r in findings(named).collect())
        assert got == collections.Counter(tuple(r) for r in findings(frame(spark, rows)).collect())


def test_long_bytes_are_cut_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (5000, 99, 100, 700, 3000)]
    monkeypatch.setattr(anchors, "BLOCK", 256)
    unit = suffix_array.Bytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([0] * 5), pa.array(texts)], ["k", "t", "text"])
    segments = pa.Table.from_batches(list(unit.segments([batch]))).to_pylist()
    for d, t in enumerate(texts):
        own = sorted((s["p"] >> 32, s["p"] >> 16 & 0xFFFF) for s in segments if s["k"] == d)
        assert [x for s, n in own for x in range(s, s + n)] == list(range(len(t) - 99))
    assert sorted(s["h"] for s in segments) == sorted(h for b in unit.anchors([batch]) for h in b.column(0).to_pylist())


def test_kernels_count_copies():
    rng = random.Random(2)
    for _ in range(30):
        texts = list({" ".join(rng.choice("ab") for _ in range(rng.randrange(6, 14))) for _ in range(6)})
        times = np.array([rng.choice([1, 1, 3]) for _ in texts])
        order = np.array(rng.sample(range(len(texts)), len(texts)))
        want = collections.Counter()
        for t, n in zip(texts, times, strict=True):
            w = t.split()
            want.update({tuple(w[i : i + 5]): 0 for i in range(len(w) - 4)})
            for i in range(len(w) - 4):
                want[tuple(w[i : i + 5])] += int(n)
        got = {(i, x) for i, a, b, _ in substring_dedup.Words(5, 2).compare([t.encode() for t in texts], times, order) for x in range(a, b)}
        assert got == {(i, x) for i, t in enumerate(texts) for x in range(len(t.split()) - 4) if want[tuple(t.split()[x : x + 5])] > 1}
        first = {}
        for i in np.argsort(order):
            for x in range(len(texts[i]) - 6):
                first.setdefault(texts[i][x : x + 7], (i, x))
        runs = suffix_array.Bytes(7, 2).compare([t.encode() for t in texts], times, order)
        late = {(i, x) for i, a, b, every in runs if every for x in range(a, b)}
        assert late == {(i, x) for i, t in enumerate(texts) for x in range(len(t) - 6) if first[t[x : x + 7]] != (i, x)}
        assert {i for i, _, _, every in runs if not every} == set(np.flatnonzero(times > 1))


def test_buckets_sort_suffixes():
    rng = np.random.default_rng(0)
    for depth in (1, 7, 20, 100):
        data = rng.integers(97, 99, 300, dtype=np.uint8)
        order, pointer = suffix_array.buckets(data, depth)
        raw = data.tobytes()
        keys = [raw[i : i + depth] for i in range(300)]
        assert [keys[i] for i in order] == sorted(keys)
        assert all((pointer[i] == pointer[j]) == (keys[i] == keys[j]) for i in range(300) for j in range(i))


# toxicity


def toxic_corpus(n=900):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfg") for _ in range(2))
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(rng.randint(2, 10))]
        bad = i % 6 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += f" you {rng.choice(['zork', 'blahrg', 'quux'])} fool"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return docs + [(n, None), (n + 1, ""), (None, "zork fool")], labels + [(n + 5, 1), (3, None)]


def test_toxicity_generalises_and_locates(spark, nothing):
    docs, labels = toxic_corpus()
    d, m = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, m)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs)
    truth = dict(labels)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == (truth[i] == 1) for i in held if truth[i] is not None)
    assert right / len(held) > 0.97
    found = toxicity.offending_sentences(d, model, threshold=0.7).where("doc_id = 0").collect()
    assert len(found) == 1 and "fool" in found[0].sentence
    kept = toxicity.reject_toxic(d, m)
    assert kept.columns == d.columns and {0, 6}.isdisjoint(r.doc_id for r in kept.collect())
    assert toxicity.score(nothing, model).count() == 0
    neutral = toxicity.fit(d, m.where("toxic = 0"))
    assert {r.score for r in toxicity.score(d, neutral).where("doc_id = 901").collect()} == {0.5}


def test_training_and_scores_equal_plain_loops():
    import math
    import re

    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choice(["ab", "cdefg", "zork", "é", "Xy"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(4))) for _ in range(40)]
    label = np.array([int("zork" in t) for t in texts])
    features, sentence, owner = toxicity.bags([t.encode() for t in texts])
    got_weight, got_bias = toxicity.train(features, sentence, owner, label)

    def feature(word):  # of one word and its stems
        return toxicity.bags([word.encode()])[0].tolist()

    parts = [[[f for w in re.findall(r"[a-zé]+", s.lower()) for f in feature(w)] for s in re.split(r"[.!?\n]", t)] for t in texts]
    parts = [[s for s in t if s] for t in parts]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    weight, bias, seen, seen_bias = collections.defaultdict(float), -4.0, collections.defaultdict(lambda: 1e-8), 1e-8
    used = sorted({f for t in parts for s in t for f in s})
    share = [0.5 / label.sum() if y else 0.5 / (1 - label).sum() for y in label]
    for _ in range(toxicity.EPOCHS):
        slope, slope_bias = {f: toxicity.DECAY * weight[f] for f in used}, 0.0
        for t, y, v in zip(parts, label, share, strict=True):
            ps = [sigmoid(sum(weight[f] for f in s) + bias) for s in t]
            whole = max(1 - math.prod(1 - p for p in ps), 1e-9)
            for s, p in zip(t, ps, strict=True):
                pull = p * (1 - y / whole) * v
                slope_bias += pull
                for f in s:
                    slope[f] += pull
        for f in used:
            seen[f] += slope[f] ** 2
            weight[f] -= toxicity.RATE * slope[f] / math.sqrt(seen[f])
        seen_bias += slope_bias**2
        bias -= toxicity.RATE * slope_bias / math.sqrt(seen_bias)
    assert abs(bias - got_bias) < 1e-4 and all(abs(weight[f] - got_weight[f]) < 1e-3 for f in used)
    one = [1 - math.prod(1 - sigmoid(sum(weight[f] for f in s) + bias) for s in t) if t else sigmoid(bias) for t in parts]
    assert np.allclose(toxicity.scores([t.encode() for t in texts], got_weight, got_bias), one, atol=1e-4)


def test_worst_sentences(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score(docs, model, worst=True).collect()
    assert all((r.worst_sentence is None) == (r.score < toxicity.THRESHOLD) for r in found)
    texts = dict(rows)
    marked = [r for r in found if r.worst_sentence is not None]
    assert len(marked) > 100 and all(r.worst_sentence in texts[r.doc_id] and "fool" in r.worst_sentence for r in marked)


def test_scores_do_not_depend_on_their_batch():
    docs, _ = toxic_corpus(50)
    texts = [(t or "").encode() for _, t in docs]
    weight = np.random.default_rng(0).normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    whole = toxicity.scores(texts, weight, -2.0)
    assert np.allclose(whole, [toxicity.scores([t], weight, -2.0)[0] for t in texts])


# contamination


def test_decontamination(spark, nothing):
    item = "In the year 1984 Alice bought 12 apples and 30 km of rope, then Alice sold 12 apples to old Bob for 5 dollars each."
    reworded = item.replace("Alice", "Carol").replace("12", "77").replace("1984", "2001").replace("Bob", "Dave")
    broken = item.replace("12 apples and", "13 apples and").replace("then Alice", "then Zoe")
    rng = random.Random(0)
    noise = lambda k: " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(k))
    rows = [(1, noise(30) + " " + item + " " + noise(30)), (2, "and so " + reworded.upper()[:0] + reworded), (3, broken), (4, noise(80)), (5, None), (6, ""), (None, item), (7, " ".join(item.split()[:9])), (1, noise(30))]
    bench = spark.createDataFrame([(0, item, 3), (1, noise(25), 4), (2, None, 5), (3, "two words", 6), (0, item, 3)], "item_id long, text string, doc_id int")
    d = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (None, 0)}
    assert got[1, 0].coverage > 0.9 and not got[1, 0].reworded and got[2, 0].reworded and got[2, 0].n_slots > 3
    left = decontaminate.remove_contaminated(d, bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6, 7] and left.columns == d.columns
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(d, bench.where("item_id > 5")).count() == 0


def test_names_that_open_sentences_are_slots(spark):
    item = "Tom has 3 apples. Jane has 5 apples. How many do Tom and Jane have?"
    asked = lambda *names: "{0} has 7 apples. {1} has 9 apples. How many do {0} and {1} have?".format(*names)
    quoted = "Question: \"Tom has 3 pears\", said Ann.\nJane has 5 plums. J. Smith has (Tom says) 4 figs."
    again = "so we ask: \"Mia has 6 pears\", said Eva.\nBob has 8 plums. K. Jones has (Mia says) 5 figs."
    rows = [(1, asked("Bob", "Mia")), (2, "well then " + asked("Bob", "Mia")), (3, asked("Bob", "Mia").replace("do Bob", "do Zoe")), (4, again), (5, "“Bob” has 7 apples. ‘Mia’ has 9 apples. How many do Bob and Mia have?")]
    rows += [(6, "BOB HAS SEVEN APPLES AND MIA HAS NINE PEARS TODAY AND EVER")]
    bench = spark.createDataFrame([(0, item), (1, quoted), (2, "WHAT IS THE NAME OF THE CAPITAL")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (5, 0)}
    assert got[1, 0].coverage == got[2, 0].coverage == got[5, 0].coverage == 1.0 and got[1, 0].reworded


def test_copies_in_another_case_and_merged_names(spark):
    item = "Tom gives 2 apples to Ann. Ann gives 3 km of rope to Bob Smith, who lives in Old Town with Tom. Is Ann happy?"
    rows = [(1, item.upper()), (2, item.lower()), (3, "well, " + item.lower().replace("?", " ?!")), (4, item.replace("Tom", "Zed").replace("Ann", "Zed"))]
    rows += [(5, item.replace("Tom", "Ann_").replace("Ann.", "Tom.").replace("Ann ", "Tom ").replace("Ann_", "Ann")), (6, item.replace("km", "miles").replace("2", "40")), (7, item.lower().replace("ann", "eve"))]
    # two other words: each costs itself, not the five windows over it
    rows += [(8, item.replace("rope", "wire").replace("Old", "the"))]
    # a copy in two halves, and two askings of one item with other parameters
    half = item.index("Bob")
    rows += [(9, item[:half] + "so to say " + item[half:]), (10, item[:half].replace("Ann", "Eve") + "so to say " + item[half:]), (11, item.replace("Ann", "Eve") + " " + item.replace("Ann", "Kim"))]
    bench = spark.createDataFrame([(0, item), (0, "an other text of item zero with 5 words more"), (1, "An other text of ITEM zero, with 5 words more!")], "item_id long, text string")
    rows += [(12, "an other text of item zero with 6 words more")]
    got = collections.Counter((r.doc_id, r.item_id, r.reworded) for r in decontaminate.contaminated(frame(spark, rows), bench).collect())
    assert got == {(1, 0, False): 1, (2, 0, False): 1, (3, 0, False): 1, (5, 0, True): 1, (6, 0, True): 1, (7, 0, False): 1, (8, 0, False): 1, (9, 0, False): 1, (11, 0, True): 1, (12, 0, True): 1, (12, 1, True): 1}


def plain_contaminated(rows, items, share=0.8):
    """The operator's definition in loops, with its patterns."""
    import string

    import regex

    java = lambda p: p.replace("\\p{Punct}", regex.escape(string.punctuation, special_only=False))
    d = decontaminate

    def words(text):
        x = text
        if regex.search(r"[0-9]", text):
            x = regex.sub(java(d._NUMBER_UNIT), d.NUMBER_UNIT, x, flags=regex.ASCII)
            x = regex.sub(java(d._UNIT), d.UNIT, regex.sub(java(d._NUMBER), d.NUMBER, x, flags=regex.ASCII), flags=regex.ASCII)
        x = regex.sub(java(d._NAME), lambda m: d.NAME + m[0], x)
        clean = lambda y: regex.split(r"[\x20\t-\r]+", regex.sub(java(d._PUNCTUATION), "", y).lower())
        typed = [w for w in clean(x) if w]
        values = [w for w in clean(text) if w]
        kinds = [w[0] if w[0] in d.NUMBER + d.UNIT + d.NUMBER_UNIT + d.NAME else None for w in typed]
        return [d.NAME if k == d.NAME else w for k, w in zip(kinds, typed, strict=True)], [w.lstrip(d.NAME) for w in typed], kinds, values

    def ok(slots):
        return len(slots) == len({(k, a) for k, a, _ in slots}) == len({(k, b) for k, _, b in slots})

    out = set()
    for item_id, item in {x for x in items if x[1]}:
        t, n, kinds, values = words(item)
        for doc_id, text in rows:
            dt, dn, dk, dv = words(text or "")
            figures, marks = set(d.NUMBER + d.UNIT + d.NUMBER_UNIT), set(d.NUMBER + d.UNIT + d.NUMBER_UNIT + d.NAME)

            def keys(typed, named, plain):
                if all(w[0] in figures for w in named):
                    return {("values", *plain)}
                return {tuple(named)} if all(w[0] in marks for w in typed) else {tuple(typed), tuple(named)}

            found = collections.defaultdict(set)
            for p in range(len(dt) - 4):
                doc = keys(dt[p : p + 5], dn[p : p + 5], dv[p : p + 5])
                for q in range(len(t) - 4):
                    if doc & keys(t[q : q + 5], n[q : q + 5], values[q : q + 5]):
                        found[p - q] |= set(range(q, q + 5))
            for g, places in found.items():  # windows of placeholders alone on a diagonal that others found
                for q in range(len(t) - 4):
                    if all(kinds[q : q + 5]) and 0 <= q + g and dk[q + g : q + g + 5] == kinds[q : q + 5]:
                        places |= set(range(q, q + 5))
            slots = {g: {(kinds[j], values[j], dv[j + g]) for j in places if kinds[j]} for g, places in found.items()}
            same = set().union(*(places for g, places in found.items() if all(a == b for _, a, b in slots[g])))
            best = max([len(same), *(len(places) for g, places in found.items() if ok(slots[g]))])
            every = set().union(*slots.values())
            if ok(every):
                best = max(best, len(set().union(*found.values())))
            if found and best >= share * len(t):
                out.add((doc_id, item_id, best, len(t), len(every), len(same) < share * len(t)))
    return out


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST, 0])
def test_decontamination_equals_its_definition(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most)
    rng = random.Random(17)
    names, units, plain = ["Tom", "Ann", "Bob", "Ms. Li", "É. Roy"], ["km", "kg", "hours", "%"], ["gives", "has", "the", "rope", "to", "été", "well-known", "and"]

    def sentence(k):
        word = lambda: rng.choice([rng.choice(names), f"{rng.randrange(1, 30)}", f"{rng.randrange(9)} {rng.choice(units)}", f"{rng.randrange(9)}{rng.choice(units)}", *[rng.choice(plain)] * 4])
        return " ".join([rng.choice([*names, "The", "How"]), *(word() for _ in range(k))]) + rng.choice(".?!")

    items = [(i, " ".join(sentence(rng.randrange(3, 9)) for _ in range(rng.randrange(1, 4)))) for i in range(14)] + [(3, "a a a a a a a b"), (20, None), (21, ""), (22, "too few words"), (0, "Tom has 3 km of rope, Ann has 4.")]
    rows = []
    for i in range(70):
        text = rng.choice(items[:15])[1]
        for _ in range(rng.randrange(3)):
            a, b = rng.choice([("Tom", "Zoe"), ("Ann", "Tom"), ("has", "holds"), ("3", "17"), ("km", "miles"), ("rope", "wire"), (".", " !"), ("the ", "")])
            text = text.replace(a, b)
        text = rng.choice([str.upper, str.lower, str, str, str])(text)
        rows.append((i, " ".join([sentence(4), text, sentence(3)])))
    rows += [(100, None), (101, ""), (102, "a " * 50), (None, items[0][1]), rows[3], (104, " ".join(sentence(9) for _ in range(400)) + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(getattr(r, c) for c in ("doc_id", "item_id", "n_matched", "n_words", "n_slots", "reworded")) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    want = plain_contaminated(rows, items)
    assert len(want) > 20 and any(x[-1] for x in want) and got == want


def test_runs_of_numbers(spark):
    rng = random.Random(2)
    run = lambda k: " ".join(str(rng.randrange(1000)) for _ in range(k))
    items = [(0, "Sort 31 14 15 92 65 35 89 79 now"), (1, "31 14 15 92 65 35 89 79"), (2, "What follows 1 2 3 4 5 6 7 8 9 10 km 11 in the series?"), (3, "0 0 0 0 0 0 0 0")]
    rows = [(1, "Sort 7 8 9 10 11 12 13 14 now"), (2, "Sort 7 8 7 10 11 12 13 14 now"), (3, "31 14 15 92 65 35 89 79"), (4, "7 8 9 10 11 12 13 14"), (5, run(300)), (6, run(40) + " 31 14 15 92 65 35 89 79 " + run(40))]
    rows += [(7, "What follows 2 4 6 8 10 12 14 16 18 20 miles 22 in the series?"), (8, "0 " * 60), (9, "Sort 7 8 9 10 11"), (10, "what follows " + run(9)), (11, "0 1 0 1 0 1 0 1 0 1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(getattr(r, c) for c in ("doc_id", "item_id", "n_matched", "n_words", "n_slots", "reworded")) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == plain_contaminated(rows, items)
    assert {x[:2] for x in got} >= {(1, 0), (3, 1), (6, 1), (7, 2), (8, 3)} and not {x[0] for x in got} & {2, 4, 5, 9, 10, 11}


def test_a_document_of_a_hundred_thousand_numbers(spark):
    rng = random.Random(6)
    numbers = [str(rng.randrange(100)) for _ in range(100_000)]
    numbers[50_000:50_008] = "31 14 15 92 65 35 89 79".split()
    items = [(i, "Sort " + " ".join(str(rng.randrange(100)) for _ in range(12))) for i in range(30)] + [(50, "31 14 15 92 65 35 89 79")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    start = time.time()
    got = decontaminate.contaminated(frame(spark, [(1, " ".join(numbers)), (2, "0 " * 100_000)]), bench).collect()
    assert [(r.doc_id, r.item_id, r.n_matched) for r in got] == [(1, 50, 8)]
    assert time.time() - start < 60


def test_texts_do_not_travel_with_windows(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    plans = []
    real = decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), real(df, name))[1])
    bench = spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    decontaminate.contaminated(docs, bench)
    windows = next(p for p in plans if "diagonal" in p)
    optimized = windows[windows.index("== Optimized") : windows.index("== Physical")]
    join = optimized[optimized.index("Join Inner") :]
    assert "text" not in join.splitlines()[1]


def test_decontamination_plan_has_no_python(spark, docs):
    bench = spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string")
    plan = decontaminate.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# neighbours


def vectors(n=700, size=24):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, size)).astype(np.float32)
    x[5:40] = x[4]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    return rows + [(n, None, 0), (n + 1, [0.0] * size, 0), (n + 2, [float("nan")] + [1.0] * (size - 1), 0), (None, [1.0] * size, 0), (n + 3, [float("inf")] * size, 0), (n + 4, [1.0, None], 0), (650, rows[650][1], 2), (n + 50, [1.0, 2.0, 3.0], 0)]


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int").repartition(5)
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and i < 700}
    ids, x = np.array(sorted(good)), np.stack([good[i] for i in sorted(good)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    # the last query has the only vector of its length
    assert set(out) == {q for q in range(0, 700, 50)}
    hit = 0
    for q, found in out.items():
        score = unit @ unit[q]
        score[q] = -2
        best = ids[np.lexsort((ids, -np.round(score, 12)))[:5]]
        hit += len(set(best) & {v for v, _ in found})
        assert all(abs(s - unit[q] @ unit[v]) < 1e-12 for v, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hit / (5 * len(out)) >= 0.9
    exact = {r.query_id: r.vec_id for r in ann.nearest(df, probed=1.0).where("rank = 1").collect()}
    assert all(exact[q] == max((i for i in range(700) if i != q), key=lambda i: (round(unit[q] @ unit[i], 12), -i)) for q in out)


def test_scaled_copies_and_extreme_components(spark):
    # copies of one vector by powers of two tie exactly, in their bytes they differ; squares of the largest overflow, of the smallest vanish
    rows = [(i, [math.ldexp(x, e) for x in (1.0, 2.0, 3.0, 4.0)]) for i, e in enumerate([*range(-40, 40), 1000, -1000, 900, -900])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df).collect()}
    assert [out[0, k][0] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [out[50, k][0] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert len({s for _, s in out.values()}) == 1 and abs(out[0, 1][1] - 1) < 1e-15


def test_ten_thousand_scaled_copies_tie(spark):
    """Bytes differ, so no copy is dropped beforehand; all tie at the cut of every query, and smaller numbers win."""
    x = np.random.default_rng(3).normal(size=16)
    rows = [(i, (x * 2.0 ** (i % 40 - 20) * (1 if i % 40 != 7 else 3.0)).tolist()) for i in range(10_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, 5, 500).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == 20
    for q, found in got.items():
        # scores of scaled copies are equal but for rounding; of exactly equal ones the smaller number is first
        assert len(found) == 5 and all(s > 1 - 1e-12 for _, s in found) and q not in [v for v, _ in found]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_copies_are_ranked_by_number(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df).collect()}
    assert [out[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [out[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert ann.nearest(df.where("vec_id < 3")).count() == 2 and ann.nearest(df.where("vec_id < 0")).count() == 0


def test_queries_that_meet_few_are_asked_of_all(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[:290] = x[0] + 1e-3 * rng.normal(size=(290, 64))  # a cluster; the others lie on other axes
    x[50] = -x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + 10 * i, rng.normal(size=32).tolist()) for i in range(7)]
    rows += [(2000 + 10 * i, [1.0, 2.0, 3.0]) for i in range(20)] + [(3000, [3.0, -1.0]), (3001, [-3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = collections.defaultdict(list), {}
    for r in ann.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, v in rows:
        if q % 10 == 0:
            near = [(-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, w in rows if len(w) == len(v) and i != q]
            want[q] = len(near[:5]), [i for _, i in sorted((round(s, 12), i) for s, i in near)[:5]]
    assert {q: len(x) for q, x in got.items()} == {q: n for q, (n, _) in want.items()}
    assert all(got[q] == want[q][1] for q in (50, *range(1000, 1070, 10), *range(2000, 2200, 10), 3000))


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    df = spark.createDataFrame([(i, v) for i, v, _ in vectors()[:700]], "vec_id long, embedding array<float>")
    want = sorted(tuple(r) for r in ann.nearest(df).collect())
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(tuple(r) for r in ann.nearest(df).collect()) == want

"""Periodic runs, fill-in-middle and near-duplicate vectors against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.llm import fill_in_middle as fim
from chronoweave.llm import periodic_runs, vector_dedup

SF = "/root/testdata/sf0.01"


def plain_next_smaller(s):
    n = len(s) - 1
    nxt, match = [], []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
        k = 0
        while j < n and s[i + k] == s[j + k]:
            k += 1
        nxt.append(j)
        match.append(k)
    return nxt, match


def plain_runs(s, least=6, exponent=4):
    n, out = len(s), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            w = s[i : j + q]
            if len(w) >= max(least, exponent * q) and not any(w[d:] == w[: len(w) - d] for d in range(1, q)):
                out.append((i, len(w), q))
            i = j
    return sorted(out)


WORDS = st.lists(st.integers(0, 3), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(WORDS, st.integers(1, 6)), max_size=4))
def test_next_smaller_suffixes_and_runs_equal_brute_force(parts):
    s = [c for word, times in parts for c in word * times]
    for text in (s, [3 - c for c in s]):
        assert periodic_runs.next_smaller([*text, -1]) == plain_next_smaller([*text, -1])
    for least, exponent in ((2, 2), (6, 4), (1, 3)):
        assert periodic_runs.word_runs(np.array(s, np.int64), least, exponent) == plain_runs(s, least, exponent)


class Counted(list):
    looks = 0

    def __getitem__(self, k):
        Counted.looks += 1
        return list.__getitem__(self, k)


def test_time_is_linear_in_any_order():
    a, b = [0], [0, 1]
    while len(b) < 8000:
        a, b = b, b + a
    ruler = [(i & -i).bit_length() for i in range(1, 8192)]
    thue = [bin(i).count("1") & 1 for i in range(8192)]
    for s in (b, b[::-1], ruler, thue, [0] * 8000, ([0] * 90 + [1]) * 90, b[:2000] * 4):
        for text in (s, [max(s) - c for c in s]):
            Counted.looks = 0
            periodic_runs.next_smaller(Counted([*text, -1]))
            assert Counted.looks < 9 * len(text)


def test_cuts_at_rare_words_lose_no_run():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(1, 80))]
        at, q = rng.randrange(len(s)), rng.randrange(1, 6)
        s[at:at] = (s[at : at + q] * 9)[: rng.randrange(30)]
        codes = np.array(s, np.int64)
        assert periodic_runs.word_runs(codes) == periodic_runs.runs_of(np.unique(codes, return_inverse=True)[1]) == plain_runs(s)


def frame(spark, rows, kind="string"):
    return spark.createDataFrame([(a, b, 1, "q") for a, b in rows], f"doc_id long, text {kind}, n int, Runs string").repartition(3)


def test_periodic_runs_table(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", 200)
    rng = random.Random(1)
    rows = [(i, rng.choice([" ", "\n\t", "  "]).join(rng.choice(["a", "b", "é", "日"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(99, None), (98, ""), (97, " \t "), (None, "x " * 50), rows[3], rows[3], (96, "ab c " * 20000), (95, " a a\x0ba\x0ca\ra a a")]
    got = periodic_runs.periodic_runs(frame(spark, rows))
    want = []
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 2)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc_id, runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(frame(spark, rows), exponent=1)


def test_op11_equals_its_contract(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if n > 500:
            continue  # brute force is quadratic
        if h % 10 == 0 and n:
            planted += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[doc_id] == (len(runs), *first, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert planted > 20


def drawn(doc_id):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain_cut(doc_id, text, unit=r"(?s:.)"):
    text, unit = text or "", unit.replace("(?s).", "(?s:.)")
    units = [m.group() for m in re.finditer(f"(?:{unit})|(?s:.)", text)]
    n = len(units)
    if doc_id is None or not text or re.search("<[PSM]>", text) or drawn(doc_id)[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    h = drawn(doc_id)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:x], units[x:y], units[y:]))
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize(("unit", "block"), [(fim.CODE_POINT, 256), (fim.CODE_POINT, 1), (fim.CODE_POINT, 7), (r"\S+\s*", 16), (r"\S+\s*", 256)])
def test_cuts_and_restored_texts(spark, unit, block, repeated):
    rng = random.Random(3)
    letters = "ab <>PSMé😀́\n\t日"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 255, 256, 257, 512, 900])))) for i in range(120)]
    rows += [(400, None), (401, "has <S> mark"), (402, "xy " * 30000)]
    if repeated:
        rows += [(None, "abc"), (None, None), (None, "abc"), rows[4], rows[4], (7, "another text")]
    made = fim.fill_in_middle(frame(spark, rows), unit=unit, block=block)
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((plain_cut(a, b, unit) for a, b in rows), key=repr)
    assert sorted(((r.doc_id, r.back) for r in back), key=repr) == sorted(((a, b or "") for a, b in rows), key=repr)


def test_cuts_by_shuffle_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(fim, "MAX_BROADCAST_IDS", 3)
    rows = [(i, "word " * i) for i in range(40)]
    assert sorted(tuple(r) for r in fim.fill_in_middle(frame(spark, rows)).collect()) == sorted(plain_cut(a, b) for a, b in rows)
    assert fim.fill_in_middle(frame(spark, rows).limit(0)).collect() == []


def plain_links(rows, threshold=0.95):
    usable = {}
    for i, x in rows:
        if i is not None:
            usable.setdefault(i, [])
            if x is not None and None not in x and np.isfinite(x).all() and any(x):
                usable[i].append([float(c) for c in x])
    unit = {i: np.array(min(v)) / np.abs(min(v)).max() for i, v in usable.items() if v}
    links = {i: set() for i in usable}
    for i, a in unit.items():
        for j, b in unit.items():
            if i < j and len(a) == len(b) and (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= threshold:
                links[i].add(j)
                links[j].add(i)
    label = {}
    for i in sorted(usable):
        queue = [] if i in label else [i]
        while queue:
            if (x := queue.pop()) not in label:
                label[x] = i
                queue += links[x]
    return sorted((i, len(links[i]), label[i], label[i] == i) for i in usable)


def vector_rows():
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(20, 24)), []
    for i in range(420):
        x = base[rng.integers(20)] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.33, 1.5])
        rows.append((i, x.tolist()))
    for i in range(60):  # pairs on either side of the threshold, as near as double precision tells
        x, y = rng.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        c = 0.95 + rng.choice([-1, 1]) * 10.0 ** -rng.integers(2, 13)
        rows += [(2000 + 2 * i, x.tolist()), (2001 + 2 * i, (3 * (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))).tolist())]
    first = rows[3][1]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None]), (None, first), (5, rows[9][1]), rows[4], (1004, [])]
    rows += [(1005, [1.0, 0.0]), (1006, [2.0, 0.1]), (1007, [c * 3e200 for c in first]), (1008, [c * 1e-200 for c in first]), (1009, first), (1010, [float("inf"), 1.0])]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "vec_id long, embedding array<double>, Embedding2 string, node int").repartition(3)


@pytest.mark.parametrize(("tile", "small"), [(1024, 2048), (64, 90)])
def test_near_duplicate_vectors(spark, monkeypatch, tile, small):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    monkeypatch.setattr(vector_dedup, "SMALL_BLOCK", small)
    rows = vector_rows()
    vectors = vector_frame(spark, rows)
    want = plain_links(rows)
    assert sorted(tuple(r) for r in vector_dedup.near_duplicate_vectors(vectors).collect()) == want
    if tile == 64:
        kept = {r[0] for r in want if r[3]} | {None}
        left = vector_dedup.keep_one_vector(vectors)
        assert left.columns == vectors.columns
        assert sorted((r.vec_id for r in left.collect()), key=repr) == sorted((i for i, _ in rows if i in kept), key=repr)


def test_no_vectors(spark):
    assert vector_dedup.near_duplicate_vectors(vector_frame(spark, vector_rows()).limit(0)).collect() == []
    only_bad = vector_frame(spark, [(1, None), (2, [0.0]), (2, None)])
    assert sorted(tuple(r) for r in vector_dedup.near_duplicate_vectors(only_bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bounds_hold_and_bytes_rule_out_pairs():
    rng = np.random.default_rng(5)
    for size in (1, 2, 24, 64, 1536):
        unit = vector_dedup.unit_rows(rng.normal(size=(200, size)) * 10.0 ** rng.integers(-3, 3, (200, size)))
        q, scale, error = vector_dedup.quantised(unit)
        product = (q.astype(np.int64) @ q.astype(np.int64).T) * scale[:, None] * scale
        assert (np.abs(unit @ unit.T - product) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()
        open_ = vector_dedup.open_pairs(q, scale, error, q, scale, error, 0.95)
        assert open_[unit @ unit.T >= 0.95].all()
        assert size < 24 or open_.mean() < 0.5


def test_labels_merge_like_union_find():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 60, (2, rng.integers(0, 70)))
        label, plain = np.arange(60), list(range(60))
        vector_dedup.merge(label, a[:30], b[:30])
        vector_dedup.merge(label, a[30:], b[30:])
        for x, y in zip(a, b, strict=True):
            old, new = max(plain[x], plain[y]), min(plain[x], plain[y])
            plain = [new if p == old else p for p in plain]
        assert label.tolist() == plain

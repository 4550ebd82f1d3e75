"""The pipeline's stages on a small corpus, and the registered queries on the driver's tables."""

import collections
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronoweave.llm import queries as llm
from chronoweave.llm import toxicity
from tests.llm.test_llm_operators import library, plain_contaminated, words_of  # noqa: F401

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_sentencepiece": ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "exact"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_suffix_array": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_decontaminate": ["doc_id", "item_id"],
    "op10_ann": ["query_id", "rank", "vec_id", "score"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_vector_dedup": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    line = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    item = line(30)
    shared = "\n".join(line(6) for _ in range(4))
    docs, labels = [], []
    for i in range(400):
        text = "\n".join(line(10) for _ in range(6))
        if i % 8 == 0:
            text += f"\nyou {rng.choice(['zork', 'quux'])} fool and {rng.choice(['zork', 'quux'])}"
        labels.append((i, 1, int(i % 8 == 0)))
        if i % 50 == 1:
            text = shared + "\n" + text
        if i % 50 == 2:
            text = text[:40] + item + text[40:]
        docs.append((i, text))
    for i in range(10):
        words = docs[10 * i + 3][1].split()  # one line, so that no window of lines repeats
        words[-1] = "changed"
        docs.append((1000 + i, " ".join(words)))
    docs += [(2000, None), (2001, ""), (None, line(40))]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item), (1, line(30)), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.collect()}
    gone = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        gone[name], left = left - now, now
    toxic = {i for i in range(400) if i % 8 == 0}
    assert gone["toxicity"] == toxic
    assert gone["line_dedup"] == set()
    near = {1000 + i for i in range(10) if 10 * i + 3 not in toxic}
    assert gone["simhash"] >= near | {2001} and gone["simhash"] <= near | {2001} | set(range(1000, 1010))
    assert gone["decontaminate"] == {i for i in range(400) if i % 50 == 2} - toxic
    assert gone["sentencepiece"] == set() and docs.where("not exact").count() == 0
    lines = spark.read.parquet(f"{folder}/out-line_dedup")
    kept = {r.doc_id: r.text for r in lines.collect()}
    assert len(kept[51].split("\n")) == len(kept[3].split("\n")) and len(kept[1].split("\n")) == len(kept[51].split("\n")) + 4


def test_run_gives_the_last_stage(spark, folder):
    want = {r.doc_id for r in spark.read.parquet(f"{folder}/out-sentencepiece").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == want


def plain_lines(rows):
    seen, out = {}, []
    for d, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            seen[key] = min(seen.get(key, (1 << 63, 0)), ((1 << 63) - 1 if d is None else d, i))
    for d, t, *rest in rows:
        lines = t.split("\n") if t is not None else []
        gone = {i + j for i in range(len(lines) - 2) if ((1 << 63) - 1 if d is None else d, i) > seen[tuple(lines[i : i + 3])] for j in range(3)}
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None, *rest))
    return out


def plain_near(rows):
    sets = []
    for r in rows:
        w = [x.lower() for x in words_of(r[1])]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    return [r for g, r in zip(group, rows, strict=True) if r[0] == first.get(g)]


def test_stages_equal_plain_versions(spark, folder, library):
    """Each stage's rows against loops over the stage's own input; the sentence model is tested beside its operator."""
    load = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/out-{name}").collect()]
    key = lambda rows: collections.Counter(rows)
    kept = load("toxicity")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert key(kept) == key(r for r in docs if toxicity.scores([(r[1] or "").encode()], *model)[0] < toxicity.THRESHOLD)
    assert key(load("line_dedup")) == key(plain_lines(kept))
    assert key(load("simhash")) == key(plain_near(load("line_dedup")))
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {x[0] for x in plain_contaminated([r[:2] for r in load("simhash")], items)}
    assert key(load("decontaminate")) == key(r for r in load("simhash") if r[0] not in hit)
    want = collections.Counter((r[0], tuple(library.encode(r[1] or ""))) for r in load("decontaminate"))
    got = spark.read.parquet(f"{folder}/out-sentencepiece").select("doc_id", "ids").collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables_and_clashing_columns(spark, folder, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "documents":
            for extra in ("_c0", "t", "k", "spans", "label", "w", "item_id"):
                df = df.withColumn(extra, F.lit(extra))
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() == 0) == (empty == "documents")
    assert out.columns[0] == "doc_id"


def test_stage_tables_are_cleared(spark, folder):
    from chronoweave.plans import storage

    storage.clear_tables(spark)
    corpus_pipeline.run(spark, folder)
    assert storage.clear_tables(spark) >= len(corpus_pipeline.STAGES) - 1


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert set(llm.queries()) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = llm.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(llm.oracle_sql()[name]).fetchall())
    got = llm.queries()[name](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_toxicity_gives_a_batch_back_in_parts():
    texts = [None, "", *[f"word{i} you fool. Fine {i}" for i in range(2 * toxicity.ROWS + 5)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    weight = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    parts = list(toxicity._below(batch, 1, weight, -1.0, 0.5))
    whole = batch.filter(pa.array(toxicity._batch_scores(batch.column(1), weight, -1.0) < 0.5))
    assert max(p.num_rows for p in parts) <= toxicity.ROWS and 0 < whole.num_rows < len(texts)
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()

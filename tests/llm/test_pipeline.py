"""The corpus pipeline: each stage against brute force on its own input, and the whole."""

import re

import pytest

import corpus_pipeline as pipeline
from gradelens.llm import quality_rules
from tests.llm.test_dedup import brute_components, brute_lines
from tests.llm.test_tokens_and_windows import brute_scan, reference_encoding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of the documents table and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "byte-level BPE"]
    assert all(rows[0].asDict().keys() == stages[0][0].asDict().keys() for rows in stages[:-1])


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality_rules.apply_rules(docs, model).collect() if r.kept}
    assert {r.doc_id for r in stages[1]} == kept and set(stages[1]) <= set(stages[0])


def test_line_stage(stages):
    want = {(d, t) for d, _, dropped, t in brute_lines([(r.doc_id, r.text) for r in stages[1]])
            if not dropped or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {(r.doc_id, r.text) for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_line_stage_drops_documents_left_without_words(spark):
    line = "One line that six documents have in common."
    rows = [(i, line, "en", "s", len(line)) for i in range(6)] + [(6, "", "en", "s", 0), (7, None, "en", "s", None), (8, line + "\nOwn words.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {d for d, _, dropped, t in brute_lines([r[:2] for r in rows]) if not dropped or re.search(r"[^\x20\x09-\x0D]", t)}
    got = {r.doc_id: r.text or "" for r in pipeline.lines(spark, docs, SF).collect()}
    assert set(got) == want == {6, 7, 8} and sum(t.count(line) for t in got.values()) == 1


def test_near_stage(stages):
    reps = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in stages[2]], 2) if d == c}
    assert {r.doc_id for r in stages[3]} == reps and set(stages[3]) <= set(stages[2])


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, hit, _ in brute_scan([(r.doc_id, r.text) for r in stages[3]], items) if not hit}
    assert {r.doc_id for r in stages[4]} == clean and set(stages[4]) <= set(stages[3])


def test_encoding_stage_and_run(spark, stages):
    enc = reference_encoding()
    texts = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id for r in stages[5]} == set(texts)
    assert all(r.token_ids == enc.encode_ordinary(texts[r.doc_id]) for r in stages[5])
    assert {(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect()} == {(r.doc_id, r.ids_sha256) for r in stages[5]}


def test_stages_take_odd_and_empty_documents(spark):
    rows = [(1, None, None, None, None), (None, "x " * 60, "en", "s", 1), (2, "", "en", "s", 0), (3, "word " * 200, "en", "s", 1), (3, "word " * 200, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (df, df.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, frame, SF).collect()

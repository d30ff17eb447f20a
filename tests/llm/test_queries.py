"""Registered queries on the smallest tables: SQL where there is one, contract columns, the pipeline's stages."""

import hashlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from corpusgauge.llm import decontaminate, paragraph_dedup, simhash_vptree
from corpusgauge.llm.queries import QUERIES
from corpusgauge.registry import Query
from tests.compare import compare, connect
from tests.conftest import SMALL

COLUMNS = {
    1: {"page_id", "host", "path", "rule", "verdict"},
    2: {"doc_id", "held_out", "score", "predicted"},
    4: {"query_id", "rank", "vec_id", "score"},
    5: {"doc_id", "start", "n_tokens", "ids_crc32"},
    6: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    7: {"doc_id", "fingerprint", "component_id"},
    8: {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    10: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    11: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    12: {"lang", "source", "part", "item", "value", "rank"},
    13: {"word", "form", "root", "n", "n_near", "form_n"},
}


def test_all_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_sql(spark, name):
    _, problem = compare(spark, connect(SMALL), SMALL, Query(name, QUERIES[name].run, QUERIES[name].sql))
    assert problem is None, problem


@pytest.mark.parametrize("name", ["op4_multi_index", "op5_orc_tokens", "op6_byte_bpe", "op7_simhash_vptree", "op8_decontaminate", "op11_warc", "op12_source_divergence", "op13_spelling_variants"])
def test_contract_columns(spark, name):
    df = QUERIES[name].run(spark, SMALL)
    assert COLUMNS[int(name[2:].split("_")[0])] <= set(df.columns)
    assert df.count() > 0


def test_pipeline(spark):
    docs = corpus_pipeline.documents(spark, SMALL)
    tests = corpus_pipeline.table(spark, SMALL, "benchmark")
    texts, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    near = seen["simhash_near_dedup"]
    kept = simhash_vptree.near_copies(near).collect()
    assert all(r.doc_id == r.component_id for r in kept)
    cut = seen["substring_dedup"]
    assert cut.count() == near.count()
    assert all(len(r.text.split()) <= len(texts[r.doc_id].split()) and r.n_chars == len(r.text) for r in cut.collect() if r.text != texts[r.doc_id])
    assert paragraph_dedup.deduplicate(cut).where("n_removed > 40").count() == 0
    assert decontaminate.matches(seen["decontamination"], tests).where("n_hit > 0").count() == 0
    out = {r.doc_id: r for r in seen["byte_bpe"].collect()}
    last = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    assert set(out) == set(last)
    assert all(r.decoded_sha256 == hashlib.sha256(last[i].encode()).hexdigest() and r.n_tokens == len(r.token_ids) for i, r in out.items())


def test_pipeline_over_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
    empty = docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, SMALL), name)
    assert docs.count() > 0 and empty.count() == 0

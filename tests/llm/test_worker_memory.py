"""What a Python worker holds is bounded by the texts at hand, and rows do not depend on how texts are dealt."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import byte_bpe, common
from corpusgauge.llm import paragraph_dedup as P
from corpusgauge.llm import toxicity as X
from corpusgauge.llm.components import components
from tests.llm.conftest import prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def model(rng: np.random.Generator) -> X.Model:
    p = {"word": rng.standard_normal((4, X.WORD_DIM)), "gram": rng.standard_normal((3, X.GRAM_DIM))}
    for side in "fb":
        p |= {"w" + side: rng.standard_normal((X.WORD_DIM + X.GRAM_DIM, 3 * X.HIDDEN)), "u" + side: rng.standard_normal((X.HIDDEN, 3 * X.HIDDEN)), "c" + side: np.zeros(3 * X.HIDDEN)}
    p |= {"att": rng.standard_normal(2 * X.HIDDEN), "out": rng.standard_normal(2 * X.HIDDEN), "bias": np.zeros(1)}
    return X.Model({b"w1": 1, b"w2": 2, b"w3": 3}, {"^w1": 0, "1$": 1, "^w2": 2}, {k: v.astype(np.float32) for k, v in p.items()})


def test_text_passes_take_every_text_once():
    texts = ["é" * 30, None, "", "b" * 500, "c", None]
    column = pa.array(["x", *texts]).slice(1)
    found = list(common.text_passes(column, 40))
    assert [t for _, _, own in found for t in own] == texts
    assert [a for a, _, _ in found] == [0, *[b for _, b, _ in found][:-1]]
    assert list(common.text_passes(pa.array([], pa.string()), 40)) == []


def test_cutter_keeps_nothing_between_passes():
    cutter = P.Cutter()
    cutter.cut(["some words"])
    tracemalloc.start()
    try:
        for n in range(4):
            cutter.cut([" ".join(f"{n}word{i}" for i in range(50_000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 5e6


def test_scorer_keeps_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(X, "CACHE_WORDS", 500)
    rng, scorer = random.Random(3), X.Scorer(model(np.random.default_rng(1)))
    passes = [[" ".join(["w1", "w2", "w3"] + [f"n{n}x{i}" for i in range(300)] + prose(rng, 20))] for n in range(6)]
    for texts in passes:
        found = scorer.texts(texts)
        assert found == pytest.approx(X.Scorer(scorer.model).texts(texts), abs=1e-5)
        assert len(scorer.place) <= 900
        assert sorted(scorer.place.values()) == list(range(len(scorer.place)))
    assert b"n0x1" not in scorer.place
    before = dict(scorer.place)
    scorer._keep(set(before) - {b"w2"})
    assert set(scorer.place) == set(before) - {b"w2"}


def test_scores_do_not_depend_on_passes(spark, odd, monkeypatch):
    own = model(np.random.default_rng(2))
    run = lambda: sorted((r.doc_id or -1, r.score, r.found) for r in X.score(odd.select("doc_id", "text", "score").na.fill("none", ["score"]), own, out="found").collect())
    whole = run()
    monkeypatch.setattr(X, "SCORED_BYTES", 40)
    monkeypatch.setattr(X, "TEXT_WINDOWS", 7)
    for a, b in zip(whole, run(), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_ids_and_bytes_do_not_depend_on_passes(odd, monkeypatch):
    def run():
        coded = byte_bpe.decode_documents(byte_bpe.encode_documents(odd.select("doc_id", "text"), RANKS, keep_text=True), RANKS).collect()
        assert all(bytes(r.decoded).decode() == (r.text or "") for r in coded)
        return sorted((r.doc_id or -1, r.text or "", r.token_ids, r.token_ends) for r in coded)

    whole = run()
    monkeypatch.setattr(byte_bpe, "ENCODED_BYTES", 20)
    monkeypatch.setattr(byte_bpe, "DECODED_IDS", 5)
    assert run() == whole


def test_bitmap_of_keys_made_of_several_columns(spark):
    rows = [(i * 7919, i % 5) for i in range(300)]
    bitmap = np.frombuffer(common.key_bitmap(spark.createDataFrame(rows, "content long, first long"), "content", "first", key=P._own), np.uint8)
    content, first = (np.array(x, np.int64) for x in zip(*rows))
    assert common.bitmap_has(bitmap, P._own(content, first)).all()
    assert common.bitmap_has(bitmap, P._own(content, first + 5)).mean() < 0.1


def test_steps_of_components_are_deleted(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 91)], "a long, b long"))
    assert {(r.node, r.root) for r in rows.collect()} == {(n, r) for group in (range(41), (90, 91)) for n in group for r in {x.root for x in rows.where(f"node = {group[0]}").collect()}}
    written = list(tmp_path.iterdir())
    assert len(written) == 1


def test_only_texts_with_copies_are_moved(spark, odd_rows):
    rng = random.Random(8)
    shared = " ".join(prose(rng, 40))
    rows = [(100 + i, " ".join(prose(rng, 300)) + (" " + shared if i in (3, 7) else "")) for i in range(30)]
    df = spark.createDataFrame([*rows, *((i, t) for i, t, _ in odd_rows)], "doc_id long, text string").repartition(2)
    found = P.deduplicate(df)
    texts = dict(rows)
    own = [r for r in found.collect()]
    assert len(own) == len(rows) + len(odd_rows)
    removed = {r.doc_id: r.n_removed for r in own if r.n_removed}
    assert set(removed) & set(texts) == {107} and removed[107] >= 36
    for r in own:
        assert r.n_words == len((texts.get(r.doc_id) if r.doc_id in texts else dict((i, t) for i, t, _ in odd_rows).get(r.doc_id) or "").split()) or r.doc_id is None
        assert r.n_removed or r.doc_id not in texts or r.text == texts[r.doc_id]
    exchanged = found._jdf.queryExecution().executedPlan().toString()
    assert "copied" in exchanged and "others" in exchanged


def test_workers_are_handed_small_batches(spark, monkeypatch):
    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(40).select("id", F.repeat(F.lit("x"), 50_000).alias("text")).coalesce(1)
    before = spark.conf.get(name)
    largest = lambda df: max(r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect())
    try:
        spark.conf.set(name, str(64 * 2**20))
        assert largest(rows) > 1_900_000
        monkeypatch.setattr(common, "BATCH_BYTES", 200_000)
        assert largest(common.small_batches(rows)) < 400_000
        spark.conf.set(name, "100000b")
        common.small_batches(rows)
        assert spark.conf.get(name) == "100000b"
        spark.conf.set(name, "64m")
        common.small_batches(rows)
        assert spark.conf.get(name) == "64m"
    finally:
        spark.conf.set(name, before)

"""Rows-only operators: brute force, bounds, seeds and edge rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.functions import tails
from corpusgauge.functions import text as tx
from corpusgauge.functions.records import parsed_list, parsed_ratio, repaired_json
from corpusgauge.operators import aggregates, draws, inference, joins, modeling, ngrams, regression, resampling, scoring, sequences
from corpusgauge.operators.tables import keep_first
from corpusgauge.registry import all_queries


def test_tail_values():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.f_tail(3.0, 2, 20) == pytest.approx(0.07251, abs=1e-4)
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.choice(["x", "y"], n), "b": rng.choice(["p", "q", "r"], n), "g": rng.integers(0, 25, n)})
    pdf["u"] = rng.normal(size=n)
    pdf["y"] = 2.0 + 1.5 * (pdf["a"] == "x") - 0.7 * pdf["u"] + rng.normal(size=n) * (1 + pdf["u"].abs())
    return pdf


def _ss(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return float(((y - design @ beta) ** 2).sum())


def test_factorial_anova_matches_row_level_fit(spark, sample):
    got = modeling.factorial_anova(spark.createDataFrame(sample), ["a", "b"], "y").toPandas().set_index("effect")
    y = sample["y"].to_numpy()
    one = np.ones((len(y), 1))
    a = (sample["a"] == "y").to_numpy(float)[:, None]
    b = np.stack([(sample["b"] == v).to_numpy(float) for v in ("q", "r")], axis=1)
    ab = np.concatenate([a * b[:, [0]], a * b[:, [1]]], axis=1)
    want = {
        "a": _ss(np.hstack([one, b]), y) - _ss(np.hstack([one, b, a]), y),
        "b": _ss(np.hstack([one, a]), y) - _ss(np.hstack([one, a, b]), y),
        "a:b": _ss(np.hstack([one, a, b]), y) - _ss(np.hstack([one, a, b, ab]), y),
    }
    for effect, ss in want.items():
        assert got.loc[effect, "ss"] == pytest.approx(ss, rel=1e-6, abs=1e-8)
    error = _ss(np.hstack([one, a, b, ab]), y) / (len(y) - 6)
    assert got.loc["a", "f"] == pytest.approx(want["a"] / error, rel=1e-6)


def test_robust_ols_matches_numpy(spark, sample):
    df = spark.createDataFrame(sample).withColumn("x", (F.col("a") == "x").cast("double"))
    got = regression.robust_ols(regression.design(df, ["x", "u"], ["y", "g"]), "y", "g").toPandas().set_index("term")
    x = np.column_stack([np.ones(len(sample)), (sample["a"] == "x").astype(float), sample["u"]])
    y = sample["y"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    scores = pd.DataFrame(x * e[:, None]).groupby(sample["g"]).sum().to_numpy()
    g, n, k = len(scores), len(y), 3
    cluster = inv @ (scores.T @ scores) @ inv * g / (g - 1) * (n - 1) / (n - k)
    assert np.allclose(got["coef"], beta)
    assert np.allclose(got["se_hc3"], np.sqrt(np.diag(hc3)))
    assert np.allclose(got["se_cluster"], np.sqrt(np.diag(cluster)))
    assert np.allclose(got["se"], np.sqrt(np.diag(inv) * (e @ e) / (n - k)))


def test_pca_loadings_are_unit_and_sign_fixed(spark, sample):
    df = spark.createDataFrame(sample).withColumn("v", F.col("y") * 2 + F.col("u"))
    loads, scored = modeling.pca_loadings(df.select("y", "u", "v"), ["y", "u", "v"])
    pdf = loads.toPandas()
    for _, part in pdf.groupby("component"):
        assert (part["loading"] ** 2).sum() == pytest.approx(1.0)
        assert part.loc[part["loading"].abs().idxmax(), "loading"] > 0
    assert scored.count() == len(sample)


def test_resampling_is_seeded_and_free_of_partitioning(spark, sample):
    df = spark.createDataFrame(sample)
    runs = []
    for parts in (1, 7):
        sums = resampling.replicate_sums(df.repartition(parts), F.col("id"), F.col("a"), F.col("y"), 50, 9, "bootstrap")
        runs.append(sums.toPandas().sort_values(["rep", "grp"]).reset_index(drop=True))
    assert (runs[0]["w"] == runs[1]["w"]).all()
    assert np.allclose(runs[0]["ws"], runs[1]["ws"])
    assert runs[0].groupby("rep")["w"].sum().mean() == pytest.approx(len(sample), rel=0.02)


def test_poisson_weights_follow_the_law():
    u = np.random.default_rng(3).random((2000, 40))
    w = resampling.poisson_weights(u)
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(15)])
    assert (w == np.searchsorted(steps, u.ravel(), side="right").reshape(u.shape)).all()


def test_bootstrap_interval_covers_the_mean(spark, sample):
    got = resampling.bootstrap_means(spark.createDataFrame(sample), F.col("id"), F.col("a"), F.col("y"), reps=300).toPandas()
    assert ((got["low"] < got["mean"]) & (got["mean"] < got["high"])).all()
    spread = sample.groupby("a")["y"].std() / np.sqrt(sample.groupby("a").size())
    width = got.set_index("grp")["high"] - got.set_index("grp")["low"]
    assert np.allclose(width / (2 * 1.96 * spread), 1.0, atol=0.2)


def test_permutation_finds_the_effect_and_only_it(spark, sample):
    df = spark.createDataFrame(sample)
    real = draws.permutation_test(df, F.col("id"), F.col("a") == "x", F.col("y"), draws=400).first()
    assert real["p"] < 0.01 and real["difference"] == pytest.approx(sample[sample.a == "x"].y.mean() - sample[sample.a == "y"].y.mean())
    none = draws.permutation_test(df, F.col("id"), F.col("a") == "x", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"), draws=400).first()
    assert none["p"] > 0.05


def test_shuffle_baseline_sees_order(spark):
    rows = [(d, i, [math.cos(i / 6), math.sin(i / 6)]) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, i int, v array<double>")
    got = resampling.shuffle_baseline(df, "d", "i", "v", reps=20).toPandas()
    assert (got["p_value"] == 0).all() and (got["original"] > got["random_mean"]).all() and (got["reps"] == 20).all()


def test_self_bleu_of_copies_is_one_and_alone_is_null(spark):
    docs = [(1, "g", "a b c d e f".split()), (2, "g", "a b c d e f".split()), (3, "g", "u v w x y z".split()), (4, "h", "a b".split()), (5, "i", []), (6, "i", ["a"])]
    df = spark.createDataFrame(docs, "id long, grp string, t array<string>")
    got = {r["id"]: r["self_bleu"] for r in ngrams.self_bleu(df, "id", ["grp"], "t").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(1.0)
    assert got[3] == 0.0 and got[4] is None and got[5] == 0.0


def test_near_copies_report_the_first_and_no_false_pair(spark):
    base = [f"w{i}" for i in range(200)]
    other = [f"z{i}" for i in range(200)]
    changed = base[:100] + ["new"] + base[101:]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(base)), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in ngrams.first_copies(df, "id", tx.tokens(F.col("text"))).collect()}
    assert got[4]["first_id"] == 1 and got[4]["jaccard"] == 1.0
    assert got[2]["first_id"] == 1 and got[2]["jaccard"] == pytest.approx(197 / 201)
    assert 3 not in got and 5 not in got


def test_fuzzy_match_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    left = [(i, list(rng.choice(words, rng.integers(1, 8)))) for i in range(25)]
    right = [(i, list(rng.choice(words, rng.integers(0, 8)))) for i in range(60)] + [(60 + i, ["w1", "w2"]) for i in range(30)]
    lf = spark.createDataFrame(left, "l long, w array<string>")
    rf = spark.createDataFrame(right, "r long, w array<string>")
    got = {r["l"]: r["r"] for r in joins.fuzzy_matches(lf, rf, "l", ["r"], "w", 0.5).collect()}
    want = {}
    for lid, lw in left:
        for rid, rw in sorted(right):
            a, b = set(lw), set(rw)
            if b and len(a & b) / len(a | b) >= 0.5:
                want[lid] = rid
                break
    assert got == want


def test_two_state_scan_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(off), int(on)) for i, (k, off, on) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 400), rng.integers(0, 2, 400), rng.integers(0, 2, 400)))]
    got = sequences.two_state_scan(spark.createDataFrame(rows, "k int, i int, off int, on int"), ["k"], "i", "off", "on")
    got = {(r["k"], r["i"]): r["decision"] for r in got.collect()}
    last = {}
    for k, i, off, on in rows:
        last[k] = on if last.get(k, 0) else off
        assert got[(k, i)] == last[k]


@pytest.mark.parametrize("alpha", [0.001, 0.01, 0.3, 0.97, 1.0])
def test_smoothing_crosses_chunks(spark, alpha):
    xs = np.random.default_rng(8).normal(50, 9, 3000)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "k int, i int, x double")
    got = [r["smoothed"] for r in sequences.exponential_smoothing(df, ["k"], "i", "x", alpha).orderBy("i").collect()]
    s, want = xs[0], [xs[0]]
    for x in xs[1:]:
        s = alpha * x + (1 - alpha) * s
        want.append(s)
    assert np.allclose(got, want)


def test_chapters_keep_marks_in_bodies(spark):
    named = "intro # 5\n# Chapter 1: One C#\nbody # x\n## part\n# 第 2 章：Two\nmore"
    plain = "before\n# First\na # b\n## sub\n# Second"
    df = spark.createDataFrame([(1, named), (2, plain), (3, ""), (4, None), (5, "no heading")], "i int, t string")
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in df.select("i", tx.chapters(F.col("t")).alias("c")).collect()}
    assert got[1] == [("1", "One C#", "body # x\n## part\n"), ("2", "Two", "more")]
    assert got[2] == [("1", "First", "a # b\n## sub"), ("2", "Second", "")]
    assert got[3] == [] and not got[4] and got[5] == []


def test_weighted_outcomes_equal_pair_rows(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"r": rng.integers(0, 8, 90), "i": rng.integers(0, 14, 90), "s": rng.integers(0, 6, 90)})
    got = aggregates.weighted_outcomes(spark.createDataFrame(pdf), "r", "i", "s").toPandas().set_index("i")
    w = np.minimum(1, pdf.groupby("i").size() / 4)
    wins, losses = dict.fromkeys(w.index, 0.0), dict.fromkeys(w.index, 0.0)
    for _, part in pdf.groupby("r"):
        for a in part.itertuples():
            for b in part.itertuples():
                if a.s > b.s:
                    wins[a.i] += (w[a.i] + w[b.i]) / 2
                    losses[b.i] += (w[a.i] + w[b.i]) / 2
    for i in w.index:
        assert got.loc[i, "weighted_wins"] == pytest.approx(wins[i]) and got.loc[i, "weighted_losses"] == pytest.approx(losses[i])


def test_scales_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "id int, v double")
    for scale in (scoring.min_max, scoring.robust_scale):
        assert [r["o"] for r in scale(df, "v", "o").orderBy("id").collect()] == [0.5, 0.5, None]


def test_holm_and_bh_by_hand(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "fam string, i int, p double")
    got = {r["i"]: r for r in inference.holm_bh(df, ["fam"], "p", "i").collect()}
    assert [round(got[i]["holm"], 6) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert [round(got[i]["bh"], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]
    assert got[1]["bonferroni"] == pytest.approx(0.16)


def test_text_edges(spark):
    docs = ["", "   ", "one", " ".join(["tok%d" % (i % 5) for i in range(9)]), " ".join(["tok%d" % (i % 5) for i in range(10)]), " ".join(f"u{i:05d}" for i in range(1001)), "été 漢字 x"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, text string")
    toks = df.select("id", tx.tokens(F.col("text")).alias("t"))
    rows = {r["id"]: r for r in toks.select("id", F.size("t").alias("n"), tx.distinct_scores(F.col("t")).alias("s")).collect()}
    assert [rows[i]["n"] for i in range(7)] == [0, 0, 1, 9, 10, 1001, 2]
    assert rows[3]["s"]["distinct_1"] == 0.0 and rows[4]["s"]["distinct_1"] == pytest.approx(5 / 11)
    assert rows[5]["s"]["distinct_1"] == pytest.approx(1000 / 1001)
    starts = spark.range(1).select(*[tx.window_starts(F.lit(n), 1000, 500).alias(str(n)) for n in (9, 1000, 1001, 2300)]).first()
    assert list(starts) == [[0], [0], [0, 1], [0, 500, 1000, 1300]]


def test_record_rules(spark):
    replies = ["```json\n{\"k\": 1}\n```", "{\"k\"： 1}", "{\"a\": 1}{\"a\": 2}", "{\"a\": [1]} tail", "nothing here"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(repaired_json(F.col("r"))).collect()]
    assert got[0] == '{"k": 1}' and got[2] == '[{"a": 1},{"a": 2}]' and got[3] == '{"a": [1]}' and got[4] == ""
    text = spark.createDataFrame([(t,) for t in ("5/5", "4/5 (0.8)", "0.75", "", "1/0")], "t string")
    assert [r[0] for r in text.select(parsed_ratio(F.col("t"))["ratio"]).collect()] == [1.0, 0.8, 0.75, None, None]
    lists = spark.createDataFrame([("[]",), ("[0.1]",), ("bad",)], "t string")
    assert [r[0] for r in lists.select(parsed_list(F.col("t"))).collect()] == [[], [0.1], []]


def test_keep_first_and_pareto_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1)], "id int, k string, o int")
    assert {(r["k"], r["id"]) for r in keep_first(df, ["k"], ["o"]).collect()} == {("a", 2), ("b", 3)}
    points = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, 4), (4, 2, 5), (5, 2, 6), (6, 3, 6)], "id int, c int, q int")
    assert {r["id"] for r in joins.pareto_front(points, "c", "q").collect()} == {1, 2, 5}


def test_lexicon_score_without_a_match_is_neutral(spark):
    from corpusgauge.queries.text import lexicon_scores

    toks = spark.createDataFrame([(1, "good"), (1, "thing"), (2, "zzz")], "doc_id int, word string")
    got = {r["doc_id"]: r["s"] for r in lexicon_scores(toks, [("good", 9.0), ("bad", 1.0)], ["doc_id"], "s").collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_correlation_of_a_constant_is_null(spark):
    from corpusgauge.functions.common import corr

    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 5.0), (None, 9.0, 1.0), (4.0, 2.0, 8.0)], "a double, b double, c double")
    row = df.agg(corr("a", "b").alias("ab"), corr("a", "c").alias("ac")).first()
    assert row["ab"] is None and row["ac"] == pytest.approx(np.corrcoef([1, 2, 4], [3, 5, 8])[0, 1])


def test_json_repair_stops_at_the_balanced_end(spark):
    cases = {
        '{"k": 1} see [note]': '{"k": 1}',
        '[1, 2][3]\n [4] tail': "[1, 2,3,4]",
        'x {"a": "} {"} {"b": 2}': '[{"a": "} {"},{"b": 2}]',
        '{"a": "q\\"}"}}': '{"a": "q\\"}"}',
        '{"a": [1, {"b": 2}]}, {"c": 3}': '{"a": [1, {"b": 2}]}',
        '{"cut": [1, 2': "",
        "no json": "",
        '```json\n{"k": 2}\n```': '{"k": 2}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    got = {r.r: r.f for r in df.select("r", repaired_json(F.col("r")).alias("f")).collect()}
    assert got == cases


def test_length_norms_of_empty_texts_are_infinite(spark, tmp_path):
    """A divisor of 0 is no error: rows equal those of the SQL, without a length both are NULL."""
    rows = [(1, "", "en", "s", 0), (2, "x", "en", "s", None), (3, "x" * 99, "en", "s", 99)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query = all_queries()["mth7_length_normalised"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(query.sql).fetchall()
    got = sorted(map(tuple, query.run(spark, str(tmp_path)).select("doc_id", "by_log", "by_root").collect()))
    assert got == sorted(want) and got[0] == (1, math.inf, 100.0) and got[1] == (2, None, None)

"""Steps whose rows, bytes or work grew faster than their input: what plans must not do again, and rows that the faster forms must keep."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusgauge.functions import text as tx
from corpusgauge.operators import aggregates, backoff, joins, ngrams
from corpusgauge.plans.ordered import quantiles
from corpusgauge.registry import all_queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chapters_mark_headings_once(spark):
    """The whole text is not marked again for every chapter."""
    df = spark.createDataFrame([(1, "# Chapter 1: a\nb")], "i int, t string").select(tx.chapters(F.col("t")).alias("c"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("split(") == 1


def test_entity_words_meet_names_before_they_are_counted(spark, tmp_path):
    """Only names are counted and moved, not all words; places and texts of names stay right."""
    docs = [(1, "Ann met bob. Ann left", "en", "s", 21), (2, "nobody here", "en", "s", 11), (3, None, "en", "s", 0), (4, "bob, Ann", "en", "s", 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Ann was"), (2, "- bob"), (3, "Ann is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = all_queries()["join14_entity_mentions"].run(spark, str(tmp_path))
    counted = _plan(df).split("count(1)")[1]
    assert "Join LeftSemi" in counted
    got = sorted(map(tuple, df.collect()))
    assert got == [(1, "Ann", 2, docs[0][1]), (1, "bob", 1, docs[0][1]), (4, "Ann", 1, "bob, Ann"), (4, "bob", 1, "bob, Ann")]


def test_quantiles_order_only_the_lanes_they_need(spark, tmp_path):
    """Lanes without a wanted place are left out, and rows meet their limits without a sort by a few groups."""
    rows = [(i % 3, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, x double")
    out = quantiles(df, ["k"], "x", {"m": 0.5})
    lanes = [f for f in out.inputFiles() if "/lanes-" in f]
    assert lanes and spark.read.parquet(*lanes).count() <= 6
    assert sorted(map(tuple, out.collect())) == [(k, 1000, float(np.median([x for g, x in rows if g == k]))) for k in range(3)]
    line = ", ".join(f"{n} {t}" for n, t in [("l_returnflag", "string"), ("l_extendedprice", "double")])
    spark.createDataFrame([(str(k), x) for k, x in rows], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = all_queries()["sta22_outliers"].run(spark, str(tmp_path))
    assert any("/limits-" in f for f in found.inputFiles()) and found.count() == 3


def test_raters_of_any_size_give_the_same_outcomes(spark, monkeypatch):
    """Small raters are put in order by one sort, a rater with many rows in lanes."""
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"r": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n)), "i": rng.integers(0, 14, n), "s": rng.integers(0, 6, n)})
    df = spark.createDataFrame(pdf)
    df = df.unionByName(df.limit(3).withColumn("r", F.lit(None).cast("long")))
    outs = []
    for most in (100_000, 20, 0):
        monkeypatch.setattr(aggregates, "RATER_ROWS", most)
        outs.append(aggregates.weighted_outcomes(df, "r", "i", "s").toPandas().sort_values("i").reset_index(drop=True))
    assert outs[0].equals(outs[1]) and outs[0].equals(outs[2])
    wins = sum(int((part["s"].to_numpy()[:, None] > part["s"].to_numpy()).sum()) for _, part in pdf.groupby("r"))
    assert outs[0]["wins"].sum() == wins and outs[0]["losses"].sum() == wins


def test_fuzzy_matches_do_not_move_the_right_side(spark, monkeypatch):
    """First match by brute force, with copies, NULL words and empty sets; right words are shuffled in neither form's filter."""
    rng = np.random.default_rng(3)
    words = lambda: [f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 9))]
    left, right = [(f"a{i}", words()) for i in range(30)] + [("none", None)], [(i, words()) for i in range(200)] + [(500, None)]
    left.append(left[0])
    lf, rf = spark.createDataFrame(left, "l string, w array<string>"), spark.createDataFrame(right, "r long, w array<string>")
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    want = {a: next((r for r, v in right if score(w, v) >= 0.6), None) for a, w in left}
    for most in (50_000, 0):
        monkeypatch.setattr(joins, "MANY_HEADS", most)
        out = joins.fuzzy_matches(lf, rf, "l", ["r"], "w", 0.6)
        rows = out.collect()
        assert {x.l: x.r for x in rows} == {a: r for a, r in want.items() if r is not None} and len({x.l for x in rows}) == len(rows)
        assert any("/heads-" in f for f in out.inputFiles()) and "sha2" not in _plan(out)


def test_overlap_cuts_texts_into_grams_once(spark):
    """Grams are not worked out again for their frequencies; other groups, NULL groups and lone documents count for nothing."""
    docs = [(1, "g", ["a", "b", "a"]), (2, "g", ["a", "b"]), (3, "g", ["c"]), (4, "h", ["a", "b"]), (5, "i", []), (6, "i", ["a", "b"]), (7, None, ["a", "b"])]
    df = spark.createDataFrame(docs, "d long, g string, t array<string>")
    out = ngrams.overlap_bleu(df, "d", ["g"], "t")
    assert _plan(out).count("Generate ") == 1
    got = {x.d: round(x.overlap, 9) for x in out.collect()}
    assert got == {1: round((2 / 6 * (1 / 4)) ** 0.5, 9), 2: round((2 / 4 * (1 / 2)) ** 0.5, 9), 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_sentence_words_meet_a_written_vocabulary(spark):
    """Frequencies and the number of sentences come from one pass, and its small table is read back."""
    df = spark.createDataFrame([(1, "A b. A c! -- ? b"), (2, "b b. c"), (3, None), (4, "...")], "doc long, text string")
    out = ngrams.sentence_continuity(df, "doc")
    assert any("/df-" in f for f in out.inputFiles())
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("posexplode") == 1
    got = {x.doc: (x.gaps, round(x.mean, 9)) for x in out.collect()}
    a, b, c = np.log(1 + 5 / 2), np.log(1 + 5 / 3), np.log(1 + 5 / 2)
    assert got == {1: (1, round(a * a / (np.hypot(a, b) * np.hypot(a, c)), 9)), 2: (1, 0.0)}


def _odd_token_rows(n=120):
    """Repeated rows, repeated and NULL ids and groups, NULL and empty texts; words come often in a document."""
    rng = np.random.default_rng(9)
    rows = [(i, ["g", "h", None][i % 3], [f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 14))]) for i in range(n)]
    return [*rows, rows[4], rows[4], (5, "g", ["w1"]), (None, "g", ["w1", "w2", "only", "here"]), (n, "g", None), (n + 1, "lone", ["w1", "w2"])]


def _grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words or []) - n + 1)]


def test_self_bleu_grams_are_worked_off_in_shares(spark):
    """Grams stay on the disks a share at a time; clipped matches are those of all pairs of rows."""
    rows = [(i, g, t) for i, (g, t) in enumerate((g, t) for _, g, t in _odd_token_rows() if g and t)]
    out = ngrams.self_bleu(spark.createDataFrame(rows, "d long, g string, t array<string>").repartition(4), "d", ["g"], "t")
    assert len({f.split("/share-")[1][:32] for f in out.inputFiles() if "/share-" in f}) == 4 * ngrams.ORDER_SLICES
    counts = [[Counter(_grams(t, n)) for n in (1, 2, 3, 4)] for _, _, t in rows]
    for x in out.collect():
        (_, group, own), mine = rows[x.d], counts[x.d]
        refs = [j for j, r in enumerate(rows) if r[1] == group and j != x.d]
        if not refs:
            assert x.self_bleu is None
            continue
        logs, zeros, hits = [], 0, 0
        for n in range(4):
            total = len(own) - n
            if total <= 0:
                continue
            m = sum(min(c, max(counts[j][n][w] for j in refs)) for w, c in mine[n].items())
            hits += m
            zeros += m == 0
            logs.append(np.log(m / total) if m else -np.log(2.0**zeros * total))
        ref = min((abs(len(rows[j][2]) - len(own)), len(rows[j][2])) for j in refs)[1]
        want = np.exp(np.mean(logs)) * (np.exp(1 - ref / len(own)) if len(own) < ref else 1) if hits else 0
        assert round(x.self_bleu, 9) == round(want, 9)


def test_shares_hold_every_gram_once(spark):
    """The shares' rows together are the counts of every document, of NULL ids and groups too."""
    rows = _odd_token_rows()
    df = spark.createDataFrame(rows, "d long, g string, t array<string>").repartition(3)
    keep, found = ngrams._slices(df, "d", ["g"], "t", (1, 3), lambda grams: grams)
    assert keep.count() == len(rows)
    got = Counter((x.doc, x.k, x.c) for x in found.collect())
    assert got == Counter((d, n, c) for d, _, t in rows for n in (1, 3) for c in Counter(_grams(t, n)).values())
    distinct = {(g, n, w) for _, g, t in rows for n in (1, 3) for w in _grams(t, n)}
    assert found.select("h", "g").distinct().count() == found.select("h").distinct().count() == len(distinct)


def test_overlap_grams_are_worked_off_in_shares(spark):
    """Repeated and NULL rows count as before; only results of a share stay."""
    rows = _odd_token_rows()
    out = ngrams.overlap_bleu(spark.createDataFrame(rows, "d long, g string, t array<string>"), "d", ["g"], "t")
    assert len({f.split("/share-")[1][:32] for f in out.inputFiles() if "/share-" in f}) == 2 * ngrams.ORDER_SLICES
    got = sorted((x.d, x.g, round(x.overlap, 9)) for x in out.collect() if x.d is not None)
    want = []
    for d, group, t in rows:
        same = [r for r in rows if r[0] == d and d is not None]
        p = []
        for n in (1, 2):
            refs = sum(r[1] == group for r in rows) - 1
            met = sum(sum(w in _grams(o[2], n) for o in rows if o[1] == r[1]) - 1 for r in same for w in set(_grams(r[2], n)))
            p.append(met / ((len(t or []) - n + 1) * refs) if t and (len(t) - n + 1) * refs else 0)
        if d is not None and group is not None:
            want.append((d, group, round((p[0] * p[1]) ** 0.5, 9) if min(p) > 0 else 0.0))
    assert got == sorted(want)


def test_shuffle_files_go_with_their_share(spark):
    """What runs inside leaves no shuffle files; the setting is put back."""
    from corpusgauge.session import shuffles_deleted

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_deleted(spark):
        assert spark.conf.get(name) == "true"
        assert spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(name) == before


def _odd_reference_rows():
    """As ``_odd_token_rows`` with a reference flag (NULL too), and words that are the names of groups."""
    rows = [(d, g, t, [True, False, None][i % 3]) for i, (d, g, t) in enumerate(_odd_token_rows())]
    return [*rows, (900, "g", ["g", "h", "g", "g"], True), (901, "h", ["h", "g", "w1", "h"], True), (902, "g", ["h", "g", "w2"], False)]


def test_perplexity_pairs_are_worked_off_in_shares(spark):
    """Perplexities of plain counting; rows of a NULL group are left out, those of one id are one."""
    rows = _odd_reference_rows()
    df = spark.createDataFrame(rows, "d long, g string, t array<string>, r boolean").repartition(3)
    out = ngrams.perplexity(df, "d", ["g"], "t", "r")
    assert len({f.split("/share-")[1][:32] for f in out.inputFiles() if "/share-" in f}) == ngrams.PAIR_SLICES
    uni, pair, seen = Counter(), Counter(), {}
    for _, g, t, r in rows:
        if r:
            uni.update((g, w) for w in t or [])
            pair.update((g, *p) for p in _grams(t, 2))
    for d, g, t, _ in rows:
        if g is None:
            continue
        size = sum(c for (x, _), c in uni.items() if x == g) + sum(x == g for x, _ in uni) + 1
        for a, b in _grams(t, 2):
            low = (uni[g, b] + 1) / size
            high = 0.7 * pair[g, a, b] / uni[g, a] + 0.3 * low if uni[g, a] else low
            seen.setdefault(d, []).append((np.log(high), np.log(low)))
    want = {d: (len(x), *(round(v, 9) for v in np.exp(-np.mean(x, axis=0)))) for d, x in seen.items()}
    assert {x.d: (x.n, round(x.ppl_bigram, 9), round(x.ppl_unigram, 9)) for x in out.collect()} == want


def test_trigrams_are_worked_off_in_shares(spark):
    """Hashed trigrams in shares have the probabilities of the model of strings; only results of a share stay."""
    df = spark.createDataFrame(_odd_reference_rows(), "d long, g string, t array<string>, r boolean").repartition(3)
    out = backoff.trigram_perplexity(df, "d", ["g"], "t", "r")
    names = {f.split("/")[-2].split("-")[0] for f in out.inputFiles()}
    assert names == {"share"} and len({f.split("/share-")[1][:32] for f in out.inputFiles()}) == backoff.SLICES
    counts = backoff.padded_trigrams(df, ["d", "g", "r"], "t")
    joined = counts.join(backoff.trigram_model(counts, ["g"], "r").select("g", "item", "p"), ["g", "item"])
    sums = joined.groupBy("d").agg(F.sum("c").alias("n"), F.exp(-F.sum(F.col("c") * F.log("p")) / F.sum("c")).alias("ppl"))
    want = {x.d: (x.n, round(x.ppl, 9)) for x in sums.collect()}
    assert {x.d: (x.n, round(x.ppl_trigram, 9)) for x in out.collect()} == want and None in want and len(want) > 70


def test_near_copies_are_verified_in_shares(spark):
    """The first copy by brute force; strings of pairs and what a step no longer needs do not stay on the disks."""
    rng = np.random.default_rng(12)
    texts = [[f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 30))] for _ in range(25)]
    rows = [(i, " ".join(texts[i % 25][: len(texts[i % 25]) - i // 25])) for i in range(90)] + [(200, None), (201, "w1")]
    out = ngrams.first_copies(spark.createDataFrame(rows, "d long, text string"), "d", tx.words(F.col("text")))
    names = Counter(f.split("/")[-2].split("-")[0] for f in out.inputFiles())
    assert {"checked", "units", "sets"} >= set(names)
    sets = {d: set(_grams(t.split(), 2)) for d, t in rows if t}
    want = {}
    for y, b in sets.items():
        for x, a in sets.items():
            if x < y and a and b and len(a & b) / len(a | b) >= 0.6:
                want[y] = (x, round(len(a & b) / len(a | b), 9))
                break
    assert {x.d: (x.first_id, round(x.jaccard, 9)) for x in out.collect()} == want and len(want) > 40

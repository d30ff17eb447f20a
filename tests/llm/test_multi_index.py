import numpy as np

from corpusgauge.llm import multi_index as M


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 150)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * rng.choice([0.5, 1, 3])]) for i in range(300)]
    rows += [(400, None), (420, [0.0] * 8), (440, [1.0] * 7 + [float("nan")]), (460, [1.0] * 5), (480, []), (500, [1.0] * 7 + [None])]
    rows += [(None, [1.0] * 8), (20, rows[3][1]), (7, rows[7][1]), (520, [1.0] * 7 + [float("inf")])]
    got = {}
    for r in M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    known = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    asked = sorted({i for i, _ in known if i % 20 == 0})
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        own = np.array(min(list(v) for i, v in known if i == q))
        best = sorted((-float((x * own).sum()), i) for i, x in known if i != q)[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i in best} & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(asked)


def test_all_candidates_if_fewer_than_k(spark):
    rows = [(i, [1.0, float(i)], "x") for i in range(0, 50, 10)]
    got = M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in (0, 20, 40) for n in range(1, 5)]


def test_ties_go_to_the_smaller_id(spark):
    rows = [(20, [1.0, 0.0])] + [(i, [1.0, 1.0]) for i in range(1, 15)]
    got = sorted((r["rank"], r.vec_id) for r in M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    assert [i for _, i in got] == [1, 2, 3, 4, 5]


def test_every_dimension_is_searched_by_itself(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(100 + i, [1.0, float(i + 1), 2.0]) for i in range(12)]
    got = M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=3).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20, 100)}
    assert found == {0: [29, 28, 27], 20: [29, 28, 27], 100: [111, 110, 109]} and len(got) == 9


def test_empty_table(spark):
    assert M.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert M.nearest(spark.createDataFrame([(20, None)], "vec_id long, embedding array<float>")).count() == 0


def _index(vectors):
    codes = M.learn(vectors[: M.SAMPLE], float(np.linalg.norm(vectors, axis=1).max()))
    return codes, M.Shard(codes, np.arange(len(vectors)), vectors)


def test_probing_meets_every_close_code_and_few_others():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3_000, 64))
    codes, index = _index(vectors)
    assert index.n_bits == 260 and [b - a for a, b in index.spans].count(16) >= 12 and sum(b - a for a, b in index.spans) == 260
    bits = codes.bits(index.lifted)
    asked = bits[:40] ^ (rng.random((40, 260)) < 0.08)
    own, parts = M.words(asked), np.stack(M.substrings(asked, index.spans), axis=1).tolist()
    shares = []
    for q in range(40):
        far, met = (bits != asked[q]).sum(axis=1), np.zeros(0, int)
        for step in range(3):
            met = np.union1d(met, index.probe(parts[q], step))
            assert np.isin(np.flatnonzero(far <= index.complete(step)), met).all()
            shares.append((step, len(met) / len(vectors)))
        assert (M.hamming(own[q], index.codewords) == far).all()
    for step, most in ((0, 0.005), (1, 0.02), (2, 0.08)):
        assert np.mean([s for n, s in shares if n == step]) < most


def test_recall_of_64_dimensions_and_what_clusters_retrieve():
    rng = np.random.default_rng(3)
    spread = rng.standard_normal((4_000, 64))
    centres = rng.standard_normal((100, 64))
    clustered = np.repeat(centres, 40, axis=0) + 0.05 * rng.standard_normal((4_000, 64))
    for vectors, most in ((spread, 1.0), (clustered, 0.05)):
        codes, index = _index(rng.permutation(vectors))
        asked = np.arange(0, 4_000, 80)
        hit, met = 0, []
        aimed = codes.aim(index.vectors[asked])
        bits = codes.bits(aimed)
        parts = np.stack(M.substrings(bits, index.spans), axis=1).tolist()
        for q, ids, _ in index.search(asked, index.vectors[asked], 20):
            products = index.vectors @ index.vectors[asked[q]]
            products[asked[q]] = -np.inf
            hit += len(set(np.argsort(-products)[:20]) & set(ids.tolist()))
            met.append(len(index.candidates(M.words(bits)[q], parts[q], aimed[q], asked[q], 20)) / 4_000)
        assert hit >= 0.95 * 20 * len(asked)
        assert np.mean(met) < most

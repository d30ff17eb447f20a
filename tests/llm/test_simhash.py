import random

import numpy as np
import pytest

from corpusgauge.llm import components as C
from corpusgauge.llm import simhash_vptree as S
from tests.llm.conftest import prose


def groups(n, alike):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if alike(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def smallest(docs, roots):
    first = {}
    for (i, *_), r in zip(docs, roots):
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return [first.get(r) for r in roots]


@pytest.fixture(scope="module")
def docs(odd_rows):
    rng, out = random.Random(2), []
    for _ in range(30):
        base = prose(rng, rng.randint(30, 300))
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = base[:]
            for _ in range(int(len(words) * rng.choice([0, 0.01, 0.02, 0.03]))):
                words[rng.randrange(len(words))] = rng.choice(["new", "other"])
            out.append((100 + len(out), " ".join(words)))
    return out + [(i, t) for i, t, _ in odd_rows]


def test_fingerprint_components_equal_all_pairs(spark, docs):
    marks = [S.fingerprint(t) for _, t in docs]
    want = smallest(docs, groups(len(docs), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 2))
    got = {}
    for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.fp % 2**64, r.component_id))
    assert sorted(map(str, ((d[0], m, w) for d, m, w in zip(docs, marks, want)))) == sorted(str((i, *v)) for i, vs in got.items() for v in vs)


def test_near_copies_equal_all_pairs(spark, docs):
    sets = [set(S.shingle_hashes(t).tolist()) for _, t in docs]
    want = smallest(docs, groups(len(docs), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(str((r.doc_id, r.component_id)) for r in S.near_copies(df).collect())
    assert got == sorted(str((d[0], w)) for d, w in zip(docs, want))
    kept = [r.doc_id for r in S.first_copies(df).collect()]
    assert sorted(map(str, kept)) == sorted({str(w) for w in want})


def edited(rng, words, edits):
    out = words[:]
    for at in rng.sample(range(len(words)), edits):
        out[at] = f"edit{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("chunk", [500, 90])
def test_copies_that_only_the_original_links(spark, chunk, monkeypatch):
    monkeypatch.setattr(S, "CLASS_TEXTS", chunk)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(150, " ".join(base))] + [(i + (i >= 150), edited(rng, base, 3)) for i in range(300)]
    sets = [set(S.shingle_hashes(t).tolist()) for _, t in rows]
    assert all(len(s & sets[0]) >= 0.8 * len(s | sets[0]) for s in sets)
    got = S.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 301 and {r.component_id for r in got} == {0}


def test_tree_shards_hold_every_close_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    tree = S.Tree(points, 40, 2)
    rows, shards = tree.route(points)
    assert tree.leaves > 4 and len(rows) < 6 * len(points)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    met = np.eye(len(points), dtype=bool)
    for shard in range(tree.leaves):
        at = rows[shards == shard]
        met[np.ix_(at, at)] = True
    assert not (close & ~met).any()


def test_large_shards_meet_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 20)
    monkeypatch.setattr(S, "SHARD", 10**6)
    chain = [3 * 2**k - 1 for k in range(60)] + list(range(64))
    df = spark.createDataFrame([(x,) for x in set(chain)], "fp long")
    roots = {r.node: r.root for r in C.components(S.links(df)).collect()}
    values = sorted(set(chain))
    want = groups(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    same = {}
    for v, w in zip(values, want):
        same.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(r) == 1 for r in same.values()) and len({next(iter(r)) for r in same.values()}) == len(same)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (None, 3), (41, 40)]
    roots = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(42)}) == 1 and len({roots[i] for i in range(1000, 1051)}) == 1
    assert roots[0] != roots[1000]


def test_odd_columns_and_empty_table(odd, nothing, odd_rows):
    assert S.near_duplicates(odd).count() == len(odd_rows)
    assert S.first_copies(odd).columns == odd.columns
    assert S.near_duplicates(nothing).count() == 0 and S.first_copies(nothing).count() == 0

import random
import re

from corpusgauge.llm import license_scan as L

TEXTS = {
    10: "intro words here Released under the MIT License. and more text follows",
    11: "This work is licensed under the GNU General Public License, version 3.",
    12: "this work is licensed under the gnu general public LICENSE version 2 or so",
    13: "All rights reserved, all rights reserved",
    14: "license licensed reserved general",
    15: ("x " * 5000) + "Licensed under the Apache License, Version 2.0 " + ("y " * 5000),
}


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(L._UPPER, L._LOWER)))


def plain(rows):
    """Best share of every template over all windows, without bands."""
    out = {}
    known = [(n, words(t)) for n, t in L.TEMPLATES]
    klass = lambda n: n if n < 5 else 1 << (n - 1).bit_length()
    for i, text in rows:
        own = words(text)
        for name, t in known:
            longest = max(len(x) for _, x in known if klass(len(x)) == klass(len(t)))
            width = min(5, len(t))
            cut = lambda w: {tuple(w[a : a + width]) for a in range(len(w) - width + 1)}  # noqa: E731, B023
            for start in range(0, len(own), longest):
                share = len(cut(t) & cut(own[start : start + 2 * longest])) / len(cut(t))
                if share >= 0.8:
                    out.setdefault((i, name), []).append((share, start))
    return sorted(str((*k, max(s for s, _ in v), len({a for _, a in v}), min(a for _, a in v))) for k, v in out.items())


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "template", "containment", "n_windows", "first_word").collect())


def test_equals_all_windows(spark, odd_rows, monkeypatch):
    rows = list(TEXTS.items()) + [(i, t) for i, t, _ in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    templates = spark.createDataFrame([*L.TEMPLATES, ("empty", ""), ("none", None)], "template string, text string")
    assert found(L.scan(docs, templates)) == plain(rows)
    monkeypatch.setattr(L, "MAX_TEMPLATES", 0)  # without the first tests
    assert found(L.scan(docs, templates)) == plain(rows)


def test_edited_full_texts_equal_all_windows(spark):
    rng, known, rows = random.Random(4), dict(L.TEMPLATES), []
    for name in ("mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-text", "apache-2.0-header", "gpl-3.0-header", "mpl-2.0-text", "gpl-2.0-text"):
        own = known[name].split()
        for at in rng.sample(range(len(own)), len(own) // 60):
            own[at] = "edited"
        before = ["word"] * rng.randint(0, 300)
        rows.append((len(rows), " ".join(before + own + ["word"] * 40)))
    templates = spark.createDataFrame(list(L.TEMPLATES), "template string, text string")
    df = L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), templates)
    got = found(df)
    assert got == plain(rows)
    assert all(any(f"({i}, '{name}'" in g for g in got) for i, name in enumerate(("mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-text")))


def test_empty_tables_and_odd_columns(spark, odd, nothing):
    templates = spark.createDataFrame(list(L.TEMPLATES), "template string, text string")
    assert L.scan(odd, templates).count() == 0
    assert L.scan(nothing, templates).count() == 0
    assert L.scan(odd, templates.where("1 = 0")).count() == 0


def test_words_of_texts_beyond_ascii(spark):
    rows = [("ÀÉ Straße ABC-def",), ("ABC  def.",), ("",), (None,), ("\u0130I \u212aX",)]
    found = [r.w for r in spark.createDataFrame(rows, "text string").select(L.words("text").alias("w")).collect()]
    assert found == [["ÀÉ", "straße", "abc", "def"], ["abc", "def"], [], None, ["\u0130i", "\u212ax"]]


def test_texts_are_gone_through_once_for_all_classes(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(L, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or df)
    templates = spark.createDataFrame(list(L.TEMPLATES), "template string, text string")
    L.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), templates)
    plan = dict(plans)["windows"]
    assert "Union" not in plan and plan.count("Generate explode") == 1
    assert plan.count("sequence(0, (size(words") == 1

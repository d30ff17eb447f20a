"""Broken CSV lines, reports of varying shape, and dialogue signals on small rows."""

import os
import tempfile

from pyspark.sql import functions as F

from corpusgauge.operators import signals
from corpusgauge.sources import readers, sinks

SCHEMA = "story string, n int, score double"


def _csv(*lines: str) -> str:
    folder = os.path.join(tempfile.mkdtemp(prefix="corpusgauge-test-"), "csv")
    os.makedirs(folder)
    with open(f"{folder}/part.csv", "w") as f:
        f.write("\n".join(["story,n,score", *lines]) + "\n")
    return folder


def test_broken_lines_are_set_apart_with_their_reason(spark):
    path = _csv("a,1,0.5", "b,x,0.5", "c,1,high", "d,1", "e,1,2,3", '"f, ""g""",2,NaN', ",,")
    rows = [tuple(r) for r in readers.checked_metrics_csv(spark, path, SCHEMA).collect()]
    assert ("a", 1, 0.5, None, None) in rows
    assert ("b", None, 0.5, "type: n", "b,x,0.5") in rows
    assert ("c", 1, None, "type: score", "c,1,high") in rows
    assert [r[3:] for r in rows if r[0] in ("d", "e")] == [("fields", "d,1"), ("fields", "e,1,2,3")]
    assert ('f, "g"', 2, None, None, None) in rows
    assert (None, None, None, None, None) in rows
    assert len(rows) == 7


def test_reasons_do_not_depend_on_the_columns_read(spark):
    found = readers.checked_metrics_csv(spark, _csv("a,1,0.5", "b,x,0.5", "d,1"), SCHEMA)
    counts = {r["reason"]: r["count"] for r in found.groupBy("reason").count().collect()}
    assert counts == {None: 1, "type: n": 1, "fields": 1}
    assert found.where("reason is null").select("story").count() == 1


def test_written_quotes_come_back(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="corpusgauge-test-"), "q")
    rows = [('say "x", y', 1, 1.5), ("back\\slash", 2, None)]
    sinks.write_csv(spark.createDataFrame(rows, SCHEMA), path)
    assert sorted(tuple(r)[:3] for r in readers.checked_metrics_csv(spark, path, SCHEMA).collect()) == sorted(rows)


def _docs(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return df.select("id", readers.report(F.col("text")).alias("doc"))


def test_items_of_reports_of_any_shape(spark):
    docs = _docs(spark, '{"c":[{"n":1},2,null]}', '{"c":[]}', '{"c":"none"}', '{"c":{"a":1}}', "{}", "not json", None)
    rows = readers.report_items(docs, "doc", "$.c", "place", "item")
    n = F.coalesce(readers.report_field(F.col("item"), "$.n", "int"), readers.report_field(F.col("item"), "$", "int"))
    assert sorted(tuple(r) for r in rows.select("id", "place", n).collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, None)]


def test_entries_and_defaults(spark):
    docs = _docs(spark, '{"m":{"a":[1],"b":{"x":2}},"t":"hi"}', '{"m":[1]}', '{"m":{}}', '{"t":null}', None)
    rows = readers.report_entries(docs, "doc", "$.m", "key", "value")
    assert sorted((r["id"], r["key"]) for r in rows.select("id", "key").collect()) == [(0, "a"), (0, "b")]
    titles = docs.select("id", readers.report_field(F.col("doc"), "$.t", "string", "?")).collect()
    assert [r[1] for r in sorted(titles)] == ["hi", "?", "?", "?", "?"]


TURNS = "conv_id long, role string, text string, kind string"


def test_signals_of_a_dialogue(spark):
    rows = [
        (1, "ann", "The King dies. It was NOT the butler", "x"), (1, "bob", "the king dies and the tower falls", "x"),
        (2, "ann", "不是the butler", None), (2, "ann", "secret door", None), (3, "bob", None, None), (3, None, "", None), (None, "ann", "the king dies", None),
    ]
    leaves = spark.createDataFrame([(1, "tower falls"), (1, "tower falls"), (2, "king dies")], "conv_id long, phrase string")
    found = signals.dialogue_signals(
        spark.createDataFrame(rows, TURNS), ["king dies", "tower falls", ""], ["the butler"], [("bob", "king dies"), ("ann", "secret"), ("ann", "secret"), ("cid", "king dies")], leaves
    )
    got = {r["conv_id"]: (r["spoilers"], r["allowed"], r["contradicted"], r["breaches"]) for r in found.collect()}
    assert got == {
        1: (["king dies"], ["tower falls"], ["the butler"], ["bob: king dies"]),
        2: ([], [], ["the butler"], ["ann: secret"]),
        3: ([], [], [], []),
    }


def test_signals_without_rules_or_rows(spark):
    leaves = spark.createDataFrame([], "conv_id long, phrase string")
    turns = spark.createDataFrame([(1, "ann", "text", None)], TURNS)
    assert [r["n_spoilers"] for r in signals.dialogue_signals(turns, [], [], [], leaves).collect()] == [0]
    assert signals.dialogue_signals(turns.limit(0), ["a"], ["b"], [("ann", "c")], leaves).count() == 0

"""Readers, sinks and streams over several files."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from corpusgauge.registry import all_queries
from corpusgauge.sources import readers, sinks
from corpusgauge.sources.tables import table
from corpusgauge.streaming import jobs


def fresh(name: str) -> str:
    return os.path.join(tempfile.mkdtemp(prefix="corpusgauge-test-"), name)


def test_csv_round_trip_turns_nan_to_null(spark):
    path = fresh("m")
    df = spark.createDataFrame([("s1", 1.5), ("s2", float("nan")), ("s3", None)], "story string, score double")
    sinks.write_csv(df, path)
    got = {r["story"]: r["score"] for r in readers.read_metrics_csv(spark, path, "story string, score double").collect()}
    assert got == {"s1": 1.5, "s2": None, "s3": None}


def test_json_lines_and_partitioned_parquet(spark, small):
    path = fresh("j")
    nations = table(spark, small, "nation")
    sinks.write_json_lines(nations, path)
    assert readers.read_log_lines(spark, path, nations.schema.simpleString()[7:-1].replace(":", " ")).count() == nations.count()
    path = fresh("p")
    sinks.write_parquet(nations, path, ["n_regionkey"])
    assert spark.read.parquet(path).where("n_regionkey = 1").count() == nations.where("n_regionkey = 1").count()


def test_bad_log_lines_are_dropped(spark):
    path = fresh("log.jsonl")
    with open(path, "w") as f:
        f.write('{"step": "a", "n": 1}\nnot json\n{"step": "b", "n": 2}\n')
    assert [r["step"] for r in readers.read_log_lines(spark, path, "step string, n int").orderBy("n").collect()] == ["a", "b"]


def test_story_folders_pick_by_priority(spark):
    root = fresh("runs")
    for folder, names in {"r1": ["novel_story.md", "enhanced_story.md"], "r2": ["novel_story.md"], "r3": ["notes.md"]}.items():
        os.makedirs(os.path.join(root, folder))
        for n in names:
            with open(os.path.join(root, folder, n), "w") as f:
                f.write(f"{folder} {n}\nline two")
    got = {r["folder"]: r["text"] for r in readers.read_stories(spark, root, ["enhanced_story.md", "novel_story.md"]).collect()}
    assert got == {"r1": "r1 enhanced_story.md\nline two", "r2": "r2 novel_story.md\nline two"}


def test_markdown_sink(spark):
    path = fresh("md")
    df = spark.createDataFrame([("a|b", 1), ("c", 2)], "name string, n int")
    sinks.write_markdown(df, path, ["name", "n"], ["n"])
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert "| name | n |" in lines and "| a\\|b | 1 |" in lines


def _split_events(spark, small) -> str:
    """The event table as five files in time order."""
    folder = fresh("events")
    os.makedirs(folder)
    pdf = pd.read_parquet(f"{small}/events.parquet").sort_values("ts").reset_index(drop=True)
    step = len(pdf) // 5 + 1
    for i in range(5):
        pdf.iloc[i * step : (i + 1) * step].to_parquet(f"{folder}/part{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(f"{folder}/part{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return folder


def test_update_stream_over_many_files_equals_batch(spark, small):
    folder = _split_events(spark, small)
    stream = jobs.file_stream(spark, folder, "events", "part*.parquet", per_trigger=1)
    got = jobs.drain(jobs.cost_ledger(stream, "1 day", "10 minutes"), "update", ["start", "end", "event_type"])
    want = table(spark, small, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    assert {(r[0], r[1]) for r in got.groupBy("event_type").agg(F.sum("calls")).collect()} == {(r[0], r[1]) for r in want.collect()}


def test_repeats_across_files_are_dropped(spark, small):
    folder = _split_events(spark, small)
    first = f"{folder}/part4.parquet"
    pd.read_parquet(first).to_parquet(f"{folder}/part5.parquet", coerce_timestamps="us", index=False)
    os.utime(f"{folder}/part5.parquet", (1_000_010, 1_000_010))
    stream = jobs.file_stream(spark, folder, "events", "part*.parquet", per_trigger=1)
    got = jobs.drain(jobs.drop_repeats(stream, "40 days"), "append")
    assert got.count() == table(spark, small, "events").count()


def test_carried_state_spans_files(spark):
    folder = fresh("turns")
    os.makedirs(folder)
    for i in range(3):
        path = f"{folder}/t{i}.parquet"
        pd.DataFrame({"conv_id": [1, 1], "turn": [2 * i, 2 * i + 1], "role": ["user", "user"], "text": ["a", "a"]}).to_parquet(path, index=False)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    turns = jobs.file_stream(spark, folder, "conversations", "t*.parquet", per_trigger=1)
    rows = turns.select("conv_id", "turn", F.lit(1).alias("off"), F.lit(0).alias("on"))
    got = jobs.drain(jobs.carried_decisions(rows, "conv_id", "turn", "off", "on"), "update", ["conv_id", "turn"])
    assert [r["decision"] for r in got.orderBy("turn").collect()] == [1, 0, 1, 0, 1, 0]


def test_a_table_may_be_one_file_or_a_folder(spark):
    """Decisions over a folder of part files, as large tables come, equal those over one file."""
    pdf = pd.DataFrame({"conv_id": [1, 1, 1, 2, 2, 2], "turn": [0, 1, 2, 0, 1, 2], "role": "user", "text": ["a\nthe " * 50, "a" * 200, "b"] * 2})
    got = []
    for cut in (6, 2):
        folder = os.path.dirname(fresh("t"))
        path = f"{folder}/conversations.parquet"
        if cut < 6:
            os.makedirs(path)
        for i in range(0, 6, cut):
            pdf.iloc[i : i + cut].to_parquet(f"{path}/part-{i}.parquet" if cut < 6 else path, index=False)
        got.append(sorted(map(tuple, all_queries()["stm7_carried_decisions"].run(spark, folder).collect())))
    assert got[0] == got[1] and len(got[0]) == 6

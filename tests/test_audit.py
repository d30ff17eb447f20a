"""Audit log states and ordered decisions against plain replays, in order and not."""

import os
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import audit
from corpusgauge.streaming import jobs

LOG = "memory long, seq long, op string, key string, item long, tag string"


def _random_log(rng: random.Random, n: int, memories: int) -> list[tuple]:
    rows = []
    for seq in range(n):
        op = rng.choices(["set", "append", "snapshot", "rollback"], [4, 4, 2, 2])[0]
        write = op in ("set", "append")
        item = rng.choice([None, *range(9)]) if write else None
        # Half of all rows belong to one memory.
        memory = 0 if rng.random() < 0.5 else rng.randrange(memories)
        rows.append((memory, seq, op, rng.choice("abc") if write else None, item, None if write else rng.choice(["x", "y", "z"])))
    return rows


def _replay(rows: list[tuple]) -> set[tuple]:
    now, tags = {}, {}
    for memory, seq, op, key, item, tag in sorted(rows, key=lambda r: r[1]):
        data, kept = now.setdefault(memory, {}), tags.setdefault(memory, {})
        if op == "set":
            data[key] = [(seq, item, True)]
        elif op == "append":
            data[key] = [*data.get(key, []), (seq, item, False)]
        elif op == "snapshot":
            kept[tag] = dict(data)
        elif tag in kept:
            now[memory] = dict(kept[tag])
    out = set()
    for memory, data in now.items():
        for tag, keys in [*tags[memory].items(), (audit.NOW, data)]:
            for key, items in keys.items():
                base = items[0][0] if items[0][2] else None
                out.add((memory, tag, key, base, len(items), sum(i or 0 for _, i, _ in items), items[-1][0], items[-1][1]))
    return out


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("memory", "tag", "key", "base_seq", "n_items", "total", "last_seq", "last_item").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_states_equal_a_replay(spark, seed):
    rows = _random_log(random.Random(seed), 400, 6)
    got = _rows(audit.states(spark.createDataFrame(rows, LOG), parts=3))
    assert len(got) == len(set(got)) and set(got) == _replay(rows)


def test_nested_rollbacks_and_unknown_tags(spark):
    ops = [("set", "a", 1, None), ("snapshot", None, None, "x"), ("append", "a", 2, None), ("snapshot", None, None, "y"), ("rollback", None, None, "x"),
           ("append", "a", 4, None), ("rollback", None, None, "never"), ("rollback", None, None, "y"), ("append", "a", 8, None)]
    rows = [(1, i, op, key, item, tag) for i, (op, key, item, tag) in enumerate(ops)]
    got = {r[1]: r[5] for r in _rows(audit.states(spark.createDataFrame(rows, LOG)))}
    assert got == {"x": 1, "y": 3, audit.NOW: 11}


def test_null_and_empty_logs(spark):
    rows = [(None, 1, "set", "a", 1, None), (1, None, "set", "a", 1, None), (1, 2, None, "a", 1, None), (1, 3, "set", None, 1, None), (1, 4, "snapshot", None, None, None), (2, 5, "append", "", None, None)]
    assert _rows(audit.states(spark.createDataFrame(rows, LOG))) == [(2, audit.NOW, "", None, 1, 0, 5, None)]
    empty = spark.createDataFrame([], LOG)
    assert audit.states(empty).count() == 0 and audit.visible_intervals(empty).count() == 0


def test_differences_of_tags(spark):
    ops = [("set", "a", 1), ("set", "b", 1), ("snapshot", "x", None), ("set", "a", 5), ("append", "c", 2)]
    rows = [(1, i, op, key if op != "snapshot" else None, item, "x" if op == "snapshot" else None) for i, (op, key, item) in enumerate(ops)]
    found = audit.differences(audit.states(spark.createDataFrame(rows, LOG)), "x", audit.NOW)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 1, 1, 5, 1), (1, "c", None, None, 2, 1)]


def _files(frame: pd.DataFrame, per: int, name: str) -> str:
    folder = os.path.join(tempfile.mkdtemp(prefix="corpusgauge-test-"), name)
    os.makedirs(folder)
    for i in range(0, len(frame), per):
        path = f"{folder}/part{i:05}.parquet"
        frame.iloc[i : i + per].to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return folder


def test_tagged_stream_finds_the_place_of_late_rows(spark):
    rng = random.Random(5)
    rows = _random_log(rng, 240, 4)
    frame = pd.DataFrame(rows, columns=["memory", "seq", "op", "key", "item", "tag"]).astype({"item": "Int64"})
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["seq"], unit="min")
    # Rows come up to 30 minutes late, across files.
    order = np.argsort(frame["seq"] + np.array([rng.random() * 30 for _ in rows]), kind="stable")
    folder = _files(frame.iloc[order], 60, "log")
    stream = spark.readStream.schema(f"{LOG}, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    job = jobs.tagged_states(stream.withColumn("ts", F.col("ts").cast("timestamp")), "40 minutes", parts=2)
    parts = jobs.drain(job, "update", ["memory", "part", "tag"])
    assert set(_rows(parts.select("memory", "tag", F.inline("entries")))) == _replay(rows)


def test_answers_equal_a_row_loop():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        off, on, last = rng.integers(0, 2, n), rng.integers(0, 2, n), 1
        want = []
        for a, b in zip(off, on):
            last = b if last else a
            want.append(last)
        assert jobs.answers(1, off, on).tolist() == want


def test_decisions_of_shuffled_files_equal_the_ordered_run(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"conv_id": np.repeat([1, 2, 3], 40), "turn": np.tile(np.arange(40), 3), "off": rng.integers(0, 2, 120), "on": rng.integers(0, 2, 120)})
    folder = _files(frame.sample(frac=1, random_state=1), 30, "turns")
    stream = spark.readStream.schema("conv_id long, turn long, off long, on long").option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.drain(jobs.carried_decisions(stream, "conv_id", "turn", "off", "on"), "update", ["conv_id", "turn"])
    want = {(c, t, int(d)) for c, part in frame.groupby("conv_id") for t, d in zip(part["turn"], jobs.answers(0, part["off"].to_numpy(), part["on"].to_numpy()))}
    assert {tuple(r) for r in got.select("conv_id", "turn", "decision").collect()} == want


def test_closed_rows_are_one_flag(spark):
    frame = pd.DataFrame({"conv_id": 1, "turn": [0, 1, 2, 3, 4, 5, 1, 6], "off": [1, 1, 1, 1, 1, 1, 0, 1], "on": [0, 0, 0, 0, 0, 0, 0, 0]})
    folder = _files(frame, 2, "turns")
    stream = spark.readStream.schema("conv_id long, turn long, off long, on long").option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.drain(jobs.carried_decisions(stream, "conv_id", "turn", "off", "on", open_rows=2), "update", ["conv_id", "turn"])
    # The late turn 1 belongs before what is closed and is dropped.
    assert [r["decision"] for r in got.orderBy("turn").collect()] == [1, 0, 1, 0, 1, 0, 1]


def test_memories_share_states_and_parts_without_writes_tell_nothing(spark):
    """Many small memories need few states; late rows still find their place in a shared one."""
    rng = random.Random(8)
    rows = [r for r in _random_log(rng, 600, 90) if r[0] % 9 or r[2] not in ("set", "append")]
    frame = pd.DataFrame(rows, columns=["memory", "seq", "op", "key", "item", "tag"]).astype({"item": "Int64"})
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["seq"], unit="min")
    order = np.argsort(frame["seq"] + np.array([rng.random() * 30 for _ in rows]), kind="stable")
    folder = _files(frame.iloc[order], 150, "log")
    stream = spark.readStream.schema(f"{LOG}, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    job = jobs.tagged_states(stream.withColumn("ts", F.col("ts").cast("timestamp")), "40 minutes", parts=16, buckets=2)
    # One state for each part and bucket, whatever the number of memories.
    assert "[cell" in job._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1].splitlines()[0]
    told = jobs.drain(job, "update", ["memory", "part", "tag"])
    parts = told.select("memory", "part").distinct().collect()
    assert len(parts) <= 3 * len({r[0] for r in rows}) and not any(p["memory"] % 9 == 0 for p in parts)
    assert set(_rows(told.select("memory", "tag", F.inline("entries")))) == _replay(rows)

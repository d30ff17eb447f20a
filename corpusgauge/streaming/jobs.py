"""Structured Streaming jobs over append-only event and dialogue files.

Each job is a function from a streaming frame to a streaming frame; ``drain``
runs it over all files present and returns the written result as a table.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgauge.operators.audit import NOW, PARTS
from corpusgauge.session import shared_folder
from corpusgauge.sources.tables import SCHEMAS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a key that may still change because an earlier one may come late.
OPEN_ROWS = 1_000
#: States that memories share in every part, and result rows of a frame.
BUCKETS, OUT_ROWS = 64, 10_000


def file_stream(spark: SparkSession, folder: str, name: str, pattern: str | None = None, per_trigger: int = 64) -> DataFrame:
    """Files of one table as a stream; the event time becomes a timestamp.

    The table is one file or a folder of part files; with a ``pattern``, all files of
    the folder whose names match are its parts.
    """
    reader = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        raw = reader.option("pathGlobFilter", pattern).parquet(folder)
    else:
        # As a glob, the path may name a file or a folder; a plain one must be a folder.
        raw = reader.parquet(f"{folder.rstrip('/')}/{name}.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in raw.columns else raw


def drain(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run until all files are read; result folder and checkpoint are shared.

    append: a file sink.  update: every micro-batch goes to its own folder (a
    retried batch overwrites itself) and the newest row per key is the result.
    complete: each batch replaces the table.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", out).outputMode("append").start()
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            target = f"{out}/batch_id={batch_id}" if mode == "update" else out
            batch.write.mode("overwrite").parquet(target)

        run = writer.foreachBatch(save).outputMode(mode).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    schema = stream.schema
    if mode != "update":
        return spark.read.schema(schema).parquet(out)
    seen = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch_id=*")
    seen = seen.withColumn("batch_id", F.regexp_extract(F.input_file_name(), "batch_id=([0-9]+)", 1).cast("long"))
    rest = [c for c in stream.columns if c not in keys]
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*keys, "r.*")


def _flat_window(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *rest
    )


def cost_ledger(events: DataFrame, width: str, late: str) -> DataFrame:
    """Calls, tokens and cost per stage and window, updated as events arrive."""
    k = F.from_json("props", "k bigint")["k"]
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return _flat_window(grouped.agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"), F.sum("value").alias("cost")))


def peak_values(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Peak of the sampled value per tumbling or sliding window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide))
    return _flat_window(grouped.agg(F.max("value").alias("peak"), F.count("*").alias("samples")))


def counters(events: DataFrame, width: str, late: str) -> DataFrame:
    """Hit and error counters with their ratio per closed window."""
    kind = F.col("event_type")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width))
    return _flat_window(
        grouped.agg(
            F.count("*").alias("attempts"), F.count_if(kind == "view").alias("hits"), F.count_if(kind == "error").alias("errors"),
            (F.count_if(kind == "view") / F.count("*")).alias("hit_rate"),
        )
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return _flat_window(grouped.agg(F.count("*").alias("records"), F.count_if(F.col("event_type") == "error").alias("errors")))


def monitor(events: DataFrame) -> DataFrame:
    """Latest stage, elapsed time and value per user."""
    newest = F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id"))
    state = events.groupBy("user_id").agg(newest.alias("r"), F.min("ts").alias("since"), F.max("value").alias("peak"))
    elapsed = F.expr("timestampdiff(SECOND, since, r.ts)")
    return state.select("user_id", F.col("r.event_type").alias("stage"), F.col("r.value").alias("value"), elapsed.alias("elapsed"), "peak")


def drop_repeats(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_by_key(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """Value of each key at a point in time: the newest audit event wins."""
    rows = events if upto is None else events.where(upto)
    state = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("r"), F.count("*").alias("writes"))
    return state.select("user_id", F.col("r.event_id").alias("event_id"), F.col("r.value").alias("value"), "writes")


def answers(last: int, if_off: np.ndarray, if_on: np.ndarray) -> np.ndarray:
    """Each row maps the answer before it to its own; all answers of an ordered run, after ``last``.

    A row whose two answers agree sets the answer; of the others some turn it round.
    So an answer is that of the newest setting row, turned as often as rows since ask.
    """
    sets = if_off == if_on
    turned = np.cumsum(~sets & (if_off == 1))
    newest = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    start = np.where(newest >= 0, if_off[newest], last)
    return (start ^ ((turned - np.where(newest >= 0, turned[newest], 0)) & 1)).astype(np.int32)


def carried_decisions(rows: DataFrame, key: str, order: str, if_off: str, if_on: str, open_rows: int = OPEN_ROWS) -> DataFrame:
    """Decision stream whose answer depends on the key's last answer; drain it in update mode by (key, order).

    Rows may come in any order.  A key's newest ``open_rows`` rows stay open: a row
    that comes late among them changes the answers after it, which go out again.
    Older ones are folded into one flag; a row that belongs before them is dropped.
    A repeated place counts once, with the row that came last.
    """

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sealed, at, off, on, told = state.get if state.exists else (0, None, [], [], [], [])
        new = pd.concat(list(frames))
        if sealed is not None:
            new = new[new[order] > sealed]
        held = pd.DataFrame({order: at, if_off: off, if_on: on, "told": told}, dtype="int64")
        both = pd.concat([held, new[[order, if_off, if_on]].assign(told=-1)]).drop_duplicates(order, keep="last").sort_values(order)
        places = both[order].to_numpy(np.int64)
        decided = answers(last, both[if_off].to_numpy(np.int64), both[if_on].to_numpy(np.int64))
        changed = decided != both["told"].to_numpy()
        cut = max(len(places) - open_rows, 0)
        if cut:
            last, sealed = int(decided[cut - 1]), int(places[cut - 1])
        kept = [both[c].to_numpy(np.int64)[cut:].tolist() for c in (order, if_off, if_on)]
        state.update((last, sealed, *kept, decided[cut:].tolist()))
        yield pd.DataFrame({key: ident[0], order: places[changed], "decision": decided[changed]})

    held = "last int, sealed long, at array<long>, off array<long>, `on` array<long>, told array<long>"
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, decision int", held, "update", GroupStateTimeout.NoTimeout)


def tagged_states(log: DataFrame, late: str, parts: int = PARTS, buckets: int = BUCKETS) -> DataFrame:
    """``audit.states`` as a stream of log rows (ts, memory, seq, op, key, item, tag); drain it in update mode by (memory, part, tag).

    The keys of a memory are dealt to ``parts`` parts, and control rows go to all of
    them.  Memories share ``buckets`` states a part, since a call for each of many small
    ones would cost more than its rows.  Rows behind the watermark are applied in the
    order of ``seq`` and folded into lists of a key; newer ones are held, so that a late
    row still finds its place, and are replayed on a copy for what the batch reports.
    ``ts`` and ``seq`` must agree in order.  A result row holds all keys of its part
    (``entries``); a part without a write has none.
    """
    control = F.col("op").isin("snapshot", "rollback")
    everywhere = F.sequence(F.lit(0), F.lit(parts - 1))
    own = F.array(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    valid = log.where("memory is not null and seq is not null and ((op in ('snapshot', 'rollback') and tag is not null) or (op in ('set', 'append') and key is not null))")
    dealt = valid.withWatermark("ts", late).withColumn("part", F.explode(F.when(control, everywhere).otherwise(own)))
    # Control rows move once a part, so rows are narrow: an operation and its key or tag are one text.
    cell = (F.pmod(F.xxhash64("memory"), F.lit(buckets)) * parts + F.col("part")).cast("int").alias("cell")
    letter = F.when(F.col("op") == "snapshot", "n").otherwise(F.substring("op", 1, 1))
    what = F.concat(letter, F.when(control, F.col("tag")).otherwise(F.col("key"))).alias("what")
    dealt = dealt.select(cell, F.col("memory").cast("long").alias("memory"), F.col("seq").cast("long").alias("seq"), "ts", what, F.col("item").cast("string").alias("item"))
    ops = {op[0]: op for op in ("set", "append", "rollback")} | {"n": "snapshot"}

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = int(ident[0]) % parts
        every = json.loads(state.get[0]) if state.exists else {}
        fresh: dict[str, list] = {}
        if not state.hasTimedOut:
            for rows in frames:
                items = rows["item"].astype(object).where(rows["item"].notna(), None)
                stamps = pd.DatetimeIndex(rows["ts"]).as_unit("ms").asi8.tolist()
                for memory, seq, stamp, name, item in zip(rows["memory"].astype(str), rows["seq"].tolist(), stamps, rows["what"], items):
                    op, name = ops[name[0]], name[1:]
                    write = op in ("set", "append")
                    fresh.setdefault(memory, []).append([seq, stamp, op, name if write else None, None if item is None else int(item), None if write else name])
        mark = state.getCurrentWatermarkMs()
        newest, found = None, []
        for memory in every.keys() | fresh.keys():
            kept, new = every.get(memory, {"now": {}, "tags": {}, "held": []}), fresh.get(memory)
            if not new and not (kept["held"] and kept["held"][0][1] < mark):
                newest = max(newest or 0, kept["held"][-1][1]) if kept["held"] else newest
                continue
            known = {r[0] for r in kept["held"]}
            held = sorted(kept["held"] + [r for r in new or [] if r[0] not in known], key=lambda r: r[0])
            done = 0
            while done < len(held) and held[done][1] < mark:
                done += 1
            now, tags = _replay(kept["now"], kept["tags"], held[:done])
            held = held[done:]
            # Without a write all lists are empty, and so is what was told before.
            wrote = kept.get("wrote") or any(r[2] in ("set", "append") for r in new or [])
            every[memory] = {"now": now, "tags": tags, "held": held, "wrote": bool(wrote)}
            if held:
                newest = max(newest or 0, held[-1][1])
            if new and wrote:
                now, tags = _replay(now, tags, held)
                found += [(int(memory), part, tag, [(k, *v) for k, v in sorted(keys.items())]) for tag, keys in [*tags.items(), (NOW, now)]]
        state.update((json.dumps(every),))
        if newest is not None:
            state.setTimeoutTimestamp(max(newest, mark) + 1)
        for i in range(0, len(found), OUT_ROWS):
            yield pd.DataFrame(found[i : i + OUT_ROWS], columns=["memory", "part", "tag", "entries"])

    entry = "key: string, base_seq: bigint, n_items: bigint, total: bigint, last_seq: bigint, last_item: bigint"
    out = f"memory long, part int, tag string, entries array<struct<{entry}>>"
    return dealt.groupBy("cell").applyInPandasWithState(step, out, "kept string", "update", GroupStateTimeout.EventTimeTimeout)


def _replay(now: dict, tags: dict, rows: list[list]) -> tuple[dict, dict]:
    """State and tags after the ordered log rows; the given ones stay as they are."""
    now, tags = dict(now), dict(tags)
    for seq, _, op, key, item, tag in rows:
        if op == "set":
            now[key] = (seq, 1, item or 0, seq, item)
        elif op == "append":
            base, n, total, _, _ = now.get(key, (None, 0, 0, None, None))
            now[key] = (base, n + 1, total + (item or 0), seq, item)
        elif op == "snapshot":
            tags[tag] = dict(now)
        elif tag in tags:
            now = dict(tags[tag])
    return now, tags

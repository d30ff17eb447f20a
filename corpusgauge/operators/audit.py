"""Audit log of keyed memories: values as of tagged snapshots, with rollbacks.

A log row is (memory, seq, op, key, item, tag): ``set`` starts a key's list anew with
its item, ``append`` adds one, ``snapshot`` names the state under a tag, ``rollback``
takes the whole memory back to the newest snapshot of its tag.  A rollback closes
what was written since that snapshot and opens again what it held, so the state at
a point is what was written in a few disjoint intervals of ``seq``.  These come from
the control rows alone; writes meet them in one range join and are never replayed.

Cases: a tag that is taken again means its newest snapshot; a snapshot outlives a
rollback to an older one; a rollback to a tag without an earlier snapshot is
ignored; ``append`` to a key without a value starts its list; rows with a NULL
memory, seq or op are ignored, writes with a NULL key too; a NULL item is an item
that adds nothing to the sum; a snapshot of an empty memory has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag of the state after the last row.
NOW = "(now)"
#: Parts into which the keys of every memory are dealt, so that a large one is not one task's work.
PARTS = 32


def visible_intervals(log: DataFrame) -> DataFrame:
    """(memory, tag, lo, hi): a write with lo < seq < hi is part of the tag's state; the current state has tag ``NOW``.

    One ordered pass over the control rows.  Chains of intervals share their older
    links, so a task holds one link a rollback and one entry a tag.
    """
    control = log.where("op in ('snapshot', 'rollback') and memory is not null and seq is not null")
    control = control.select(F.col("memory").cast("long").alias("memory"), F.col("seq").cast("long").alias("seq"), "op", "tag")

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, tags, lo, older = None, {}, -1, None
        for batch in batches:
            found: list[tuple] = []
            for at, seq, op, tag in batch.itertuples(index=False):
                if at != memory:
                    _emit(found, memory, tags, lo, older)
                    memory, tags, lo, older = at, {}, -1, None
                if op == "snapshot":
                    tags[tag] = (lo, seq, older)
                elif tag in tags:
                    lo, older = seq, tags[tag]
            yield pd.DataFrame(found, columns=["memory", "tag", "lo", "hi"])
        found = []
        _emit(found, memory, tags, lo, older)
        yield pd.DataFrame(found, columns=["memory", "tag", "lo", "hi"])

    named = control.where("tag is not null").repartition("memory").sortWithinPartitions("memory", "seq")
    return named.mapInPandas(chains, "memory long, tag string, lo long, hi long")


def _emit(found: list[tuple], memory: int | None, tags: dict, lo: int, older: tuple | None) -> None:
    if memory is None:
        return
    for tag, link in [*tags.items(), (NOW, (lo, 2**63 - 1, older))]:
        while link:
            found.append((memory, tag, link[0], link[1]))
            link = link[2]


def states(log: DataFrame, parts: int = PARTS) -> DataFrame:
    """Every key's list under every tag: memory, tag, key, base_seq, n_items, total, last_seq, last_item.

    ``base_seq`` is the ``set`` that began the list (NULL if an ``append`` did).
    Memories without a named snapshot have the current state only.
    """
    writes = log.where("op in ('set', 'append') and memory is not null and seq is not null and key is not null")
    columns = [F.col("memory").cast("long").alias("memory"), F.col("seq").cast("long").alias("seq"), "op", "key", "item"]
    writes = writes.select(*columns, F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    spans = visible_intervals(log).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    near = (writes.memory == spans.memory) & (writes.part == spans.part) & (writes.seq > spans.lo) & (writes.seq < spans.hi)
    # A memory without control rows has one interval, everything.
    controlled = spans.select("memory").distinct()
    seen = writes.join(spans, near).select(writes.memory, "tag", "seq", "op", "key", "item")
    plain = writes.join(controlled, "memory", "left_anti").select("memory", F.lit(NOW).alias("tag"), "seq", "op", "key", "item")
    seen = seen.unionByName(plain)
    by = ["memory", "tag", "key"]
    bases = seen.where("op = 'set'").groupBy(*by).agg(F.max("seq").alias("base_seq"))
    listed = seen.join(bases, by, "left").where("base_seq is null or seq >= base_seq")
    newest = F.max_by(F.struct("seq", "item"), "seq")
    rows = listed.groupBy(*by).agg(F.max("base_seq").alias("base_seq"), F.count("*").alias("n_items"), F.sum("item").alias("total"), newest.alias("r"))
    return rows.select(*by, "base_seq", "n_items", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.col("r.seq").alias("last_seq"), F.col("r.item").alias("last_item"))


def differences(found: DataFrame, old: str, new: str) -> DataFrame:
    """Keys whose list differs between two tags of a memory: memory, key, old_total, old_items, new_total, new_items (NULL: no such key)."""

    def side(tag: str, name: str) -> DataFrame:
        shape = F.struct("base_seq", "n_items", "last_seq").alias(f"{name}_shape")
        return found.where(F.col("tag") == tag).select("memory", "key", F.col("total").alias(f"{name}_total"), F.col("n_items").alias(f"{name}_items"), shape)

    both = side(old, "old").join(side(new, "new"), ["memory", "key"], "full")
    changed = both.where(~F.col("old_shape").eqNullSafe(F.col("new_shape")))
    return changed.select("memory", "key", "old_total", "old_items", "new_total", "new_items")

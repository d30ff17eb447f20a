"""Draws of exact size without copying rows: the rows with the smallest hashes of a draw.

A row's place in a draw is a 32-bit hash of its key and the draw's number, made of
integer steps that any engine can repeat; equal hashes go by key (NULL counts as 0), then value.  A draw of
n rows is the n smallest.  Tasks hold bounded sums per draw, never all rows of a draw.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of a threshold's histogram, half its width in standard deviations, rows and draws of a numpy pass.
BINS, SPREAD, ROWS, BLOCK = 64, 8.0, 4_096, 64
#: The integer mixer: shifts and multipliers of three steps.
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in MIX:
            x ^= x >> np.uint32(shift)
            if factor:
                x *= np.uint32(factor)
    return x


def key_hash(keys: np.ndarray) -> np.ndarray:
    """32 bits of a long key."""
    u = keys.astype(np.int64).view(np.uint64)
    return mixed((u & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ mixed((u >> np.uint64(32)).astype(np.uint32)))


def salts(draws: int, seed: int) -> np.ndarray:
    return mixed(np.arange(draws, dtype=np.uint32) ^ mixed(np.array([seed], np.uint32)))


def mixed_sql(inner: str, value: str, out: str) -> str:
    """The same mixer as a DuckDB subquery: ``inner`` with a column ``out`` made of ``value``."""
    x = f"SELECT *, ({value})::UBIGINT AS m0 FROM ({inner})"
    for n, (shift, factor) in enumerate(MIX):
        step = f"xor(m{n}, m{n} >> {shift})"
        x = f"SELECT * EXCLUDE (m{n}), " + (f"({step} * {factor}::UBIGINT) & 4294967295::UBIGINT" if factor else step) + f" AS {f'm{n + 1}' if n < len(MIX) - 1 else out} FROM ({x})"
    return x


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _low(x: Column, bits: int = 32) -> Column:
    return x.bitwiseAND(F.lit(2**bits - 1).cast("long"))


def _times(x: Column, factor: int) -> Column:
    """A product's low 32 bits, in halves: the whole would not fit a long."""
    return _let(x, lambda v: _low(_low(F.shiftright(v, 16) * factor, 16) * 65536 + _low(v, 16) * factor))


def mixed_column(x: Column) -> Column:
    """The same mixer over a long column that holds 32 bits."""
    shifted = lambda x, n: _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, n)))
    for shift, factor in MIX:
        x = shifted(x, shift)
        x = _times(x, factor) if factor else x
    return x


def draw_column(key: Column, draw: Column, draws: int, seed: int) -> Column:
    """A row's hash in a draw, from its long key (NULL counts as 0) and the draw's number."""
    long = F.coalesce(key.cast("long"), F.lit(0))
    own = _let(long, lambda v: mixed_column(_low(v).bitwiseXOR(mixed_column(_low(F.shiftright(v, 32))))))
    salt = F.array(*[F.lit(int(x)).cast("long") for x in salts(draws, seed)])
    return mixed_column(own.bitwiseXOR(F.get(salt, draw)))


def _tiles(keys: np.ndarray, salt: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, draws, hashes as draws x rows) in pieces that stay in the cache."""
    own = key_hash(keys)
    for a in range(0, len(keys), ROWS):
        for b in range(0, len(salt), BLOCK):
            yield slice(a, a + ROWS), slice(b, b + BLOCK), mixed(own[None, a : a + ROWS] ^ salt[b : b + BLOCK, None])


def exact_subset_sums(df: DataFrame, key: Column, value: Column, size: int, total: int, draws: int, seed: int) -> DataFrame:
    """(draw, s): the sum of ``value`` over the ``size`` rows with the smallest hashes, of ``total`` rows, for every draw.

    First pass: a histogram around the place where each draw's threshold must lie, added
    up over the tasks.  Second pass: the sum below the threshold's cell, and the rows of
    that cell, which are ranked.  The cells have open ends, so the result is exact
    wherever the threshold lies.
    """
    rows = df.select(F.coalesce(key.cast("long"), F.lit(0)).alias("k"), value.cast("double").alias("v"))
    salt = salts(draws, seed)
    share, whole = size / total, 2.0**32
    half = whole * (SPREAD * np.sqrt(share * (1 - share) / total) + SPREAD / total)
    low = int(max(0.0, share * whole - half))
    width = int(max(1, min(-(-(min(whole, share * whole + half) - low) // BINS), (2**32 - 1 - low) // BINS)))
    edges = np.append(low + width * np.arange(BINS + 1, dtype=np.int64), 2**32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((draws, BINS + 2), np.int64)
        for batch in batches:
            for _, d, h in _tiles(batch.column(0).to_numpy(), salt):
                # Few hashes lie in the histogram; unsigned differences wrap, so one test tells.
                past = h - np.uint32(low)
                at, row = np.nonzero(past < np.uint32(width * BINS))
                cell = (past[at, row] // np.uint32(width)).astype(np.int64) + (BINS + 2) * at + 1
                inner = np.bincount(cell, minlength=len(h) * (BINS + 2)).reshape(len(h), -1)
                inner[:, 0] = (h < np.uint32(low)).sum(axis=1)
                inner[:, -1] = h.shape[1] - inner[:, :-1].sum(axis=1)
                held[d] += inner
        ends = np.arange(draws + 1, dtype=np.int32) * (BINS + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(held.reshape(-1)))], ["draw", "cells"])

    counted = rows.mapInArrow(count, "draw int, cells array<long>").groupBy("draw").agg(*[F.sum(F.col("cells")[i]).alias(f"c{i}") for i in range(BINS + 2)])
    # One row of counts a draw: the number of draws is the caller's.
    table = np.zeros((draws, BINS + 2), np.int64)
    for row in counted.collect():
        table[row["draw"]] = row[1:]
    reached = np.cumsum(table, axis=1)
    cell = (reached < size).sum(axis=1)
    below = np.where(cell > 0, np.take_along_axis(reached, np.maximum(cell - 1, 0)[:, None], axis=1)[:, 0], 0)
    starts, stops = np.where(cell > 0, edges[np.maximum(cell - 1, 0)], 0), edges[cell]
    # A cell of all hashes would need one number more: its last hash is left to the rows below.
    first, spans = starts.astype(np.uint32), np.minimum(stops - starts, 2**32 - 1).astype(np.uint32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(draws)
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for r, d, h in _tiles(keys, salt):
                sums[d] += (h < first[d, None]).astype(np.float64) @ values[r]
                at, row = np.nonzero((h - first[d, None]) < spans[d, None])
                if len(at):
                    yield pack(at + d.start, h[at, row].astype(np.int64), keys[r][row], values[r][row])
        yield pack(np.arange(draws), np.full(draws, -1), np.zeros(draws, np.int64), sums)

    def pack(draw: np.ndarray, h: np.ndarray, k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(draw.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(k.astype(np.int64)), pa.array(v)], ["draw", "h", "k", "v"])

    found = written(rows.mapInArrow(add, "draw int, h long, k long, v double"), "draws")
    need = df.sparkSession.createDataFrame([(i, int(size - b)) for i, b in enumerate(below)], "draw int, need long")
    place = F.row_number().over(Window.partitionBy("draw").orderBy("h", "k", "v"))
    inner = found.where("h >= 0").withColumn("place", place).join(need, "draw").where("place <= need")
    return found.where("h < 0").select("draw", "v").unionByName(inner.select("draw", "v")).groupBy("draw").agg(F.sum("v").alias("s"))


def permutation_test(df: DataFrame, key: Column, is_a: Column, value: Column, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """n_a, n_b, difference of means, two-sided p, and mean and deviation of the differences under relabelling.

    Every draw gives the label A to exactly n_a rows.  Rows with a NULL value or label
    are left out; without rows on both sides p and the null's moments are NULL.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(key.cast("long"), F.lit(0)).alias("k"), is_a.alias("a"), value.cast("double").alias("v")).where("v is not null and a is not null")
    seen = rows.agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.sum("v").alias("s"), F.sum(F.when(F.col("a"), F.col("v"))).alias("s_a")).first()
    n, n_a, schema = seen["n"], seen["n_a"], "n_a long, n_b long, difference double, p double, null_mean double, null_std double"
    if not 0 < n_a < n:
        return spark.createDataFrame([(n_a, n - n_a, None, None, None, None)], schema)
    observed = seen["s_a"] / n_a - (seen["s"] - seen["s_a"]) / (n - n_a)
    sums = exact_subset_sums(rows, F.col("k"), F.col("v"), n_a, n, draws, seed)
    d = F.col("s") / n_a - (F.lit(seen["s"]) - F.col("s")) / (n - n_a)
    hits = F.count_if(F.abs("d") >= abs(observed) * (1 - 1e-12))
    out = sums.select(d.alias("d")).agg(((hits + 1) / (F.count("*") + 1)).alias("p"), F.avg("d").alias("null_mean"), F.stddev_samp("d").alias("null_std"))
    return out.select(F.lit(n_a).cast("long").alias("n_a"), F.lit(n - n_a).cast("long").alias("n_b"), F.lit(float(observed)).alias("difference"), "p", "null_mean", "null_std")


def bottom_samples(df: DataFrame, key: Column, group: Column, payload: Column, value: Column, sizes: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """(grp, size, rep, payload, v): for each group, size and repeat exactly that many rows; none where the group has fewer.

    The smallest rows of two sets are among the smallest of each, so a task keeps
    ``size`` rows a draw and group, and Spark merges what the tasks kept.
    """
    rows = df.select(group.cast("string").alias("grp"), F.coalesce(key.cast("long"), F.lit(0)).alias("k"), payload.cast("string").alias("payload"), value.cast("double").alias("v")).where("v is not null and grp is not null")
    salt, wanted = salts(len(sizes) * repeats, seed), np.repeat(np.array(sizes), repeats)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            k, payload_, v = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object), batch.column(3).to_numpy()
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                own = key_hash(k[at])
                state = held.setdefault(name, [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))] * len(salt))
                for d, size in enumerate(wanted):
                    old = state[d]
                    h = np.concatenate([old[0], mixed(own ^ salt[d])])
                    pick = np.arange(len(h))
                    if len(h) > size:  # ties at the border stay in
                        pick = np.flatnonzero(h <= np.partition(h, size - 1)[size - 1])
                    fresh = pick[pick >= len(old[0])] - len(old[0])
                    kept = pick[pick < len(old[0])]
                    state[d] = (h[pick], *(np.concatenate([o[kept], x[at[fresh]]]) for o, x in zip(old[1:], (k, payload_, v))))
        for name, state in held.items():
            for d, (h, k_, p_, v_) in enumerate(state):
                columns = [pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), d, np.int32)), pa.array(h.astype(np.int64)), pa.array(k_), pa.array(p_.tolist(), pa.string()), pa.array(v_)]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "draw", "h", "k", "payload", "v"])

    kept = rows.mapInArrow(keep, "grp string, draw int, h long, k long, payload string, v double")
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.floor(F.col("draw") / repeats) + 1).cast("int"))
    whole = Window.partitionBy("grp", "draw")
    ranked = kept.withColumn("size", size).withColumn("place", F.row_number().over(whole.orderBy("h", "k", "v"))).where("place <= size")
    ranked = ranked.withColumn("got", F.count("*").over(whole)).where("got = size")
    return ranked.select("grp", "size", (F.col("draw") % repeats).alias("rep"), "payload", "v")


def size_sensitivity(df: DataFrame, key: Column, group: Column, config: Column, value: Column, sizes: Sequence[int], repeats: int = 20, seed: int = 4) -> DataFrame:
    """Per group and sample size: mean and deviation over the repeats of the best configuration's mean."""
    drawn = bottom_samples(df, key, group, config, value, sizes, repeats, seed)
    best = drawn.groupBy("grp", "size", "rep", "payload").agg(F.avg("v").alias("m")).groupBy("grp", "size", "rep").agg(F.max("m").alias("best"), F.max_by("payload", F.struct("m", "payload")).alias("config"))
    return best.groupBy("grp", "size").agg(F.count("*").alias("repeats"), F.avg("best").alias("mean_best"), F.stddev_pop("best").alias("std_best"), F.count_distinct("config").alias("best_configs"))

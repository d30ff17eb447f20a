"""Seeded resampling without copying rows per replicate.

Every draw is a hash of (row key, replicate, seed), so results do not depend on
partitioning or on retries.  A task folds its rows into one partial sum per
replicate and group; only those few sums are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.common import attach, ratio
from corpusgauge.operators.draws import draw_column, key_hash, mixed, salts
from corpusgauge.operators.sequences import adjacent_similarity, dot
from corpusgauge.plans.ordered import ordered, quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 32


def uniforms(keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Matrix rows x replicates of numbers in [0, 1), multiples of 2**-32, from key hashes and the replicates' salts."""
    return mixed(keys[:, None] ^ salt[None, :]) * 2.0**-32


def _poisson_steps() -> np.ndarray:
    return np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 18.0)])))


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts by inverse distribution function.

    A table over 65,536 equal cells gives the count; the few cells that a step
    cuts through are looked up exactly.
    """
    steps, cells = _poisson_steps(), 65536
    low = np.searchsorted(steps, np.arange(cells) / cells, side="right")
    high = np.searchsorted(steps, (np.arange(cells) + 1) / cells, side="left")
    cell = (u * cells).astype(np.int32)
    out = low.astype(np.float64)[cell]
    unsure = (low != high)[cell]
    if unsure.any():
        out[unsure] = np.searchsorted(steps, u[unsure], side="right")
    return out


def replicate_sums(df: DataFrame, key: Column, group: Column, value: Column, reps: int, seed: int, kind: str, share: float = 1.0, noise: float = 0.0) -> DataFrame:
    """(rep, grp, w, ws): weight and weighted value sums per replicate and group.

    kind "bootstrap": Poisson(1) weights.  kind "subset": weight 1 with
    probability ``share``.  ``noise`` adds N(0, noise) to every drawn value.
    The key is a long; rows with equal keys are drawn alike.
    """
    salt = [salts(reps, seed + step) for step in (0, 7919, 104729)]
    rows = df.select(F.coalesce(key.cast("long"), F.lit(0)).alias("k"), group.cast("string").alias("grp"), value.cast("double").alias("v")).where("v is not null")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            keys, values = key_hash(pdf["k"].to_numpy()), pdf["v"].to_numpy()
            codes, names = pd.factorize(pdf["grp"])
            member = (codes[None, :] == np.arange(len(names))[:, None]).astype(np.float64)
            sums = np.zeros((2, len(names), reps))
            for start in range(0, reps, BLOCK):
                ids = np.arange(start, min(start + BLOCK, reps))
                u = uniforms(keys, salt[0][ids])
                w = poisson_weights(u) if kind == "bootstrap" else (u < share).astype(np.float64)
                sums[0][:, ids] = member @ w
                if noise:
                    a, b = uniforms(keys, salt[1][ids]), uniforms(keys, salt[2][ids])
                    drawn = values[:, None] + noise * np.sqrt(-2.0 * np.log1p(-a)) * np.cos(2.0 * np.pi * b)
                    sums[1][:, ids] = member @ (w * drawn)
                else:
                    sums[1][:, ids] = (member * values) @ w
            for code, name in enumerate(names):
                totals[name] = totals.get(name, 0.0) + sums[:, code]
        for name, held in totals.items():
            yield pd.DataFrame({"rep": np.arange(reps), "grp": name, "w": held[0], "ws": held[1]})

    parts = rows.mapInPandas(fold, "rep int, grp string, w double, ws double")
    return parts.groupBy("rep", "grp").agg(F.sum("w").alias("w"), F.sum("ws").alias("ws"))


def bootstrap_means(df: DataFrame, key: Column, group: Column, value: Column, reps: int = 1000, seed: int = 2) -> DataFrame:
    """Percentile interval (95%) of each group's mean."""
    sums = replicate_sums(df, key, group, value, reps, seed, "bootstrap").where("w > 0")
    means = sums.select("grp", (F.col("ws") / F.col("w")).alias("m"))
    real = df.groupBy(group.cast("string").alias("grp")).agg(F.avg(value).alias("mean"), F.count(value).alias("rows"))
    return quantiles(means, ["grp"], "m", {"low": 0.025, "high": 0.975}).join(real, "grp").select("grp", "rows", "mean", "low", "high")


def bootstrap_difference(df: DataFrame, key: Column, is_a: Column, value: Column, reps: int = 1000, seed: int = 3) -> DataFrame:
    sums = replicate_sums(df, key, F.when(is_a, "a").otherwise("b"), value, reps, seed, "bootstrap")
    mean = lambda g: F.sum(F.when(F.col("grp") == g, F.col("ws"))) / F.sum(F.when(F.col("grp") == g, F.col("w")))
    draws = sums.groupBy("rep").agg((mean("a") - mean("b")).alias("d"))
    real = df.agg((F.avg(F.when(is_a, value)) - F.avg(F.when(~is_a, value))).alias("difference"))
    return attach(quantiles(draws, [], "d", {"low": 0.025, "high": 0.975}), real, "r").select("r.difference", "low", "high")


def best_share(sums: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """How often each group has the highest mean over the replicates."""
    means = sums.where("w > 0").withColumn("m", F.col("ws") / F.col("w"))
    best = means.groupBy(*extra, "rep").agg(F.max_by("grp", F.struct("m", "grp")).alias("grp"), F.max("m").alias("best_mean"))
    per = best.groupBy(*extra, "grp").agg(F.count("*").alias("wins"), F.avg("best_mean").alias("mean"), F.coalesce(F.stddev_samp("best_mean"), F.lit(0.0)).alias("std"))
    total = best.groupBy(*extra).agg(F.count("*").alias("reps")) if extra else None
    if total is None:
        return attach(per, best.agg(F.count("*").alias("reps")), "t").withColumn("share", F.col("wins") / F.col("t.reps")).drop("t")
    return per.join(total, list(extra)).withColumn("share", F.col("wins") / F.col("reps")).drop("reps")


def noise_sensitivity(df: DataFrame, key: Column, group: Column, value: Column, spreads: Sequence[float], reps: int = 20, seed: int = 5) -> DataFrame:
    """Best group and its mean when N(0, s) is added to every value."""
    levels = [replicate_sums(df, key, group, value, reps, seed + i, "subset", 1.0, s).withColumn("level", F.lit(s)) for i, s in enumerate(spreads)]
    stacked = levels[0]
    for part in levels[1:]:
        stacked = stacked.unionByName(part)
    return best_share(stacked, ["level"])


def shuffle_baseline(df: DataFrame, key: str, order: str, vector: str, reps: int = 50, seed: int = 6) -> DataFrame:
    """Continuity of the real order against shuffled orders of the same rows."""
    real = adjacent_similarity(df, [key], order, vector).groupBy(key).agg(F.avg("similarity").alias("original"))
    length = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = F.transform(vector, lambda x: x.cast("double"))
    flat = df.select(key, order, unit.alias("x"), length.alias("len"))
    copies = flat.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = copies.withColumn("draw", draw_column(F.col(order), F.col("rep"), reps, seed))
    walked = ordered(drawn, [key, "rep"], "draw", [order], prev=["x", "len"]).where(F.col("prev").isNotNull())
    sim = F.coalesce(F.try_divide(dot(F.col("x"), F.col("prev.x")), F.col("len") * F.col("prev.len")), F.lit(0.0))
    draws = walked.groupBy(key, "rep").agg(F.avg(sim).alias("s")).join(real, key)
    out = draws.groupBy(key, "original").agg(
        F.avg("s").alias("random_mean"), F.stddev_pop("s").alias("random_std"), F.avg((F.col("s") >= F.col("original")).cast("double")).alias("p_value"), F.count("*").alias("reps")
    )
    gap = F.col("original") - F.col("random_mean")
    return out.withColumns({"effect_size": ratio(gap, F.nullif("random_std", F.lit(0.0))), "improvement_pct": 100 * ratio(gap, F.col("random_mean"))})

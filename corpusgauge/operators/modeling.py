"""Linear models, reliability and composites from aggregated moments.

Spark reduces the rows to moments per cell, group or column; only those few
numbers reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.common import corr, ratio
from corpusgauge.functions.tails import f_tail
from corpusgauge.operators.regression import MOST_COLUMNS, factor_levels, rest_of, triangle
from corpusgauge.session import written


def two_predictor_ols(y: str, x1: str, x2: str) -> dict[str, Column]:
    """Coefficients and R squared of y on two predictors as aggregates."""
    s11, s22, s12 = F.var_pop(x1), F.var_pop(x2), F.covar_pop(x1, x2)
    s1y, s2y = F.covar_pop(x1, y), F.covar_pop(x2, y)
    det = s11 * s22 - s12 * s12
    b1, b2 = (s22 * s1y - s12 * s2y) / det, (s11 * s2y - s12 * s1y) / det
    return {
        "b1": b1, "b2": b2, "b0": F.avg(y) - b1 * F.avg(x1) - b2 * F.avg(x2),
        "r2": (b1 * s1y + b2 * s2y) / F.var_pop(y),
    }


def partial_correlation(x: str, y: str, first: str, second: str) -> Column:
    """Correlation of x and y with two controls taken out, by recursion."""

    def one(a: str, b: str, c: str) -> Column:
        ab, ac, bc = corr(a, b), corr(a, c), corr(b, c)
        return (ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc))

    xy, xs, ys = one(x, y, first), one(x, second, first), one(y, second, first)
    return (xy - xs * ys) / F.sqrt((1 - xs * xs) * (1 - ys * ys))


def factorial_anova(df: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """Type II sums of squares of all main effects and interactions.

    Rows reduce to one (n, sum, sum of squares) row per cell, which stays in Spark: the
    weighted columns of all effects fold into one triangle, and every model's fit is read
    off its columns.  Rows with a NULL level or value are left out, empty cells cost
    their degrees of freedom, no rows give none.
    """
    rows = df.dropna(subset=[*factors, value]).select(*[F.col(f).cast("string").alias(f) for f in factors], F.col(value).cast("double").alias("v"))
    cells = written(rows.groupBy(*factors).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")), "cells")
    sums = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within")).first()
    effects = [e for size in range(1, len(factors) + 1) for e in itertools.combinations(factors, size)]
    schema = "effect string, ss double, df int, f double, p double, eta_squared double, p_bonferroni double, stars string, band string"
    if not sums["n"]:
        return df.sparkSession.createDataFrame([], schema)
    levels = factor_levels(cells, factors)
    owners = [(), *(e for e in effects for _ in range(math.prod(len(levels[f]) - 1 for f in e)))]
    if len(owners) > MOST_COLUMNS:
        raise ValueError(f"the model has {len(owners)} columns; {MOST_COLUMNS} are allowed")
    names = [*factors, "n", "s"]

    def coded(batch: pa.RecordBatch) -> np.ndarray:
        """The cells' columns of all effects and their means, weighted by the root of their rows."""
        n, s = (batch.column(i).to_numpy() for i in (len(factors), len(factors) + 1))
        dummies = {f: (np.array(batch.column(i).to_pylist(), object)[:, None] == np.array(levels[f][1:], object)[None, :]).astype(float) for i, f in enumerate(factors)}
        blocks = [np.ones((len(batch), 1))]
        for e in effects:
            block = blocks[0]
            for f in e:
                block = (block[:, :, None] * dummies[f][:, None, :]).reshape(len(batch), -1)
            blocks.append(block)
        return np.hstack([*blocks, (s / n)[:, None]]) * np.sqrt(n)[:, None]

    whole = triangle(cells.select(*names), len(owners) + 1, coded)

    def residual(chosen: Sequence[tuple[str, ...]]) -> tuple[float, int]:
        return rest_of(whole, [i for i, e in enumerate(owners) if not e or e in chosen])

    within, total = float(sums["within"]), float(sums["q"] - sums["s"] ** 2 / sums["n"])
    full_sse, full_rank = residual(effects)
    df_error = sums["n"] - full_rank
    error_ms = (within + full_sse) / df_error if df_error else float("nan")
    rows = []
    for e in effects:
        others = [o for o in effects if not set(e) <= set(o)]
        low, low_rank = residual(others)
        high, high_rank = residual([*others, e])
        ss, dof = low - high, high_rank - low_rank
        f = ss / dof / error_ms if dof and error_ms > 0 else float("nan")
        p = f_tail(f, dof, df_error) if f == f else float("nan")
        adjusted = min(1.0, p * len(effects))
        stars = "***" if adjusted < 0.001 else "**" if adjusted < 0.01 else "*" if adjusted < 0.05 else "." if adjusted < 0.1 else ""
        eta = ss / total if total > 0 else float("nan")
        band = "negligible" if eta < 0.01 else "small" if eta < 0.06 else "medium" if eta < 0.14 else "large"
        rows.append((":".join(e), float(ss), dof, float(f), float(p), float(eta), float(adjusted), stars, band))
    return df.sparkSession.createDataFrame(rows, schema)


def cronbach_alpha(wide: DataFrame, items: Sequence[str]) -> DataFrame:
    """Alpha over complete rows: k/(k-1) * (1 - sum of item variances / total variance)."""
    full = wide.dropna(subset=list(items))
    total = sum((F.col(i) for i in items), F.lit(0.0))
    k = len(items)
    parts = sum((F.var_samp(i) for i in items), F.lit(0.0))
    return full.agg(F.count("*").alias("rows"), ratio(F.lit(k) * (1 - parts / F.var_samp(total)), F.lit(k - 1)).alias("alpha"))


def icc_2k(cells: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """Two-way random, average-rater ICC from complete target x rater cells."""
    x = F.col(value)
    by_t = cells.groupBy(target).agg(F.sum(x).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col("s") ** 2).alias("tt"))
    by_r = cells.groupBy(rater).agg(F.sum(x).alias("s")).agg(F.count("*").alias("k"), F.sum(F.col("s") ** 2).alias("rr"))
    whole = cells.agg(F.sum(x).alias("g"), F.sum(x * x).alias("q"))
    one = whole.select("*", by_t.select(F.struct("n", "tt")).scalar().alias("t"), by_r.select(F.struct("k", "rr")).scalar().alias("r"))
    n, k = F.col("t.n").cast("double"), F.col("r.k").cast("double")
    base = F.col("g") ** 2 / (n * k)
    rows, cols = F.col("t.tt") / k - base, F.col("r.rr") / n - base
    error = F.col("q") - base - rows - cols
    ms = one.select(n.alias("n"), k.alias("k"), (rows / (n - 1)).alias("msr"), (cols / (k - 1)).alias("msc"), (error / ((n - 1) * (k - 1))).alias("mse"))
    icc = ratio(F.col("msr") - F.col("mse"), F.col("msr") + (F.col("msc") - F.col("mse")) / F.col("n"))
    band = F.when(F.col("icc") >= 0.75, "excellent").when(F.col("icc") >= 0.6, "good").when(F.col("icc") >= 0.4, "fair").otherwise("poor")
    return ms.withColumn("icc", icc).withColumn("band", band)


def random_intercept(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between and within variance of a random-intercept model by moments."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    n, m = F.col("n").cast("double"), F.col("m")
    s = g.agg(F.count("*").alias("k"), F.sum(n).alias("t"), F.sum(n * n).alias("nn"), F.sum(n * m).alias("nm"), F.sum(n * m * m).alias("nmm"), F.sum((n - 1) * F.col("v")).alias("w"))
    k, t = F.col("k"), F.col("t")
    msb = (F.col("nmm") - F.col("nm") ** 2 / t) / (k - 1)
    msw = F.col("w") / (t - k)
    n0 = (t - F.col("nn") / t) / (k - 1)
    between = F.greatest(F.lit(0.0), (msb - msw) / n0)
    return s.select(k.alias("groups"), (F.col("nm") / t).alias("mean"), between.alias("between"), msw.alias("within"), ratio(between, between + msw).alias("share"))


def pca_loadings(df: DataFrame, columns: Sequence[str], floor: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Loadings of the components that reach ``floor`` of the variance, and rows
    with their composite (components weighted by explained share, 0..1).

    Signs are fixed: the largest loading of a component is positive.
    """
    spark = df.sparkSession
    assembled = VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(df)
    scaler = StandardScaler(inputCol="__raw", outputCol="__std", withMean=True).fit(assembled)
    scaled = scaler.transform(assembled)
    model = PCA(k=len(columns), inputCol="__std", outputCol="__pc").fit(scaled)
    loads, shares = model.pc.toArray(), model.explainedVariance.toArray()
    signs = [1.0 if loads[np.argmax(np.abs(loads[:, j])), j] >= 0 else -1.0 for j in range(len(columns))]
    keep = int(np.searchsorted(np.cumsum(shares), floor) + 1)
    rows = [(j + 1, c, float(loads[i, j] * signs[j]), float(shares[j])) for j in range(keep) for i, c in enumerate(columns)]
    table = spark.createDataFrame(rows, "component int, metric string, loading double, explained double")
    parts = vector_to_array("__pc")
    weights = shares[:keep] / shares[:keep].sum()
    composite = sum((F.lit(float(w * signs[j])) * parts[j] for j, w in enumerate(weights)), F.lit(0.0))
    return table, model.transform(scaled).select(*df.columns, composite.alias("pca_score"))


def curve_fits(df: DataFrame, keys: Sequence[str], size: str, time: str) -> DataFrame:
    """SSE of linear, n log n and quadratic least squares per key, and the best."""
    n, y = F.col(size).cast("double"), F.col(time)
    rows = df.select(*keys, n.alias("n"), (n * F.log(n)).alias("nl"), (n * n).alias("nn"), y.alias("y"))
    syy = F.regr_syy("y", "n")
    rest = lambda x: syy - F.regr_sxy("y", x) ** 2 / F.regr_sxx("y", x)
    fit = two_predictor_ols("y", "n", "nn")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("points"), rest("n").alias("linear"), rest("nl").alias("n_log_n"), (syy * (1 - fit["r2"])).alias("quadratic")
    )
    best = F.when(F.col("linear") <= F.col("n_log_n"), "linear").otherwise("n log n")
    return out.withColumn("best_one_term", best)

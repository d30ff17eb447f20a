"""Linear models with factors and interactions: tall-skinny QR, robust errors, a random intercept.

A model's columns (k of them, with the levels of its factors) are few; its rows are
not.  Tasks reduce their rows to triangles or sums of k or k x k numbers, and only those
are moved.  ``MOST_COLUMNS`` bounds k.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_COLUMNS = 400
#: A column is redundant if less than this share of its length is left beside the columns before it.
REDUNDANT = 1e-8
#: Tasks that merge the triangles of all others; each leaves one.
MERGERS = 8
INTERCEPT = "intercept"


@dataclass(frozen=True)
class Design:
    """Named model columns over the complete rows of a table."""

    rows: DataFrame
    names: tuple[str, ...]
    columns: tuple[Column, ...]


def design(df: DataFrame, terms: Sequence[str | Sequence[str]], needed: Sequence[str], intercept: bool = True) -> Design:
    """Columns of a model: a term is a column, or a list of columns for their interaction.

    String and boolean columns are factors, coded against their first level in sorted
    order; all others are numbers.  Rows with a NULL in a used or needed column are left
    out.  The levels of the factors come to the driver: they are columns of the model.
    """
    listed = [(t,) if isinstance(t, str) else tuple(t) for t in terms]
    used = list(dict.fromkeys(c for t in listed for c in t))
    rows = df.dropna(subset=[*used, *needed])
    kinds = dict(df.dtypes)
    factors = [c for c in used if kinds[c] in ("string", "boolean")]
    levels = {c: [v == "true" for v in found] if kinds[c] == "boolean" else found for c, found in factor_levels(rows, factors).items()}

    def coded(c: str) -> list[tuple[str, Column]]:
        if c not in levels:
            return [(c, F.col(c).cast("double"))]
        return [(f"{c}[{v}]", (F.col(c) == F.lit(v)).cast("double")) for v in levels[c][1:]]

    names, columns = ([INTERCEPT], [F.lit(1.0)]) if intercept else ([], [])
    for term in listed:
        made = [("", F.lit(1.0))]
        for c in term:
            made = [(f"{a}:{b}".strip(":"), x * y) for a, x in made for b, y in coded(c)]
        names += [n for n, _ in made]
        columns += [x for _, x in made]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"the model has {len(names)} columns; {MOST_COLUMNS} are allowed")
    return Design(rows, tuple(names), tuple(columns))


def factor_levels(rows: DataFrame, factors: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of each factor as text, in one job; ``MOST_COLUMNS`` bounds what comes back."""
    levels: dict[str, list[str]] = {c: [] for c in factors}
    if factors:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in factors]))
        for row in rows.select(each.alias("e")).select("e.*").distinct().limit(MOST_COLUMNS * len(factors) + 1).collect():
            levels[row.c].append(row.v)
    return {c: sorted(found) for c, found in levels.items()}


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def triangle(frame: DataFrame, width: int, coded: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """R of the QR decomposition of all rows, which ``coded`` turns into ``width`` numbers each.

    Every task folds its rows into one triangle, batch by batch; ``MERGERS`` tasks stack
    and fold the triangles as they come, and the driver their few.  Nothing is squared,
    so no digits are lost as in X'X.
    """

    def fold(read: Callable[[pa.RecordBatch], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((0, width))
            for batch in batches:
                held = np.linalg.qr(np.vstack([held, read(batch)]), mode="r")
            if len(held):
                ends = np.arange(len(held) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(held.reshape(-1)))], ["r"])

        return run

    parts = frame.mapInArrow(fold(coded), "r array<double>")
    merged = parts.repartition(MERGERS).mapInArrow(fold(lambda batch: _matrix(batch, 0, width)), "r array<double>")
    held = np.array([row.r for row in merged.collect()]).reshape(-1, width)
    return np.linalg.qr(np.vstack([held, np.zeros((width, width))]), mode="r")


def independent(r: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Columns of a triangle that are no combination of the columns before them, and an orthonormal basis of their space."""
    kept: list[int] = []
    basis = np.zeros((len(r), 0))
    for j in range(r.shape[1]):
        length, rest = np.linalg.norm(r[:, j]), r[:, j]
        for _ in range(2):  # the second time takes off what rounding left
            rest = rest - basis @ (basis.T @ rest)
        left = np.linalg.norm(rest)
        if length > 0 and left > REDUNDANT * length:
            kept.append(j)
            basis = np.column_stack([basis, rest / left])
    return kept, basis


def rest_of(r: np.ndarray, columns: Sequence[int]) -> tuple[float, int]:
    """Residual sum of squares of the last column on the listed ones, and their rank, from the triangle alone."""
    kept, basis = independent(r[:, list(columns)])
    rest = r[:, -1]
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    return float(rest @ rest), len(kept)


def robust_ols(model: Design, y: str, cluster: str | None = None) -> DataFrame:
    """term, coef, se, se_hc3 (and se_cluster) of an ordinary least squares fit.

    Redundant columns have NULLs; rows with leverage 1 count with weight 0 in HC3.  With
    no more rows than columns there are no errors, and the errors are NULL.
    """
    k, names = len(model.names), list(model.names)
    owner = [F.col(cluster).cast("string").alias("cluster")] if cluster else []
    frame = model.rows.select(F.array(*model.columns, F.col(y).cast("double")).alias("x"), *owner)
    whole = triangle(frame.select("x"), k + 1, lambda batch: _matrix(batch, 0, k + 1))
    kept, _ = independent(whole[:, :k])
    m = len(kept)
    small = np.linalg.qr(whole[:, [*kept, k]], mode="r")
    inner, right = small[:m, :m], small[:m, m]
    beta = np.linalg.solve(inner, right) if m else np.zeros(0)
    back = np.linalg.solve(inner, np.eye(m)) if m else np.zeros((0, 0))
    inverse, sse = back @ back.T, float(small[m, m] ** 2) if len(small) > m else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of x * e by cluster, and one row a task with the sum of x x' u^2."""
        meat, n = np.zeros((m, m)), 0
        for batch in batches:
            data = _matrix(batch, 0, k + 1)
            x = data[:, kept]
            rest = data[:, k] - x @ beta
            free = 1 - ((x @ back) ** 2).sum(axis=1)
            u = np.where(free > 1e-12, rest / np.where(free > 1e-12, free, 1.0), 0.0)
            weighted = x * u[:, None]
            meat, n = meat + weighted.T @ weighted, n + len(x)
            if cluster and len(x):
                groups, code = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
                sums = np.zeros((len(groups), m))
                np.add.at(sums, code, x * rest[:, None])
                yield pack(groups.tolist(), sums, [0] * len(groups))
        yield pack([None], meat.reshape(1, -1), [n])

    def pack(groups: list, values: np.ndarray, n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(values.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], ["cluster", "v", "n"])

    scored = written(frame.mapInArrow(score, "cluster string, v array<double>, n long"), "scored")
    n = scored.agg(F.sum("n")).first()[0] or 0
    sums = scored.where("cluster is null").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    meat = np.zeros(m * m)
    for row in sums.collect():
        meat[row.i] = row.v
    hc3 = np.sqrt(np.diag(inverse @ meat.reshape(m, m) @ inverse))
    table = {"coef": beta, "se": np.sqrt(np.diag(inverse) * sse / (n - m)) if n > m else None, "se_hc3": hc3 if n > m else None}
    if cluster:
        per = scored.where("cluster is not null").groupBy("cluster").agg(*[F.sum(F.col("v")[i]).alias(f"u{i}") for i in range(m)])
        cells = [(i, j) for i in range(m) for j in range(i, m)]
        got = per.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in cells]).first()
        among, g = np.zeros((m, m)), got["g"]
        for i, j in cells:
            among[i, j] = among[j, i] = got[f"m{i}_{j}"] or 0.0
        adjust = g / (g - 1) * (n - 1) / (n - m) if g > 1 and n > m else None
        table["se_cluster"] = None if adjust is None else np.sqrt(np.diag(inverse @ among @ inverse) * adjust)
    at = {j: i for i, j in enumerate(kept)}
    data = [tuple([names[j]] + [None if v is None or j not in at else float(v[at[j]]) for v in table.values()]) for j in range(k)]
    return model.rows.sparkSession.createDataFrame(data, "term string, " + ", ".join(f"{n} double" for n in table))


# ---------------------------------------------------------------- random intercept


#: Pieces that a pass cuts the bracket of the ratio into, and passes at most.
CUTS, ROUNDS = 64, 12


def mixed_model(model: Design, y: str, group: str) -> DataFrame:
    """y on the model's columns with a random intercept per ``group``, fitted by REML: (term, estimate, se, z).

    With ratio t of the between to the within variance, the inverse covariance of a group
    of n rows is (I - t / (1 + t n) J) up to scale, so a group needs its column sums only,
    and groups of one size are added up.  The slope of the restricted likelihood in t is
    one aggregate over that table of sizes; a bracket around its zero is cut into
    ``CUTS`` pieces a pass.  Besides the columns the rows 'between', 'within' (variances)
    and 'loglik' are returned.  The ratio is 0 if the slope says so.

    The model needs an intercept.  Rows with a NULL group are left out; redundant columns
    have NULLs; no rows, or no more rows than columns, give no rows.
    """
    spark, k = model.rows.sparkSession, len(model.names)
    if model.names[:1] != (INTERCEPT,):
        raise ValueError("a model with a random intercept needs a fixed one")
    schema = "term string, estimate double, se double, z double"
    rows = model.rows.where(F.col(group).isNotNull())
    center = rows.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if center is None:
        return spark.createDataFrame([], schema)
    names = [f"c{i}" for i in range(k + 1)]
    rows = rows.select(F.col(group).alias("g"), *[c.alias(n) for c, n in zip(model.columns, names)], (F.col(y).cast("double") - F.lit(center)).alias(names[k]))
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    # One row per group, then one per size of groups.
    groups = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in names])
    sums = F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in cells])
    sizes = written(groups.groupBy("n").agg(F.count("*").cast("double").alias("groups"), sums.alias("s")), "sizes")
    whole = _square(rows.agg(sums.alias("s")).first().s, cells)
    total = whole[0, 0]
    kept = _independent_columns(whole[:k, :k])
    p, grid = len(kept), np.ix_(kept, kept)
    if total <= p:
        return spark.createDataFrame([], schema)

    def parts(ratios: Sequence[float]) -> list[tuple]:
        """Per ratio t: X'VX, X'Vy, y'Vy, their slopes in t, and the sum of log(1 + t n) with its slope."""

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(ratios), 2 * len(cells) + 2))
            for batch in batches:
                n, many, s = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch, 2, len(cells))
                for a, t in enumerate(ratios):
                    out[a, : len(cells)] += (t / (1 + t * n)) @ s
                    out[a, len(cells) : -2] += (1 / (1 + t * n) ** 2) @ s
                    out[a, -2:] += many @ np.log1p(t * n), many @ (n / (1 + t * n))
            at, value = np.arange(out.size, dtype=np.int32), out.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value)], ["at", "value"])

        found = sizes.select("n", "groups", "s").mapInArrow(fold, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(len(ratios) * (2 * len(cells) + 2))
        for row in found:
            flat[row["at"]] = row.value
        out = []
        for line in flat.reshape(len(ratios), -1):
            left, moved = whole - _square(line[: len(cells)], cells), -_square(line[len(cells) : -2], cells)
            out.append((left[grid], left[kept, k], left[k, k], moved[grid], moved[kept, k], moved[k, k], line[-2], line[-1]))
        return out

    def slopes(ratios: Sequence[float]) -> list[float]:
        out = []
        for h, r, q, dh, dr, dq, _, dlogs in parts(ratios):
            inverse = np.linalg.inv(h)
            b = inverse @ r
            out.append(float((total - p) * (dq - 2 * b @ dr + b @ dh @ b) / (q - b @ r) + dlogs + np.trace(inverse @ dh)))
        return out

    ratio = rising_zero(slopes)
    h, r, q, *_, logs, _ = parts([ratio])[0]
    inverse = np.linalg.inv(h)
    b = inverse @ r
    within = float(q - b @ r) / (total - p)
    loglik = -0.5 * ((total - p) * (np.log(2 * np.pi * within) + 1) + logs + np.linalg.slogdet(h)[1])
    errors = np.sqrt(np.diag(inverse) * within)
    b[0] += center
    at = {j: i for i, j in enumerate(kept)}
    data = [(n, float(b[at[j]]), float(errors[at[j]]), float(b[at[j]] / errors[at[j]])) if j in at else (n, None, None, None) for j, n in enumerate(model.names)]
    data += [(n, float(v), None, None) for n, v in (("between", ratio * within), ("within", within), ("loglik", loglik))]
    return spark.createDataFrame(data, schema)


def _square(values: Sequence[float], cells: Sequence[tuple[int, int]]) -> np.ndarray:
    size = cells[-1][1] + 1
    out = np.zeros((size, size))
    for (i, j), v in zip(cells, values):
        out[i, j] = out[j, i] = v
    return out


def _independent_columns(products: np.ndarray) -> list[int]:
    """Columns of X that are no combination of those before them, from X'X."""
    kept: list[int] = []
    for j in range(len(products)):
        rest = products[j, j]
        if kept:
            own = products[kept, j]
            rest -= own @ np.linalg.solve(products[np.ix_(kept, kept)], own)
        if products[j, j] > 0 and rest > 1e-10 * products[j, j]:
            kept.append(j)
    return kept


def rising_zero(slopes: Callable[[Sequence[float]], list[float]]) -> float:
    """Zero on [0, inf) of a function that starts below 0 and rises through it; 0 if it does not start below."""
    low, high = 0.0, 1.0
    first, last = slopes([low, high])
    if not first < 0:
        return 0.0
    while last < 0 and high < 2.0**100:
        low, high = high, 16 * high
        last = slopes([high])[0]
    for _ in range(ROUNDS):
        inner = [low + (high - low) * i / CUTS for i in range(1, CUTS)]
        below = [s < 0 for s in slopes(inner)]
        n = below.index(False) if False in below else len(below)
        edges = [low, *inner, high]
        low, high = edges[n], edges[n + 1]
        if high - low <= 1e-11 * high:
            break
    return (low + high) / 2

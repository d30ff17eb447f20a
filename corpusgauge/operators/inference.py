"""Tests and effect sizes from grouped sufficient statistics.

Rows are reduced by Spark to counts, sums and rank sums; the closed forms run
on the few result rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.common import corr, ratio
from corpusgauge.plans.ordered import ordered, quantiles, value_counts
from corpusgauge.session import written


def two_arms(df: DataFrame, keys: Sequence[str], is_a: Column, is_b: Column, value: str) -> DataFrame:
    """n, mean and sample variance of both arms in one pass."""
    a, b = F.when(is_a, F.col(value)), F.when(is_b, F.col(value))
    return df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"),
    )


def t_statistics() -> dict[str, Column]:
    """Pooled and Welch t with degrees of freedom from n1..v2."""
    n1, m1, v1, n2, m2, v2 = (F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    se = v1 / n1 + v2 / n2
    return {
        "t_pooled": F.try_divide(m1 - m2, F.sqrt(pooled * (1 / n1 + 1 / n2))),
        "df_pooled": (n1 + n2 - 2).cast("double"),
        "t_welch": F.try_divide(m1 - m2, F.sqrt(se)),
        "df_welch": F.try_divide(se * se, (v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)),
    }


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, mean: Column) -> DataFrame:
    """n, df and t of each group against a fixed mean (an aggregate over the group); the
    form that is left where the other sample is one value.  t is NULL without spread."""
    n, sd = F.count(value), F.stddev_samp(value)
    t = F.try_divide(F.avg(value) - mean, F.nullif(sd, F.lit(0.0)) / F.sqrt(n))
    return df.groupBy(*keys).agg(n.alias("n"), (n - 1).alias("df"), t.alias("t"))


def cohens_d(form: str = "pooled") -> Column:
    """Mean difference over the pooled (n-1) or the mean-variance deviation."""
    n1, m1, v1, n2, m2, v2 = (F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2"))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.try_divide(m1 - m2, pooled if form == "pooled" else F.sqrt((v1 + v2) / 2))


def effect_band(value: Column, limits: Sequence[float]) -> Column:
    size = F.abs(value)
    a, b, c = limits
    return F.when(size < a, "negligible").when(size < b, "small").when(size < c, "medium").otherwise("large")


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, arms: Mapping[str, Column]) -> DataFrame:
    """Rank sum and size per arm plus the tie term, per key, without ranking rows.

    All rows of one value share one average rank, so counts per value suffice.
    """
    flags = {n: F.when(c, 1).otherwise(0) for n, c in arms.items()}
    member = F.lit(False)
    for c in arms.values():
        member = member | c
    counts = value_counts(df.where(member), keys, value, {f"c_{n}": c for n, c in flags.items()})
    walked = ordered(counts, keys, value, running={"c": "c"})
    rank = F.col("before_c") + (F.col("c") + 1) / 2
    ties = F.col("c").cast("double")
    return walked.groupBy(*keys).agg(
        F.max("total_c").alias("n"), F.sum(ties * ties * ties - ties).alias("tie_term"),
        *[F.sum(F.col(f"c_{n}") * rank).alias(f"r_{n}") for n in arms], *[F.sum(f"c_{n}").alias(f"n_{n}") for n in arms],
    )


def mann_whitney(sums: DataFrame) -> DataFrame:
    """U of arm a, tie-corrected z with continuity correction, Cliff's delta."""
    na, nb, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "n"))
    u = F.col("r_a") - na * (na + 1) / 2
    spread = F.sqrt(na * nb / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    shift = F.abs(u - na * nb / 2) - 0.5
    return sums.withColumns({"u": u, "z": ratio(F.greatest(shift, F.lit(0.0)), spread), "cliff": 2 * u / (na * nb) - 1})


def group_moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def one_way_anova(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F, degrees of freedom and eta squared from per-group n, m, v rows."""
    n, m = F.col("n"), F.col("m")
    sums = cells.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(n * m).alias("nm"), F.sum(n * m * m).alias("nmm"),
        F.sum((n - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
    )
    between = F.col("nmm") - F.col("nm") ** 2 / F.col("total")
    out = sums.withColumn("between", between)
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    return out.withColumns(
        {
            "f": F.try_divide(F.col("between") / df1, F.col("within") / df2), "df1": df1, "df2": df2,
            "eta_squared": F.try_divide(F.col("between"), F.col("between") + F.col("within")),
        }
    ).select(*keys, "f", "df1", "df2", "between", "within", "eta_squared")


def kruskal_wallis(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """H with tie correction.

    Counts per (group, value) meet the rank of their value; rows do not.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count("*").alias("c"))
    totals = per.groupBy(*keys, value).agg(F.sum("c").alias("all"))
    walked = ordered(totals, keys, value, running={"c": "all"})
    ranks = walked.select(*keys, value, "all", (F.col("before_c") + (F.col("all") + 1) / 2).alias("r"), F.col("total_c").alias("n"))
    a = F.col("all").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(a * a * a - a).alias("tie_term"), F.max("n").alias("n"))
    sums = per.join(ranks.select(*keys, value, "r"), [*keys, value]).groupBy(*keys, group).agg(F.sum(F.col("c") * F.col("r")).alias("rs"), F.sum("c").alias("ng"))
    part = sums.groupBy(*keys).agg(F.sum(F.col("rs") ** 2 / F.col("ng")).alias("q"), F.count("*").alias("k"))
    both = part.join(ties, list(keys)) if keys else part.withColumn("__j", F.lit(1)).join(ties.withColumn("__j", F.lit(1)), "__j").drop("__j")
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return both.withColumns({"h": ratio(raw, 1 - F.col("tie_term") / (n * n * n - n)), "df": F.col("k") - 1}).select(*keys, "h", "df", "n")


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Median-centred Levene: ANOVA on distances from the group median."""
    medians = written(quantiles(df, [*keys, group], value, {"med": 0.5}).drop("n"), "medians")
    dist = df.join(medians, [*keys, group]).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    return one_way_anova(group_moments(dist, keys, group, "dev"), keys)


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Every cell of the table with its count and its count under independence.

    Margins are far fewer than rows; the empty cells come from the two label lists.
    """
    cells = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    row_sum = cells.groupBy(rows).agg(F.sum("n").alias("__r"), F.map_from_entries(F.collect_list(F.struct(columns, "n"))).alias("__m"))
    labels = cells.groupBy(columns).agg(F.sum("n").alias("__k"))
    listed = labels.agg(F.collect_list(F.struct(columns, "__k")).alias("a"), F.sum("__k").alias("t"))
    wide = row_sum.withColumn("__all", listed.select(F.struct("a", "t")).scalar())
    full = wide.select(rows, "__r", "__m", F.col("__all.t").alias("__t"), F.inline("__all.a"))
    n = F.coalesce(F.element_at("__m", F.col(columns)), F.lit(0))
    return full.select(rows, columns, n.alias("n"), (F.col("__r") * F.col("__k") / F.col("__t")).alias("expected"))


def chi_square(cells: DataFrame) -> DataFrame:
    part = (F.col("n") - F.col("expected")) ** 2 / F.col("expected")
    return cells.agg(F.sum(part).alias("chi2"))


def holm_bh(df: DataFrame, family: Sequence[str], p: str, id_col: str) -> DataFrame:
    """Holm, Benjamini-Hochberg and Bonferroni adjusted p-values per family.

    Holm is a running maximum from the smallest p up, BH a running minimum from
    the largest p down: two sweeps in p order.
    """
    placed = ordered(df, family, p, [id_col], position=True)
    n, pos = F.col("n"), F.col("pos")
    steps = placed.withColumns({"__holm": F.col(p) * (n - pos + 1), "__bh": -F.col(p) * n / pos, "__down": -pos}).drop("n", "pos")
    up = ordered(steps, family, p, [id_col], peak={"h": "__holm"}, position=True)
    up = up.withColumn("holm", F.least(F.lit(1.0), F.greatest("__holm", F.coalesce("peak_h", "__holm")))).drop("pos", "peak_h")
    down = ordered(up.drop("n"), family, "__down", [], peak={"b": "__bh"}, position=True)
    bh = F.least(F.lit(1.0), -F.greatest("__bh", F.coalesce("peak_b", "__bh")))
    return down.withColumns({"bh": bh, "bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("n"))}).drop("__holm", "__bh", "__down", "pos", "peak_b", "n")


def correlation_rows(df: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """(metric_a, metric_b, r) for every pair of columns in one pass."""
    cells = [
        F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), corr(prefix + a, prefix + b).alias("r"))
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))

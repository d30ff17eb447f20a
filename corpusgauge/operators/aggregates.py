"""Grouped measures, votes, reports and rank-based outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgauge.functions.common import ratio
from corpusgauge.plans.ordered import ordered, quantiles
from corpusgauge.session import written


def moments(value: str) -> list[Column]:
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


def corrected_skew(value: str) -> Column:
    n = F.count(value).cast("double")
    return F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def corrected_kurtosis(value: str) -> Column:
    n = F.count(value).cast("double")
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(value) + 6)


def robust_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """IQR, MAD, corrected skewness and kurtosis, range per group."""
    # Written, so that its size is known: rows are not sorted by a few groups.
    quarter = written(quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n"), "quarter")
    shape = df.groupBy(*keys).agg(
        *moments(value), corrected_skew(value).alias("skewness"), corrected_kurtosis(value).alias("kurtosis")
    )
    # Deviations are taken per distinct value, the counts stay with them.
    centred = df.join(quarter.select(*keys, "median"), list(keys)).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(centred, keys, "dev", {"mad": 0.5}).drop("n")
    joined = shape.join(quarter, list(keys)).join(mad, list(keys))
    return joined.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("spread", F.col("high") - F.col("low"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def coefficient_of_variation(value: str) -> Column:
    return F.try_divide(F.stddev_samp(value), F.abs(F.avg(value)))


#: Rows of a rater that one task puts in order; a rater with more is dealt to lanes.
RATER_ROWS = 100_000


def _levels_in_lanes(rows: DataFrame, rater: str, score: str) -> DataFrame:
    """Counts and weights below and above each row, for raters of any size."""
    per_score = rows.groupBy(rater, score).agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("sw"))
    swept = ordered(per_score, [rater], score, running={"c": "c", "w": "sw"})
    above_c = F.col("total_c") - F.col("before_c") - F.col("c")
    above_w = F.col("total_w") - F.col("before_w") - F.col("sw")
    levels = swept.select(
        rater, score, F.col("before_c").alias("beat_c"), F.col("before_w").alias("beat_w"),
        above_c.alias("lost_c"), above_w.alias("lost_w"),
    )
    return rows.join(levels, [rater, score])


def weighted_outcomes(df: DataFrame, rater: str, item: str, score: str) -> DataFrame:
    """Reliability-weighted win and loss score per item.

    An item rated k times weighs min(1, k/4); a pair weighs the mean of its two
    items.  Sums over lower scores replace one row per pair.
    """
    rated = df.groupBy(item).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 4).alias("w"))
    heavy = written(df.groupBy(rater).count().where(F.col("count") > RATER_ROWS).select(rater), "raters")
    rows = df.select(rater, item, score).where(F.col(rater).isNotNull()).join(rated, item)
    # Rows meet their rater once; totals, ties and sums up to a score come from one sort.
    upto, tied, whole = Window.partitionBy(rater).orderBy(score), Window.partitionBy(rater, score), Window.partitionBy(rater)
    sums = {"c": F.count(F.lit(1)), "w": F.sum("w")}
    levels = [(v.over(upto) - v.over(tied)).alias(f"beat_{n}") for n, v in sums.items()]
    levels += [(v.over(whole) - v.over(upto)).alias(f"lost_{n}") for n, v in sums.items()]
    own = rows.join(heavy, rater, "left_anti").select(item, score, "w", *levels)
    if not heavy.isEmpty():
        own = own.unionByName(_levels_in_lanes(rows.join(heavy, rater, "left_semi"), rater, score).select(*own.columns))
    own = own.where(F.col(score).isNotNull())
    pair_wins = (F.col("beat_c") * F.col("w") + F.col("beat_w")) / 2
    pair_losses = (F.col("lost_c") * F.col("w") + F.col("lost_w")) / 2
    totals = own.groupBy(item).agg(
        F.sum("beat_c").alias("wins"), F.sum("lost_c").alias("losses"),
        F.sum(pair_wins).alias("weighted_wins"), F.sum(pair_losses).alias("weighted_losses"),
    )
    all_weight = F.col("weighted_wins") + F.col("weighted_losses")
    return totals.withColumns(
        {
            "score": F.col("weighted_wins") - F.col("weighted_losses") / 2,
            "win_rate": ratio(F.col("weighted_wins"), all_weight),
            "confidence": F.least(F.lit(1.0), all_weight / 10),
        }
    )


def wilson(wins: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95% interval of a share."""
    p, n = wins / total, total.cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def yes_no_vote(df: DataFrame, keys: Sequence[str], label: Column, confidence: Column, quorum: int = 2) -> DataFrame:
    """Confidence sum decides, then the count; a full tie is 'no'."""
    tally = df.groupBy(*keys).agg(
        F.sum(F.when(label, confidence).otherwise(0.0)).alias("yes_weight"),
        F.sum(F.when(label, 0.0).otherwise(confidence)).alias("no_weight"),
        F.count_if(label).alias("yes_count"),
        F.count_if(~label).alias("no_count"),
    )
    yw, nw, yc, nc = (F.col(c) for c in ("yes_weight", "no_weight", "yes_count", "no_count"))
    return tally.withColumns(
        {
            "final": F.when(yw != nw, yw > nw).otherwise(yc > nc),
            "method": F.when(yw != nw, "weighted").when(yc != nc, "count").otherwise("tie-break"),
            "met_quorum": F.greatest(yc, nc) >= quorum,
        }
    )


def severity_vote(df: DataFrame, keys: Sequence[str], level: Column, confidence: Column, fixable: Column) -> DataFrame:
    """Confidence-weighted mean level; between two levels the hint picks the side."""
    mean = df.groupBy(*keys).agg(ratio(F.sum(level * confidence), F.sum(confidence)).alias("mean_level"), F.count("*").alias("votes"))
    picked = F.when(fixable, F.floor("mean_level")).otherwise(F.ceil("mean_level"))
    return mean.withColumn("level", picked.cast("int"))


def compare_arms(df: DataFrame, keys: Sequence[str], is_a: Column, is_b: Column, value: str) -> DataFrame:
    """Mean of two arms, difference, percent change and direction."""
    means = df.groupBy(*keys).agg(
        F.avg(F.when(is_a, F.col(value))).alias("mean_a"), F.avg(F.when(is_b, F.col(value))).alias("mean_b"),
        F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"),
    )
    diff = F.col("mean_a") - F.col("mean_b")
    return means.withColumns({"diff": diff, "pct": 100 * ratio(diff, F.abs("mean_b")), "improved": diff > 0})


def value_counts_many(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(question, answer, n) over several columns in one scan."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    rows = text.unpivot([], list(columns), "question", "answer")
    return rows.groupBy("question", "answer").agg(F.count("*").alias("n"))


def wide_report(one: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One aggregate row to (metric, value) rows."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()])))

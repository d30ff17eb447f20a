"""Row-level scores, buckets and scales as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.common import attach
from corpusgauge.plans.ordered import ordered, quantiles, value_counts


def weighted_sum(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def bands(value: Column, limits: Sequence[tuple[float, str]], other: str) -> Column:
    """First label whose upper limit is above the value."""
    label = None
    for limit, name in limits:
        label = F.when(value < limit, name) if label is None else label.when(value < limit, name)
    return label.otherwise(other)


def optimal_range(value: Column, low: float, high: Column | float, floor_at: float = 0.0) -> Column:
    """1 inside [low, high], linear fall to 0 below and above."""
    high = high if isinstance(high, Column) else F.lit(float(high))
    below = value / F.lit(float(low))
    above = F.greatest(F.lit(floor_at), 1 - (value - high) / high)
    return F.when(value < low, below).when(value <= high, 1.0).otherwise(above)


def equal_width_tier(value: Column, low: Column, high: Column, tiers: int) -> Column:
    """Tier 1..n over equal widths of [low, high]; the top edge is in the last tier."""
    spot = F.floor((value - low) / (high - low) * tiers) + 1
    return F.when(high == low, 1).otherwise(F.least(spot, F.lit(tiers))).cast("int")


def _between(column: str, out: str, df: DataFrame, higher_better: bool, clip: bool) -> DataFrame:
    lo, hi = F.col("__ends.lo"), F.col("__ends.hi")
    x = (F.col(column) - lo) / F.nullif(hi - lo, F.lit(0.0))
    if clip:
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    # least and greatest skip NULL, so equal limits are told apart first.
    scaled = F.when(hi == lo, 0.5).otherwise(x if higher_better else 1 - x)
    return df.withColumn(out, F.when(F.col(column).isNotNull(), scaled)).drop("__ends")


def min_max(df: DataFrame, column: str, out: str, higher_better: bool = True) -> DataFrame:
    """Scale to 0..1 by the whole column's range; a constant column gives .5."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return _between(column, out, attach(df, ends, "__ends"), higher_better, clip=False)


def robust_scale(df: DataFrame, column: str, out: str, higher_better: bool = True) -> DataFrame:
    """Scale by the 5th and 95th percentile, clipped to 0..1; equal limits give .5."""
    ends = quantiles(df, [], column, {"lo": 0.05, "hi": 0.95})
    return _between(column, out, attach(df, ends, "__ends"), higher_better, clip=True)


# The two published scoring cards, four parts of 25 points each.
def quality_card(words: Column, chars: Column, sentences: Column, chapters: Column, cast: Column, depth: Column) -> dict[str, Column]:
    words, chars, sentences, chapters, cast = (c.cast("double") for c in (words, chars, sentences, chapters, cast))
    length = F.try_divide(words, sentences)
    rich = F.when(length < 5, length / 5 * 15).when(length > 25, F.greatest(F.lit(15.0), 25 - (length - 25) * 0.5)).otherwise(25.0)
    density = F.least(F.try_divide(chars, words) / 2.5 * 10, F.lit(10.0))
    richness = F.when((words > 0) & (sentences > 0), F.least(rich + density, F.lit(25.0))).otherwise(0.0)

    per_chapter = F.try_divide(words, chapters)
    size = (
        F.when(per_chapter.between(300, 800), 15.0)
        .when(per_chapter < 300, per_chapter / 300 * 15)
        .otherwise(F.greatest(F.lit(10.0), 15 - (per_chapter - 800) / 200))
    )
    count = (
        F.when(chapters.between(3, 15), 10.0)
        .when(chapters < 3, chapters / 3 * 10)
        .otherwise(F.greatest(F.lit(5.0), 10 - (chapters - 15) * 0.3))
    )
    structure = F.when((chapters > 0) & (words > 0), F.least(size + count, F.lit(25.0))).otherwise(0.0)

    balance = (
        F.when(cast.between(2, 8), 15.0).when(cast == 1, 10.0).otherwise(F.greatest(F.lit(8.0), 15 - F.abs(cast - 5)))
    )
    consistency = F.when(cast > 0, F.least(balance + F.least(depth / 50, F.lit(10.0)), F.lit(25.0))).otherwise(0.0)

    per = F.try_divide(sentences, chapters)
    flow = (
        F.when(per.between(10, 40), 25.0)
        .when(per < 10, per / 10 * 25)
        .otherwise(F.greatest(F.lit(15.0), 25 - (per - 40) * 0.2))
    )
    coherence = F.when((sentences > 0) & (chapters > 0), flow).otherwise(0.0)
    return {"text_richness": richness, "story_structure": structure, "content_consistency": consistency, "text_coherence": coherence}


def _step_down(amount: Column, words: Column, full: float, passing: float, slope: float) -> Column:
    per_word = F.try_divide(amount, words)
    scored = (
        F.when(per_word <= full, 25.0)
        .when(per_word <= passing, 15 + (passing - per_word) / (passing - full) * 10)
        .otherwise(F.greatest(F.lit(5.0), 15 - (per_word - passing) * slope))
    )
    return F.when((amount > 0) & (words > 0), scored).otherwise(25.0)


def efficiency_card(words: Column, seconds: Column, cost: Column, memory: Column, tokens: Column) -> dict[str, Column]:
    speed = F.try_divide(words.cast("double"), seconds)
    pace = F.when(speed >= 3, 25.0).when(speed >= 1, 15 + (speed - 1) / 2 * 10).otherwise(speed * 15)
    return {
        "time_efficiency": F.when((seconds > 0) & (words > 0), pace).otherwise(0.0),
        "cost_efficiency": _step_down(cost, words, 0.0005, 0.002, 5000),
        "memory_efficiency": _step_down(memory, words, 0.005, 0.02, 500),
        "token_efficiency": _step_down(tokens, words, 1.5, 3.0, 5),
    }


def winsorized(df: DataFrame, column: str, share: float) -> DataFrame:
    """Clip the lowest and highest ``share`` of rows (by rank) to the k-th values."""
    counts = ordered(value_counts(df, [], column), [], column, running={"c": "c"})
    k = F.floor(F.col("total_c") * F.lit(share))
    first, last = F.col("before_c"), F.col("before_c") + F.col("c") - 1
    ends = counts.agg(
        F.min(F.when(last >= k, F.col(column))).alias("lo"),
        F.max(F.when(first <= F.col("total_c") - k - 1, F.col(column))).alias("hi"),
    )
    limited = attach(df, ends, "__ends")
    clipped = F.least(F.col("__ends.hi"), F.greatest(F.col("__ends.lo"), F.col(column)))
    return limited.withColumn("winsorized", F.when(F.col(column).isNotNull(), clipped)).drop("__ends")

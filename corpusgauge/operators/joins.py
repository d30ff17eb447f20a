"""Joins: paired deltas, nearest match, Pareto front, fuzzy match, version diff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.common import flat, scalar
from corpusgauge.plans.ordered import ordered
from corpusgauge.session import written


def paired_delta(df: DataFrame, keys: Sequence[str], is_base: Column, value: str) -> DataFrame:
    """Every non-base row minus the base mean of the same keys (inner join)."""
    base = df.where(is_base).groupBy(*keys).agg(F.avg(value).alias("base_value"))
    return df.where(~is_base).join(base, list(keys)).withColumn("delta", F.col(value) - F.col("base_value"))


def qualified(df: DataFrame, group: str, member: str, at_least: int) -> DataFrame:
    """Rows of groups with enough distinct members (semi join)."""
    good = df.groupBy(group).agg(F.count_distinct(member).alias("__m")).where(F.col("__m") >= at_least)
    return df.join(good, group, "left_semi")


def nearest_match(df: DataFrame, id_col: str, value: str, is_base: Column) -> DataFrame:
    """For every base row the other row with the nearest value, with replacement.

    Others outside the base range are left out.  Equal distance takes the lower
    value; equal values take the lowest id.
    """
    ends = scalar(df.where(is_base).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    others = (
        df.where(~is_base)
        .where(F.col(value).between(ends["lo"], ends["hi"]))
        .groupBy(value)
        .agg(F.min(id_col).alias(id_col))
        .select(id_col, value, F.lit(False).alias("base"))
    )
    both = others.unionByName(df.where(is_base).select(id_col, value, F.lit(True).alias("base")))
    # Others sort before base rows of the same value; ids spread a hot value.
    far = F.when(F.col("base"), F.lit(1 << 52)).otherwise(0)
    both = both.withColumn("seq", F.col(id_col) + far)
    hit = (~F.col("base"), [id_col, value])
    walked = ordered(both, [], value, ["seq"], seen=hit).where("base")
    back, ahead = F.col("last_seen"), F.col("next_seen")
    take_back = ahead.isNull() | (F.col(value) - back[value] <= ahead[value] - F.col(value))
    chosen = F.when(back.isNotNull() & take_back, back).otherwise(ahead)
    return walked.select(
        F.col(id_col).alias("base_id"), F.col(value).alias("base_value"),
        chosen[id_col].alias("match_id"), chosen[value].alias("match_value"),
    )


def pareto_front(df: DataFrame, cost: str, quality: str) -> DataFrame:
    """Rows that no other row beats: low cost, high quality.

    One sweep in cost order replaces the all-pairs comparison.
    """
    best = df.groupBy(cost).agg(F.max(quality).alias(quality))
    swept = ordered(best, [], cost, peak={"q": quality})
    front = swept.where(F.col("peak_q").isNull() | (F.col(quality) > F.col("peak_q"))).select(cost, quality)
    return df.join(front, [cost, quality], "left_semi")


def full_merge(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of keys with both sides' columns as ``a_x`` and ``b_x``."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    merged = left.join(right, list(keys), "full_outer")
    return merged.withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))


def version_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Added, removed and changed keys; equal rows are left out."""
    merged = full_merge(a, b, keys, columns)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    kind = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").when(~same, "changed")
    return merged.withColumn("change", kind).where(F.col("change").isNotNull()).drop("in_a", "in_b")


def corrected(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New values replace old ones by key, new keys are added."""
    merged = full_merge(old, new, keys, columns)
    return merged.select(*keys, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in columns])


#: Left words that are met where right units are read; with more, pairs are found first.
MANY_HEADS = 50_000


def fuzzy_matches(left: DataFrame, right: DataFrame, left_id: str, right_order: Sequence[str], words: str, floor: float) -> DataFrame:
    """First right unit whose word set has Jaccard >= ``floor``, per left unit.

    Exact: a right set at or above the floor shares at least ceil(floor * size) words
    with the left set, so it holds one of any size - ceil(floor * size) + 1 words of it.
    The left words that fewest right units hold are taken, and right units meet them
    word by word where they are read: neither they nor their words are moved.  Only if
    the left words are too many to be sent to all tasks, pairs are found first and get
    their words after.
    """
    units = left.where(F.col(left_id).isNotNull()).select(left_id, F.sort_array(F.array_distinct(words)).alias("__lw"))
    units = written(units.distinct(), "units")
    wanted = flat(units, [left_id, "__lw"], F.col("__lw"), "__w")
    right = right.select(*right_order, F.array_distinct(words).alias("__rw"))
    # Rare by what the right side holds; any order of the words is exact.
    freq = flat(right, [], F.col("__rw"), "__w").join(wanted.select("__w").distinct(), "__w", "left_semi").groupBy("__w").agg(F.count(F.lit(1)).alias("__f"))
    ranked = wanted.join(freq, "__w", "left").groupBy(left_id, "__lw").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("__f", F.lit(0)).alias("__f"), "__w"))).alias("__a"))
    keep = (F.size("__lw") - F.ceil(F.size("__lw") * F.lit(floor)) + 1).cast("int")
    heads = ranked.select(left_id, "__lw", F.explode(F.slice("__a", F.lit(1), keep)).alias("__e")).where("__e.__f > 0")
    # Written, so that its size is known and a small table is sent to the tasks.
    heads = written(heads.select(left_id, "__lw", F.col("__e.__w").alias("__w")), "heads")

    first = F.struct(*right_order).alias("__first")
    n, m = F.size("__lw"), F.col("__n")
    many = heads.count() > MANY_HEADS
    carried = right.select(first, F.size("__rw").alias("__n"), "__rw")
    met = flat(carried, ["__first", "__n"] if many else ["__first", "__n", "__rw"], F.col("__rw"), "__w").join(heads, "__w")
    pairs = met.where((m >= n * F.lit(floor)) & (n >= m * F.lit(floor))).drop("__w", "__n")
    if many:
        pairs = pairs.distinct().join(right.select(first, "__rw"), "__first")
    shared = F.size(F.array_intersect("__lw", "__rw"))
    jaccard = shared / (F.size("__lw") + F.size("__rw") - shared)
    hits = pairs.select(left_id, "__first", jaccard.alias("jaccard")).where(F.col("jaccard") >= floor)
    best = hits.groupBy(left_id).agg(F.min_by(F.struct("__first", "jaccard"), "__first").alias("__m"))
    return best.select(left_id, *[F.col("__m.__first")[c].alias(c) for c in right_order], F.col("__m.jaccard").alias("jaccard"))


def beaten_counts(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], by_config: Mapping[str, Column] | None = None) -> DataFrame:
    """Wins, losses and ties of each row against all rows of its group.

    Rank arithmetic gives what a self join over all unordered pairs would count,
    without one row per pair.  ``by_config`` counts wins per opponent class.
    """
    flags = {f"is_{n}": c.cast("int") for n, c in (by_config or {}).items()}
    rows = df.withColumns(flags) if flags else df
    ranked = ordered(rows, keys, score, tie, rank=True)
    out = ranked.withColumns(
        {"wins": F.col("lo") - 1, "losses": F.col("n") - F.col("lo") - F.col("ties") + 1, "draws": F.col("ties") - 1}
    )
    return out


def wins_by_class(df: DataFrame, keys: Sequence[str], score: str, config: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Winner class x loser class pair counts inside groups, ties skipped.

    ``classes`` names the columns of the matrix, as pivot values do; without it they
    are all labels that the rows hold.
    """
    if classes is None:
        classes = sorted(r[0] for r in df.select(config).where(F.col(config).isNotNull()).distinct().collect())
    per_value = df.groupBy(*keys, score, config).agg(F.count(F.lit(1)).alias("__c"))
    # Rows of one score meet lower scores only: sum per class over lower scores.
    at_score = per_value.groupBy(*keys, score).agg(F.map_from_entries(F.collect_list(F.struct(config, "__c"))).alias("__m"))
    wide = at_score.select(*keys, score, *[F.coalesce(F.col("__m")[c], F.lit(0)).alias(f"__c{i}") for i, c in enumerate(classes)])
    swept = ordered(wide, keys, score, running={f"{i}": f"__c{i}" for i in range(len(classes))})
    cells = [
        F.struct(F.lit(a).alias("winner"), F.lit(b).alias("loser"), F.sum(F.col(f"__c{i}") * F.col(f"before_{j}")).alias("n"))
        for i, a in enumerate(classes)
        for j, b in enumerate(classes)
    ]
    return swept.agg(F.array(*cells).alias("__r")).select(F.inline("__r"))

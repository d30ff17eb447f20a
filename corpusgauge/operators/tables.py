"""Row and column reshaping: keep-first dedup, unions, long form, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order.

    An aggregate instead of a window: copies collapse before the shuffle, so a
    key with very many copies costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames of different layout, each row tagged with its origin."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Unpivot; blanks (NULL) are dropped."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, value).where(F.col(value).isNotNull())


def standard_layout(df: DataFrame, content: Sequence[str], ids: Sequence[str], default_id: Column) -> DataFrame:
    """``unit_id`` and ``content`` from the first present candidate column."""
    have = set(df.columns)
    texts = [F.col(c) for c in content if c in have]
    names = [F.col(c).cast("string") for c in ids if c in have]
    return df.withColumn("content", F.coalesce(*texts)).withColumn("unit_id", F.coalesce(*names, default_id))


def completeness(df: DataFrame, columns: Sequence[str], floor: float) -> DataFrame:
    """Non-null and finite share per column, one scan for all columns."""
    bad = [float("inf"), float("-inf")]
    shares = []
    for c in columns:
        filled = F.col(c).isNotNull()
        if dict(df.dtypes)[c] == "double":
            finite = filled & ~F.isnan(c) & ~F.col(c).isin(bad)
        else:
            finite = filled
        shares.append(F.struct(F.lit(c).alias("metric"), F.avg(filled.cast("double")).alias("filled"),
                               F.avg(F.coalesce(finite, F.lit(False)).cast("double")).alias("finite")))
    one = df.agg(F.array(*shares).alias("s"))
    return one.select(F.inline("s")).withColumn("flagged", F.col("finite") < floor)


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct-value report per column and whether it stays for correlation."""
    one = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("metric"), (F.col(f"lo_{c}") != F.col(f"hi_{c}")).alias("kept")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select only columns with more than one value (one bounded row decides)."""
    kept = [r["metric"] for r in varying_columns(df, columns).collect() if r["kept"]]
    return df.select(*[c for c in df.columns if c not in columns or c in kept])

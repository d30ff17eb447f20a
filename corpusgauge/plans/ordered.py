"""Ordered work over groups of any size, without one task per group.

A plain ``Window.partitionBy(key).orderBy(x)`` sorts a whole group in one task,
and a global rank or an exact percentile puts the whole table there.  Here the
order column is cut into lanes at approximate quantiles, so that a lane holds
about ``1/parts`` of the rows whatever the group sizes are.  A small table with
one row per (group, lane) carries counts, sums and border rows from lane to
lane; the window itself runs inside (group, lane).

Cut points only decide how work is spread: results are exact for any cuts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.session import written


#: Lanes that quantiles are looked for in, at least.
LEAST_LANES = 64


@dataclass(frozen=True)
class Cuts:
    """Sorted lane borders, and the lanes that hold one (hot) value only."""

    borders: tuple[float, ...]
    single: tuple[int, ...]


def lanes_for(df: DataFrame, parts: int | None = None) -> int:
    """One lane per shuffle partition, so lanes shrink as the setting grows with the data."""
    return max(1, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.expr(
            f"cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(`{name}` as timestamp_ntz)) as double)"
        )
    return F.col(name).cast("double")


def cut_points(df: DataFrame, name: str, parts: int | None = None) -> Cuts:
    """At most ``parts - 1`` borders reach the driver; rows never do."""
    lanes = lanes_for(df, parts)
    if lanes == 1:
        return Cuts((), ())
    shares = [i / lanes for i in range(1, lanes)]
    marks = df.select(as_double(df, name).alias("v")).approxQuantile("v", shares, 0.5 / lanes)
    borders: list[float] = []
    for mark in sorted(marks):
        if borders and mark == borders[-1]:
            # A value that spans two marks is hot: give it a lane of its own.
            borders.append(math.nextafter(mark, math.inf))
        elif not borders or mark > borders[-1]:
            borders.append(mark)
    single = tuple(
        i + 1 for i, (a, b) in enumerate(zip(borders, borders[1:])) if b == math.nextafter(a, math.inf)
    )
    return Cuts(tuple(borders), single)


def with_lane(df: DataFrame, name: str, cuts: Cuts, out: str) -> DataFrame:
    if not cuts.borders:
        return df.withColumn(out, F.lit(0.0))
    probe = f"{out}_in"
    splits = [-math.inf, *cuts.borders, math.inf]
    laned = Bucketizer(splits=splits, inputCol=probe, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(probe, as_double(df, name))
    )
    return laned.drop(probe)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: Sequence[str] = (),
    *,
    prev: Sequence[str] = (),
    nxt: Sequence[str] = (),
    running: Mapping[str, str] | None = None,
    peak: Mapping[str, str] | None = None,
    seen: tuple[Column, Sequence[str]] | None = None,
    rank: bool = False,
    position: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add order-dependent columns to every row of ``df``.

    position: ``pos`` (1-based by ``by, *tie``) and ``n`` (group size).
    rank: ``lo`` (rank of the first tied row), ``ties`` and ``n``.
    prev / nxt: struct column ``prev`` / ``nxt`` of the neighbour's columns.
    running: for name -> column, ``before_<name>`` (sum over earlier rows) and
    ``total_<name>``.
    peak: for name -> column, ``peak_<name>`` (largest value of earlier rows).
    seen: (condition, columns) gives struct columns ``last_seen`` and
    ``next_seen`` of the nearest earlier / later row that meets the condition.

    ``by`` must not be NULL.  The first ``tie`` column is numeric and spreads
    rows that share one hot ``by`` value.
    """
    running, peak = dict(running or {}), dict(peak or {})
    cuts = cut_points(df, by, parts)
    laned = with_lane(df, by, cuts, "__b")
    if cuts.single and tie:
        tie_cuts = cut_points(df, tie[0], parts)
        laned = with_lane(laned, tie[0], tie_cuts, "__t")
        hot = F.col("__b").isin([float(i) for i in cuts.single])
        laned = laned.withColumn("__s", F.when(hot, F.col("__t")).otherwise(0.0)).drop("__t")
    else:
        laned = laned.withColumn("__s", F.lit(0.0))

    order = [by, *tie]
    order_key = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__c")]
    aggs += [F.sum(c).alias(f"__sum_{n}") for n, c in running.items()]
    aggs += [F.max(c).alias(f"__max_{n}") for n, c in peak.items()]
    if seen:
        hit_key = F.when(seen[0], order_key)
        aggs.append(F.max_by(F.struct(*seen[1]), hit_key).alias("__seen_last"))
        aggs.append(F.min_by(F.struct(*seen[1]), hit_key).alias("__seen_first"))
    if prev:
        aggs.append(F.max_by(F.struct(*prev), order_key).alias("__last"))
    if nxt:
        aggs.append(F.min_by(F.struct(*nxt), order_key).alias("__first"))
    lanes = laned.groupBy(*keys, "__b", "__s").agg(*aggs)

    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    along = group.orderBy("__b", "__s")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [
        F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__off"),
        F.sum("__c").over(group).alias("__n"),
    ]
    if rank:
        carried.append(F.sum("__c").over(group.orderBy("__b").rangeBetween(Window.unboundedPreceding, 0)).alias("__thru"))
    for name in running:
        carried.append(F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__off_{name}"))
        carried.append(F.sum(f"__sum_{name}").over(group).alias(f"__tot_{name}"))
    for name in peak:
        carried.append(F.max(f"__max_{name}").over(earlier).alias(f"__peak_{name}"))
    if seen:
        later = along.rowsBetween(1, Window.unboundedFollowing)
        carried.append(F.last("__seen_last", ignorenulls=True).over(earlier).alias("__seen_before"))
        carried.append(F.first("__seen_first", ignorenulls=True).over(later).alias("__seen_after"))
    if prev:
        carried.append(F.lag("__last").over(along).alias("__prev"))
    if nxt:
        carried.append(F.lead("__first").over(along).alias("__next"))
    here = [*keys, "__b", "__s"]
    offsets = lanes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(here)], "__c", *carried)
    if rank:
        whole = Window.partitionBy(*[f"__k{i}" for i in range(len(here) - 1)])
        offsets = offsets.withColumn("__lane_n", F.sum("__c").over(whole))
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(here)]
    )
    rows = laned.join(offsets, same).drop(*[f"__k{i}" for i in range(len(here))])

    inside = Window.partitionBy(*here)
    walk = inside.orderBy(*order)
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col("__off") + F.row_number().over(walk)).alias("pos"))
    if rank:
        hot = F.col("__b").isin([float(i) for i in cuts.single])
        start = F.col("__thru") - F.col("__lane_n")
        if not cuts.single:
            out.append((start + F.rank().over(inside.orderBy(by))).alias("lo"))
            out.append(F.count(F.lit(1)).over(Window.partitionBy(*here, by)).alias("ties"))
        else:
            out.append((start + F.when(hot, F.lit(1)).otherwise(F.rank().over(inside.orderBy(by)))).alias("lo"))
            tied = F.count(F.lit(1)).over(Window.partitionBy(*here, by))
            out.append(F.when(hot, F.col("__lane_n")).otherwise(tied).alias("ties"))
    if rank or position:
        out.append(F.col("__n").alias("n"))
    for name, column in running.items():
        local = F.sum(column).over(walk.rowsBetween(Window.unboundedPreceding, -1))
        out.append((F.col(f"__off_{name}") + F.coalesce(local, F.lit(0))).alias(f"before_{name}"))
        out.append(F.col(f"__tot_{name}").alias(f"total_{name}"))
    up_to = walk.rowsBetween(Window.unboundedPreceding, -1)
    for name, column in peak.items():
        out.append(F.greatest(F.col(f"__peak_{name}"), F.max(column).over(up_to)).alias(f"peak_{name}"))
    if seen:
        hit = F.when(seen[0], F.struct(*seen[1]))
        back = F.last(hit, ignorenulls=True).over(up_to)
        # A growing frame in the reverse order: one pass, unlike a shrinking frame.
        reverse = inside.orderBy(*[F.desc(c) for c in order])
        ahead = F.last(hit, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
        out.append(F.coalesce(back, F.col("__seen_before")).alias("last_seen"))
        out.append(F.coalesce(ahead, F.col("__seen_after")).alias("next_seen"))
    first_here = F.row_number().over(walk) == 1
    if prev:
        step = F.lag(F.struct(*prev)).over(walk)
        out.append(F.when(first_here, F.col("__prev")).otherwise(step).alias("prev"))
    if nxt:
        ahead = F.lead(F.struct(*nxt)).over(walk)
        out.append(F.coalesce(ahead, F.col("__next")).alias("nxt"))
    return rows.select(*out)


def average_rank(lo: str = "lo", ties: str = "ties") -> Column:
    """Mean of the ranks that tied rows share."""
    return F.col(lo) + (F.col(ties) - 1) / F.lit(2.0)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (group, value): the map-side combine that tames hot values."""
    aggs = [F.count(F.lit(1)).alias("c")] + [F.sum(c).alias(n) for n, c in (extra or {}).items()]
    return df.where(_measured(value)).groupBy(*keys, value).agg(*aggs)


def _measured(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    parts: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per name.

    Lanes are counted first; only the rows of lanes that hold a wanted place are put in order.
    """
    rows = df.where(_measured(value)).select(*keys, value)
    cuts = cut_points(rows, value, parts or max(lanes_for(df), LEAST_LANES))
    laned = with_lane(rows, value, cuts, "__b")
    lanes = laned.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    places = lanes.withColumns({"__off": F.coalesce(F.sum("__c").over(earlier), F.lit(0)), "total_c": F.sum("__c").over(group)})
    spots = [f((F.col("total_c") - 1) * F.lit(float(p))) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = reduce(lambda a, b: a | b, [(F.col("__off") <= at) & (at < F.col("__off") + F.col("__c")) for at in spots])
    here = [*keys, "__b"]
    # Written, so that its size is known: few groups are a small table.
    needed = written(places.where(wanted).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(here)], "__off", "total_c"), "lanes")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(here)])
    kept = laned.join(needed, same).groupBy(*here, value, "__off", "total_c").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy(*here).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    walked = kept.withColumn("before_c", F.col("__off") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    held = lambda at: (F.col("before_c") <= at) & (at < F.col("before_c") + F.col("c"))
    aggs = [F.max("total_c").alias("n")]
    for name, p in probs.items():
        at = (F.col("total_c") - 1) * F.lit(float(p))
        aggs.append(F.max(F.when(held(F.floor(at)), F.col(value))).alias(f"__lo_{name}"))
        aggs.append(F.max(F.when(held(F.ceil(at)), F.col(value))).alias(f"__hi_{name}"))
    picked = walked.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, "n", *out)


def framed(df: DataFrame, keys: Sequence[str], back: int, ahead: int, chunk: int = 65536) -> tuple[DataFrame, list[str]]:
    """Cut positioned rows (``pos``) into chunks with a halo of neighbour rows.

    Returns the rows plus partition columns for a Window ordered by ``pos``;
    keep only rows where ``own`` is true after the window.
    """
    home = F.floor((F.col("pos") - 1) / F.lit(chunk))
    at = F.pmod(F.col("pos") - 1, F.lit(chunk))
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= chunk - back, home + 1),
            F.when((at < ahead) & (home > 0), home - 1),
        )
    )
    spread = df.withColumn("__home", home).withColumn("chunk", F.explode(targets))
    return spread.withColumn("own", F.col("chunk") == F.col("__home")).drop("__home"), [*keys, "chunk"]


def attach_ranks(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """Average rank inside each group for several columns (column -> new name).

    Ranks are worked out per distinct value from ``df`` itself and joined back
    by value, so the plan grows by one join per column.
    """
    out = df
    for column, name in columns.items():
        walked = ordered(value_counts(df, keys, column), keys, column, running={"c": "c"}, parts=parts)
        ranks = walked.select(*keys, column, (F.col("before_c") + (F.col("c") + 1) / 2).alias(name))
        out = out.join(ranks, [*keys, column])
    return out

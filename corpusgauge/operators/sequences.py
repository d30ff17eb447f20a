"""Ordered series work: neighbours, runs, smoothing, decisions, arc shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.common import ratio
from corpusgauge.plans.ordered import framed, ordered


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two numeric arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))


def adjacent_similarity(df: DataFrame, keys: Sequence[str], order: str, vector: str) -> DataFrame:
    """Cosine of each row with the row before it; the first row has none."""
    walked = ordered(df.select(*keys, order, vector), keys, order, prev=[vector], position=True)
    pairs = walked.where(F.col("prev").isNotNull())
    return pairs.select(*keys, order, (F.col("pos") - 1).alias("gap"), cosine(F.col(f"prev.{vector}"), F.col(vector)).alias("similarity"))


def group_limits(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def breakpoints(sims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below their own group's mean minus one population deviation."""
    limits = group_limits(sims, keys, "similarity")
    return sims.join(limits, list(keys)).where(F.col("similarity") < F.col("mean") - F.col("std"))


def high_segments(df: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = (), lift: float = 0.5, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` adjacent values above mean + lift * std."""
    limits = group_limits(df, keys, value)
    marked = df.join(limits, list(keys)).withColumn("high", (F.col(value) > F.col("mean") + lift * F.col("std")).cast("int"))
    walked = ordered(marked, keys, order, tie, position=True, running={"high": "high"})
    runs = walked.where("high = 1").withColumn("island", F.col("pos") - F.col("before_high"))
    return (
        runs.groupBy(*keys, "island")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length"), F.avg(value).alias("average"))
        .where(F.col("length") >= least)
        .drop("island")
    )


def moving_averages(df: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Centred means of 3 (end points stay raw) and 5 (frame shrinks at the ends)."""
    placed = ordered(df, keys, order, tie, position=True)
    rows, part = framed(placed, keys, 2, 2)
    w = Window.partitionBy(*part).orderBy("pos")
    three = F.avg(value).over(w.rowsBetween(-1, 1))
    out = rows.withColumn("ma5", F.avg(value).over(w.rowsBetween(-2, 2)))
    out = out.withColumn("ma3", F.when((F.col("pos") == 1) | (F.col("pos") == F.col("n")), F.col(value)).otherwise(three))
    return out.where("own").drop("own", "chunk")


def exponential_smoothing(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float = 0.3, tie: Sequence[str] = ()) -> DataFrame:
    """s0 = x0, then s = alpha * x + (1 - alpha) * s.

    Inside a chunk the recurrence is a weighted running sum; chunks are as long as
    the weights stay finite.  A chunk maps the value before it, s, to a * s + b;
    these maps are composed over 2, 4, 8 ... chunks until what is left out weighs
    less than double precision, so any alpha in (0, 1] is exact.
    """
    keep = 1.0 - alpha
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if keep == 0:
        return ordered(df, keys, order, tie, position=True).withColumn("smoothed", F.col(value).cast("double"))
    chunk = max(1, min(256, int(250 / -math.log10(keep))))
    placed = ordered(df, keys, order, tie, position=True)
    rows = placed.withColumns({"__chunk": F.floor((F.col("pos") - 1) / chunk), "__i": F.pmod(F.col("pos") - 1, F.lit(chunk))})
    part = [*keys, "__chunk"]
    weight = F.when(F.col("pos") == 1, 1.0).otherwise(alpha)
    w = Window.partitionBy(*part).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(weight * F.col(value) * F.pow(F.lit(keep), -F.col("__i"))).over(w)
    local = rows.withColumn("__local", grown * F.pow(F.lit(keep), F.col("__i")))
    ends = local.groupBy(*part).agg(F.max_by("__local", "__i").alias("__carry"), F.pow(F.lit(keep), F.max("__i") + 1).alias("__a"))
    reach, by_chunk = 1, Window.partitionBy(*keys).orderBy("__chunk")
    while keep ** (chunk * reach) > 1e-18:
        before, a_before = (F.coalesce(F.lag(c, reach).over(by_chunk), F.lit(0.0)) for c in ("__carry", "__a"))
        ends = ends.select(*part, (F.col("__carry") + F.col("__a") * before).alias("__carry"), (F.col("__a") * a_before).alias("__a"))
        reach *= 2
    ends = ends.withColumn("__chunk", F.col("__chunk") + 1).drop("__a")
    full = local.join(ends, part, "left")
    smooth = F.col("__local") + F.coalesce("__carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("__i") + 1)
    return full.withColumn("smoothed", smooth).drop("__chunk", "__i", "__local", "__carry")


def group_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """z-score per group; a group without spread is only centred."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__sd"))
    spread = F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    return df.join(stats, list(keys)).withColumn(out, (F.col(value) - F.col("__m")) / spread).drop("__m", "__sd")


def reference_percentiles(df: DataFrame, value: str, is_reference: Column) -> DataFrame:
    """Share of the reference set at or below and strictly below each value."""
    counts = df.groupBy(value).agg(F.count_if(is_reference).alias("r"))
    walked = ordered(counts, [], value, running={"r": "r"})
    total = F.col("total_r")
    return walked.select(
        value, ratio(F.col("before_r") + F.col("r"), total).alias("at_or_below"), ratio(F.col("before_r"), total).alias("below")
    )


def fluctuation(df: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = (), zone: float = 0.1) -> DataFrame:
    """Peaks, valleys, volatility and signed direction changes per series."""
    walked = ordered(df, keys, order, tie, prev=[value], nxt=[value], position=True)
    x, a, b = F.col(value), F.col(f"prev.{value}"), F.col(f"nxt.{value}")
    turns = F.signum(x - a) != F.signum(b - x)
    return walked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.max(x) - F.min(x)).alias("spread"),
        (F.max_by(x, "pos") - F.min_by(x, "pos")).alias("trend"),
        F.count_if((x > a) & (x > b)).alias("peaks"), F.count_if((x < a) & (x < b)).alias("valleys"),
        F.avg(F.abs(x - a)).alias("volatility"), F.max(F.abs(x - a)).alias("max_change"), F.count_if(turns).alias("turns"),
        F.count_if(x > zone).alias("positive"), F.count_if(x < -zone).alias("negative"), F.count_if(F.abs(x) <= zone).alias("neutral"),
    )


def two_state_scan(df: DataFrame, keys: Sequence[str], order: str, if_off: str, if_on: str, tie: Sequence[str] = ()) -> DataFrame:
    """Run a yes/no decision that depends on the row before.

    ``if_off`` / ``if_on`` hold each row's answer (0/1) after a no / a yes.  A
    row with one answer for both resets the state; a row that swaps them
    toggles it.  The state is the last reset's answer, flipped once per toggle
    since, so no row has to wait for the one before it.
    """
    off, on = F.col(if_off), F.col(if_on)
    marked = df.withColumn("toggle", ((off == 1) & (on == 0)).cast("int"))
    counted = ordered(marked, keys, order, tie, running={"t": "toggle"})
    counted = counted.withColumn("done", F.col("before_t") + F.col("toggle")).drop("before_t", "total_t")
    walked = ordered(counted, keys, order, tie, seen=(off == on, [if_off, "done"]))
    start = F.coalesce(F.col(f"last_seen.{if_off}"), F.lit(0))
    since = F.col("done") - F.coalesce(F.col("last_seen.done"), F.lit(0))
    carried = F.pmod(start + since, F.lit(2)).cast("int")
    return walked.withColumn("decision", F.when(off == on, off).otherwise(carried)).drop("last_seen", "next_seen", "done", "toggle")


def cooldown_answers(presence: Column, intensity: Column, info: Column, pacing: Column) -> dict[str, Column]:
    """Answers after a no and after a yes; NULL-safe, undecided counts as no.

    Fixed rule order: veto, hard trigger, cooldown, two votes of three, tie rule.
    """
    votes = (intensity == "MED").cast("int") + (info == "HIGH").cast("int") + (pacing == "ENCOURAGE").cast("int")
    sure = presence != "UNCERTAIN"
    tie = (info == "HIGH") & (intensity == "LOW")
    settled = F.when((votes >= 2) & sure, 1).when(tie, ((pacing == "ENCOURAGE") & sure).cast("int"))
    fresh = F.when(presence == "DENIED", 0).when(intensity == "HIGH", 1).otherwise(F.coalesce(settled, F.lit(0)))
    cooled = (presence != "DENIED") & (intensity != "HIGH") & (pacing != "ENCOURAGE")
    open_case = (presence != "DENIED") & (intensity != "HIGH") & settled.isNull()
    return {"if_off": fresh, "if_on": F.when(cooled, 0).otherwise(fresh), "open_case": open_case, "cooled": cooled}


def even_slots(index: Column, items: Column, slots: Column) -> Column:
    """Slot 1..m of item ``index`` (1-based): the first n mod m slots get one more."""
    base, extra = F.floor(items / slots), F.pmod(items, slots)
    wide = extra * (base + 1)
    return F.when(index <= wide, F.floor((index - 1) / (base + 1)) + 1).otherwise(extra + F.floor((index - 1 - wide) / F.greatest(base, F.lit(1))) + 1)


# Six arc shapes over t in 0..1, with their codes.
ARCS = [
    ("Rags to riches", "RR", "0.8 * (t - 0.2)"),
    ("Tragedy", "TR", "0.8 * (0.8 - t)"),
    ("Man in a hole", "MH", "0.5 * sin(pi() * t - pi() / 2)"),
    ("Icarus", "IC", "0.5 * sin(pi() * t + pi() / 2)"),
    ("Cinderella", "CN", "0.5 * sin(2 * pi() * t - pi() / 2)"),
    ("Oedipus", "OE", "0.5 * sin(2 * pi() * t + pi() / 2)"),
]


def arc_labels(df: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Best of six arc shapes per series by cosine (cut at 0); short series get none.

    The shape value follows from position and length, so the cosine is three
    sums per shape and a long series never has to sit in one array.
    """
    placed = ordered(df, keys, order, tie, position=True).withColumn("t", F.try_divide(F.col("pos") - 1, F.col("n") - 1))
    curves = placed.withColumns({f"c_{code}": F.expr(curve) for _, code, curve in ARCS})
    sums = [F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("xx")]
    for _, code, _ in ARCS:
        c = F.col(f"c_{code}")
        sums += [F.sum(F.col(value) * c).alias(f"x_{code}"), F.sum(c * c).alias(f"cc_{code}")]
    totals = curves.groupBy(*keys).agg(*sums)
    # Rounded to 4 places before the best is taken; earlier shapes win ties.
    scored = [
        F.struct(
            F.round(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(f"x_{code}"), F.sqrt("xx") * F.sqrt(f"cc_{code}")), F.lit(0.0))), 4).alias("s"),
            F.lit(-i).alias("o"), F.lit(name).alias("name"), F.lit(code).alias("code"),
        )
        for i, (name, code, _) in enumerate(ARCS)
    ]
    best = totals.withColumn("b", F.greatest(*scored))
    short = F.col("n") < 3
    return best.select(
        *keys, "n", F.when(short, "Unknown").otherwise(F.col("b.name")).alias("arc"), F.when(short, "UK").otherwise(F.col("b.code")).alias("code"),
        F.when(short, 0.0).otherwise(F.col("b.s")).alias("confidence"),
    )


def direction_agreement(df: DataFrame, keys: Sequence[str], order: str, a: str, b: str, tie: Sequence[str] = (), tiny: float = 1e-6) -> DataFrame:
    """Share of steps where two series move the same way; second share skips
    steps where both stand still."""
    walked = ordered(df, keys, order, tie, prev=[a, b]).where(F.col("prev").isNotNull())
    da, db = F.col(a) - F.col(f"prev.{a}"), F.col(b) - F.col(f"prev.{b}")
    same = (F.signum(da) == F.signum(db)).cast("double")
    moved = (F.abs(da) >= tiny) | (F.abs(db) >= tiny)
    return walked.groupBy(*keys).agg(F.count("*").alias("steps"), F.avg(same).alias("agreement"), F.avg(F.when(moved, same)).alias("agreement_moving"))

"""Resampling operators: seeded draws; those of exact size have a SQL twin."""

import math

from pyspark.sql import functions as F

from corpusgauge.functions.common import rnd
from corpusgauge.operators import draws as dr
from corpusgauge.operators import resampling as rs
from corpusgauge.registry import query
from corpusgauge.sources.tables import busy_table, table


def _orders(spark, sf):
    return busy_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("sta15_permutation_test")
def sta15(spark, sf):
    df = _orders(spark, sf).where(F.col("o_orderstatus").isin("F", "O"))
    return dr.permutation_test(df, F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_totalprice"))


def _placed_sql(rows: str, key: str, draws: int, seed: int) -> str:
    """Every row with its hash ``h`` in every draw."""
    own = dr.mixed_sql(dr.mixed_sql(rows, f"({key} >> 32) & 4294967295", "hi"), f"xor(({key} & 4294967295)::UBIGINT, hi::UBIGINT)", "own")
    salt = dr.mixed_sql(dr.mixed_sql(f"SELECT range AS draw FROM range(0, {draws})", f"{seed}", "s"), "xor(draw::UBIGINT, s::UBIGINT)", "salt")
    return dr.mixed_sql(f"SELECT * FROM ({own}), ({salt})", "xor(own, salt)", "h")


@query(
    "sta15_permutation_segments",
    f"""
    WITH x AS (SELECT c_custkey AS k, c_mktsegment = 'BUILDING' AS a, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a) AS n_a, sum(v) AS s, sum(v) FILTER (WHERE a) AS s_a FROM x),
    o AS (SELECT *, s_a / n_a - (s - s_a) / (n - n_a) AS difference FROM t),
    r AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY h, k, v) AS place FROM ({_placed_sql("SELECT k, v FROM x", "k", 10_000, 1)})),
    d AS (SELECT draw, sum(v) / any_value(n_a) - (any_value(s) - sum(v)) / any_value(n - n_a) AS d FROM r, t WHERE place <= n_a GROUP BY draw)
    SELECT n_a, n - n_a AS n_b, round(difference, 6) AS difference, round((count(*) FILTER (WHERE abs(d) >= abs(difference) * (1 - 1e-12)) + 1) / (count(*) + 1), 9) AS p, round(avg(d), 6) AS null_mean, round(stddev_samp(d), 6) AS null_std
    FROM d, o GROUP BY n_a, n, difference
    """,
)
def sta15_segments(spark, sf):
    df = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    out = dr.permutation_test(df, F.col("c_custkey"), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    return out.withColumns({c: rnd(c, 6) for c in ("difference", "null_mean", "null_std")}).withColumn("p", rnd("p", 9))


# A row's Poisson(1) weight is the number of steps of the distribution function that its hash reaches.
_STEPS = [math.ceil(step * 2**32) for step in rs._poisson_steps() if math.ceil(step * 2**32) < 2**32]
_WEIGHT = " + ".join(f"(h >= {step})::INTEGER" for step in _STEPS)


def _weighted_sql(rows: str, reps: int, seed: int) -> str:
    return f"SELECT draw, grp, sum(w) AS w, sum(w * v) AS ws FROM (SELECT *, {_WEIGHT} AS w FROM ({_placed_sql(rows, 'k', reps, seed)})) GROUP BY ALL"


@query(
    "sta16_bootstrap_means",
    f"""
    WITH x AS (SELECT o_orderkey AS k, o_orderpriority AS grp, o_totalprice AS v FROM orders), m AS (SELECT grp, ws / w AS m FROM ({_weighted_sql("SELECT * FROM x", 1000, 2)}) WHERE w > 0),
    r AS (SELECT grp, count(*) AS "rows", avg(v) AS mean FROM x GROUP BY 1), q AS (SELECT grp, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
    SELECT grp, "rows", round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM q JOIN r USING (grp)
    """,
)
def sta16(spark, sf):
    out = rs.bootstrap_means(_orders(spark, sf), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"))
    return out.withColumns({c: rnd(c, 6) for c in ("mean", "low", "high")})


@query(
    "sta16_bootstrap_difference",
    f"""
    WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS grp, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    d AS (SELECT draw, sum(ws) FILTER (WHERE grp = 'F') / sum(w) FILTER (WHERE grp = 'F') - sum(ws) FILTER (WHERE grp = 'O') / sum(w) FILTER (WHERE grp = 'O') AS d FROM ({_weighted_sql("SELECT * FROM x", 1000, 3)}) GROUP BY 1),
    r AS (SELECT avg(v) FILTER (WHERE grp = 'F') - avg(v) FILTER (WHERE grp = 'O') AS difference FROM x)
    SELECT round(difference, 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d, r GROUP BY difference
    """,
)
def sta16_difference(spark, sf):
    df = _orders(spark, sf).where(F.col("o_orderstatus").isin("F", "O"))
    out = rs.bootstrap_difference(df, F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return out.withColumns({c: rnd(c, 6) for c in ("difference", "low", "high")})


_BEST_SQL = """b AS (SELECT {extra}draw, arg_max(grp, {{'m': m, 'g': grp}}) AS grp, max(m) AS best FROM m GROUP BY ALL),
    t AS (SELECT {extra}count(*) AS reps FROM b GROUP BY ALL)
    SELECT {extra}grp, count(*) AS wins, round(avg(best), 6) AS mean, round(coalesce(stddev_samp(best), 0), 6) AS std, round(count(*) / any_value(reps), 9) AS share FROM b {join} GROUP BY ALL"""


def _best_rounded(out):
    return out.withColumns({"mean": rnd("mean", 6), "std": rnd("std", 6), "share": rnd("share", 9)})


@query(
    "sta16_bootstrap_best_config",
    f"""
    WITH m AS (SELECT draw, grp, ws / w AS m FROM ({_weighted_sql("SELECT o_orderkey AS k, o_orderpriority AS grp, o_totalprice AS v FROM orders", 200, 8)}) WHERE w > 0),
    {_BEST_SQL.format(extra="", join="CROSS JOIN t")}
    """,
)
def sta16_best(spark, sf):
    sums = rs.replicate_sums(_orders(spark, sf), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"), 200, 8, "bootstrap")
    return _best_rounded(rs.best_share(sums))


SIZES = (10, 20, 30, 50)


@query(
    "sta18_size_sensitivity",
    f"""
    WITH s AS (SELECT unnest([{", ".join(map(str, SIZES))}]) AS size, generate_subscripts([{", ".join(map(str, SIZES))}], 1) - 1 AS at), x AS (SELECT o_orderkey AS k, o_orderstatus AS grp, o_orderpriority AS config, o_totalprice AS v FROM orders),
    r AS (SELECT grp, draw, size, config, v, row_number() OVER (PARTITION BY grp, draw ORDER BY h, k, v) AS place, count(*) OVER (PARTITION BY grp, draw) AS n FROM ({_placed_sql("SELECT * FROM x", "k", 20 * len(SIZES), 4)}) JOIN s ON s.at = draw // 20),
    m AS (SELECT grp, size, draw, config, avg(v) AS m FROM r WHERE place <= size AND n >= size GROUP BY ALL), b AS (SELECT grp, size, draw, max(m) AS best, arg_max(config, {{'m': m, 'c': config}}) AS config FROM m GROUP BY ALL)
    SELECT grp, size, count(*) AS repeats, round(avg(best), 6) AS mean_best, round(stddev_pop(best), 6) AS std_best, count(DISTINCT config) AS best_configs FROM b GROUP BY ALL
    """,
)
def sta18(spark, sf):
    out = dr.size_sensitivity(_orders(spark, sf), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice"), SIZES)
    return out.withColumns({c: rnd(c, 6) for c in ("mean_best", "std_best")})


SPREADS = (1000.0, 10000.0, 50000.0)


def _noise_sql(level: int, spread: float) -> str:
    rows = "SELECT o_orderkey AS k, o_orderpriority AS grp, o_totalprice AS v FROM orders"
    first, second = (_placed_sql(rows, "k", 20, 5 + level + step) for step in (7919, 104729))
    normal = "sqrt(-2 * ln(1 - a.h / 4294967296.0::DOUBLE)) * cos(2 * pi() * (b.h / 4294967296.0::DOUBLE))"
    return f"SELECT {spread}::DOUBLE AS level, draw, a.grp, avg(a.v + {spread} * {normal}) AS m FROM ({first}) a JOIN ({second}) b USING (draw, k) GROUP BY ALL"


@query(
    "sta18_noise_sensitivity",
    f"""
    WITH m AS ({" UNION ALL ".join(_noise_sql(i, s) for i, s in enumerate(SPREADS))}),
    {_BEST_SQL.format(extra="level, ", join="JOIN t USING (level)")}
    """,
)
def sta18_noise(spark, sf):
    return _best_rounded(rs.noise_sensitivity(_orders(spark, sf), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"), SPREADS))


@query(
    "txt8_shuffle_baseline",
    f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
    p AS (SELECT label, draw AS rep, vec_id, lead(vec_id) OVER (PARTITION BY label, draw ORDER BY h, vec_id) AS other FROM ({_placed_sql("SELECT vec_id, label FROM embeddings", "vec_id", 50, 6)})
      UNION ALL SELECT label, -1, vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) FROM embeddings),
    s AS (SELECT p.label, rep, avg(CASE WHEN a.len * b.len = 0 THEN 0 ELSE list_dot_product(a.x, b.x) / (a.len * b.len) END) AS s FROM p JOIN e a ON a.vec_id = p.vec_id JOIN e b ON b.vec_id = p.other GROUP BY ALL),
    o AS (SELECT label, s AS original FROM s WHERE rep = -1),
    r AS (SELECT label, original, avg(s) AS random_mean, stddev_pop(s) AS random_std, avg(CASE WHEN s >= original THEN 1.0 ELSE 0.0 END) AS p_value, count(*) AS reps FROM s JOIN o USING (label) WHERE rep >= 0 GROUP BY ALL)
    SELECT label, round(original, 9) AS original, round(random_mean, 9) AS random_mean, round(random_std, 9) AS random_std, round(p_value, 9) AS p_value, reps,
      round((original - random_mean) / nullif(random_std, 0), 6) AS effect_size, round(100 * (original - random_mean) / nullif(random_mean, 0), 4) AS improvement_pct FROM r
    """,
)
def txt8(spark, sf):
    out = rs.shuffle_baseline(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    places = {"original": 9, "random_mean": 9, "random_std": 9, "p_value": 9, "effect_size": 6, "improvement_pct": 4}
    return out.withColumns({c: rnd(c, n) for c, n in places.items()})

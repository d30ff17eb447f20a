"""Tests, effect sizes and rank statistics on the driver tables."""

from functools import reduce

from pyspark.sql import functions as F

from corpusgauge.functions.common import attach, corr, ratio, rnd, scalar
from corpusgauge.functions.tails import p_chi2, p_f, p_normal, p_t
from corpusgauge.operators import aggregates as agg
from corpusgauge.operators import inference as inf
from corpusgauge.operators import joins
from corpusgauge.plans.ordered import attach_ranks, quantiles
from corpusgauge.registry import query
from corpusgauge.session import written
from corpusgauge.sources.tables import table


def _round(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


def _arms(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    status = F.col("o_orderstatus")
    return df, status == "F", status == "O"


_ARMS_SQL = """
    a AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v1,
      count(*) FILTER (WHERE o_orderstatus = 'O') AS n2, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS v2 FROM orders GROUP BY 1)
"""


@query(
    "sta1_two_sample_t",
    f"""WITH {_ARMS_SQL} SELECT o_orderpriority, n1, n2, round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2) * (1/n1 + 1/n2)), 7) + 0.0 AS t_pooled, round((m1 - m2) / sqrt(v1/n1 + v2/n2), 7) + 0.0 AS t_welch,
      round((v1/n1 + v2/n2)**2 / ((v1/n1)**2/(n1-1) + (v2/n2)**2/(n2-1)), 4) AS df_welch FROM a""",
)
def sta1(spark, sf):
    df, is_a, is_b = _arms(spark, sf)
    arms = inf.two_arms(df, ["o_orderpriority"], is_a, is_b, "o_totalprice")
    t = inf.t_statistics()
    return arms.select("o_orderpriority", "n1", "n2", rnd(t["t_pooled"], 7).alias("t_pooled"), rnd(t["t_welch"], 7).alias("t_welch"), rnd(t["df_welch"], 4).alias("df_welch"))


@query(
    "sta1_paired_t",
    """
    WITH b AS (SELECT user_id, avg(value) AS base FROM events WHERE event_type = 'view' GROUP BY 1), d AS (SELECT event_type, value - base AS d FROM events JOIN b USING (user_id) WHERE event_type <> 'view')
    SELECT event_type, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 7) + 0.0 AS t FROM d GROUP BY 1
    """,
)
def sta1_paired(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "value")
    pairs = joins.paired_delta(df, ["user_id"], F.col("event_type") == "view", "value")
    return pairs.groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.avg("delta") / (F.stddev_samp("delta") / F.sqrt(F.count("*"))), 7).alias("t"))


@query(
    "sta1_one_sample_t",
    """
    WITH o AS (SELECT user_id, max(value) AS best FROM events GROUP BY 1),
    s AS (SELECT e.user_id, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, any_value(best) AS best FROM events e JOIN o USING (user_id) GROUP BY 1)
    SELECT user_id, n, n - 1 AS df, round(CASE WHEN sd > 0 THEN (mean - best) / (sd / sqrt(n)) END, 7) + 0.0 AS t FROM s
    """,
)
def sta1_one_sample(spark, sf):
    # A group's best value stands alone, so its group is tested against it as a fixed mean.
    df = table(spark, sf, "events").select("user_id", "value")
    return inf.one_sample_t(df, ["user_id"], "value", F.max("value")).select("user_id", "n", "df", rnd("t", 7).alias("t"))


@query("sta1_p_values")
def sta1_p(spark, sf):
    df, is_a, is_b = _arms(spark, sf)
    arms = inf.two_arms(df, ["o_orderpriority"], is_a, is_b, "o_totalprice")
    rows = arms.select("o_orderpriority", *[c.alias(n) for n, c in inf.t_statistics().items()])
    spread = inf.levene(df.where(is_a | is_b), ["o_orderpriority"], "o_orderstatus", "o_totalprice")
    rows = rows.join(spread.select("o_orderpriority", "f", "df1", "df2"), "o_orderpriority")
    rows = rows.withColumns({"p_pooled": p_t("t_pooled", "df_pooled"), "p_welch": p_t("t_welch", "df_welch"), "p_levene": p_f("f", F.col("df1").cast("double"), F.col("df2").cast("double"))})
    # Equal variances (Levene) decide which test counts.
    chosen = F.when(F.col("p_levene") > 0.05, F.col("p_pooled")).otherwise(F.col("p_welch"))
    return rows.select("o_orderpriority", "p_pooled", "p_welch", "p_levene", chosen.alias("p"), (chosen < 0.05).alias("significant"))


_RANK_SQL = """
    x AS (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS r, count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) AS t FROM x),
    s AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS nb, sum(r) FILTER (WHERE o_orderstatus = 'F') AS ra, sum(t * t - 1) AS tie FROM r GROUP BY 1)
"""


def _rank_sums(spark, sf):
    df, is_a, is_b = _arms(spark, sf)
    return inf.mann_whitney(inf.rank_sums(df, ["o_orderpriority"], "o_totalprice", {"a": is_a, "b": is_b}))


@query(
    "sta2_mann_whitney",
    f"""WITH {_RANK_SQL}, u AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM s)
    SELECT o_orderpriority, u, round(greatest(abs(u - na * nb / 2) - .5, 0) / sqrt(na * nb / 12 * ((n + 1) - tie / (n * (n - 1)))), 7) AS z FROM u""",
)
def sta2(spark, sf):
    return _rank_sums(spark, sf).select("o_orderpriority", "u", rnd("z", 7).alias("z"))


@query(
    "sta2_mann_whitney_p",
)
def sta2_p(spark, sf):
    return _rank_sums(spark, sf).select("o_orderpriority", "u", "z", p_normal("z").alias("p"))


def _anova_sql(source: str, key: str, group: str, value: str) -> str:
    return (
        f"c AS (SELECT {key}, {group}, count(*) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {source} GROUP BY ALL), "
        f"g AS (SELECT {key}, sum(n) AS t, count(*) AS k, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM c GROUP BY {key})"
    )


@query(
    "sta3_one_way_anova",
    f"WITH {_anova_sql('lineitem', 'l_linestatus', 'l_returnflag', 'l_quantity')} SELECT l_linestatus, round((b / (k - 1)) / (w / (t - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(t - k AS BIGINT) AS df2, round(b / (b + w), 9) AS eta_squared FROM g",
)
def sta3(spark, sf):
    cells = inf.group_moments(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity")
    out = inf.one_way_anova(cells, ["l_linestatus"])
    return out.select("l_linestatus", rnd("f").alias("f"), "df1", "df2", rnd("eta_squared", 9).alias("eta_squared"))


@query(
    "sta5_kruskal_wallis",
    """
    WITH r AS (SELECT l_linestatus, l_returnflag, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2 AS r, count(*) OVER (PARTITION BY l_linestatus, l_quantity) AS t FROM lineitem),
    g AS (SELECT l_linestatus, l_returnflag, sum(r) AS rs, count(*) AS ng FROM r GROUP BY ALL), q AS (SELECT l_linestatus, sum(rs * rs / ng) AS q, count(*) AS k FROM g GROUP BY 1),
    s AS (SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n, CAST(sum(t * t - 1) AS DOUBLE) AS tie FROM r GROUP BY 1)
    SELECT l_linestatus, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 5) AS h, k - 1 AS df FROM s JOIN q USING (l_linestatus)
    """,
)
def sta5(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    return inf.kruskal_wallis(df, ["l_linestatus"], "l_returnflag", "l_quantity").select("l_linestatus", rnd("h", 5).alias("h"), "df")


@query(
    "sta6_levene",
    f"WITH m AS (SELECT l_linestatus, l_returnflag, quantile_cont(l_extendedprice, .5) AS med FROM lineitem GROUP BY ALL), x AS (SELECT l.l_linestatus, l.l_returnflag, abs(l_extendedprice - med) AS d FROM lineitem l JOIN m USING (l_linestatus, l_returnflag)), {_anova_sql('x', 'l_linestatus', 'l_returnflag', 'd')} SELECT l_linestatus, round((b / (k - 1)) / (w / (t - k)), 6) AS f FROM g",
)
def sta6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return inf.levene(df, ["l_linestatus"], "l_returnflag", "l_extendedprice").select("l_linestatus", rnd("f").alias("f"))


@query("sta_group_test_p_values")
def sta_group_p(spark, sf):
    """p-values of ANOVA, Kruskal-Wallis and Levene for the same grouping."""
    df = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    key = ["l_linestatus"]
    d = lambda c: F.col(c).cast("double")
    a = inf.one_way_anova(inf.group_moments(df, key, "l_returnflag", "l_quantity"), key).select(*key, p_f("f", d("df1"), d("df2")).alias("p_anova"))
    k = inf.kruskal_wallis(df, key, "l_returnflag", "l_quantity").select(*key, p_chi2("h", d("df")).alias("p_kruskal"))
    v = inf.levene(df, key, "l_returnflag", "l_quantity").select(*key, p_f("f", d("df1"), d("df2")).alias("p_levene"))
    return a.join(k, key).join(v, key)


@query(
    "sta7_contingency",
    """
    WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderstatus, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT o_orderpriority, sum(n) AS k FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
    x AS (SELECT r.o_orderstatus, k.o_orderpriority, coalesce(n, 0) AS n, r.r * k.k / t AS e FROM r CROSS JOIN k LEFT JOIN c USING (o_orderstatus, o_orderpriority), t)
    SELECT o_orderstatus, o_orderpriority, n, round(e, 7) AS expected, round((SELECT sum((n - e) * (n - e) / e) FROM x), 7) AS chi2 FROM x
    """,
)
def sta7(spark, sf):
    cells = inf.contingency(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")
    total = attach(cells, inf.chi_square(cells), "x")
    return total.select("o_orderstatus", "o_orderpriority", "n", rnd("expected", 7).alias("expected"), rnd("x.chi2", 7).alias("chi2"))


@query(
    "sta7_top_share_fit",
    """
    WITH top AS (SELECT o_orderpriority FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000)), t AS (SELECT o_orderpriority, count(*) AS n FROM top GROUP BY 1), a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
    x AS (SELECT a.o_orderpriority, coalesce(t.n, 0) AS n, a.n / (SELECT count(*) FROM orders) * (SELECT count(*) FROM top) AS e FROM a LEFT JOIN t USING (o_orderpriority))
    SELECT o_orderpriority, n, round(e, 7) AS expected, round((SELECT sum((n - e) * (n - e) / e) FROM x), 7) AS chi2 FROM x
    """,
)
def sta7_fit(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    top = df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000).groupBy("o_orderpriority").agg(F.count("*").alias("top_n"))
    both = df.groupBy("o_orderpriority").agg(F.count("*").alias("all_n")).join(top, "o_orderpriority", "left").withColumn("n", F.coalesce("top_n", F.lit(0)))
    sums = both.agg(F.sum("n").alias("n"), F.sum("all_n").alias("a"))
    cells = attach(both, sums, "s").select("o_orderpriority", "n", (F.col("all_n") / F.col("s.a") * F.col("s.n")).alias("expected"))
    out = attach(cells, inf.chi_square(cells), "x")
    return out.select("o_orderpriority", "n", rnd("expected", 7).alias("expected"), rnd("x.chi2", 7).alias("chi2"))


_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(source: str, prefix: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, corr({prefix}{a}, {prefix}{b}) AS {value} FROM {source}" for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]
    )


@query(
    "sta8_correlations",
    "WITH r AS (SELECT *, "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rank_{c}" for c in _METRICS)
    + f" FROM lineitem), p AS ({_pairs_sql('lineitem', '', 'pearson')}), s AS ({_pairs_sql('r', 'rank_', 'spearman')}) "
    + """SELECT metric_a, metric_b, round(pearson, 8) + 0.0 AS pearson, round(spearman, 8) + 0.0 AS spearman,
      CASE WHEN abs(pearson) >= .7 THEN 'strong' WHEN abs(pearson) >= .4 THEN 'moderate' WHEN abs(pearson) >= .2 THEN 'weak' ELSE 'none' END AS strength FROM p JOIN s USING (metric_a, metric_b)""",
)
def sta8(spark, sf):
    df = table(spark, sf, "lineitem").select(*_METRICS)
    pearson = inf.correlation_rows(df, _METRICS).withColumnRenamed("r", "pearson")
    # Columns are pre-combined: equal rows count once before ranks are joined.
    ranked = attach_ranks(df, [], {c: f"rank_{c}" for c in _METRICS})
    spearman = inf.correlation_rows(ranked, _METRICS, "rank_").withColumnRenamed("r", "spearman")
    r = F.abs("pearson")
    strength = F.when(r >= 0.7, "strong").when(r >= 0.4, "moderate").when(r >= 0.2, "weak").otherwise("none")
    return _round(pearson.join(spearman, ["metric_a", "metric_b"]).withColumn("strength", strength), 8, "pearson", "spearman")


@query(
    "sta10_linear_trend",
    """
    WITH e AS (SELECT event_type, value AS y, CAST(json_extract(props, '$.k') AS DOUBLE) AS x FROM events)
    SELECT event_type, count(*) AS n, round(regr_slope(y, x), 8) + 0.0 AS slope, round(regr_intercept(y, x), 7) + 0.0 AS intercept, round(regr_r2(y, x), 9) AS r2,
      round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 9) AS slope_error FROM e GROUP BY 1
    """,
)
def sta10(spark, sf):
    df = table(spark, sf, "events").select("event_type", F.col("value").alias("y"), F.from_json("props", "k double")["k"].alias("x"))
    sxx, sxy, syy = F.regr_sxx("y", "x"), F.regr_sxy("y", "x"), F.regr_syy("y", "x")
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"), rnd(F.regr_slope("y", "x"), 8).alias("slope"), rnd(F.regr_intercept("y", "x"), 7).alias("intercept"), rnd(F.regr_r2("y", "x"), 9).alias("r2"),
        rnd(F.sqrt((syy - sxy * sxy / sxx) / (F.count("*") - 2) / sxx), 9).alias("slope_error"),
    )


@query(
    "sta13_effect_sizes",
    f"""WITH {_ARMS_SQL}, {_RANK_SQL}, d AS (SELECT o_orderpriority, (m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)) AS d1, (m1 - m2) / sqrt((v1 + v2) / 2) AS d2, 2 * (ra - na * (na + 1) / 2) / (na * nb) - 1 AS cl FROM a JOIN s USING (o_orderpriority))
    SELECT o_orderpriority, round(d1, 8) + 0.0 AS d_pooled, round(d2, 8) + 0.0 AS d_mean_variance, round(cl, 8) + 0.0 AS cliff, CASE WHEN abs(d1) < .2 THEN 'negligible' WHEN abs(d1) < .5 THEN 'small' WHEN abs(d1) < .8 THEN 'medium' ELSE 'large' END AS d_band,
      CASE WHEN abs(cl) < .147 THEN 'negligible' WHEN abs(cl) < .33 THEN 'small' WHEN abs(cl) < .474 THEN 'medium' ELSE 'large' END AS cliff_band FROM d""",
)
def sta13(spark, sf):
    df, is_a, is_b = _arms(spark, sf)
    d = inf.two_arms(df, ["o_orderpriority"], is_a, is_b, "o_totalprice").select("o_orderpriority", inf.cohens_d().alias("d_pooled"), inf.cohens_d("mean").alias("d_mean_variance"))
    out = d.join(_rank_sums(spark, sf).select("o_orderpriority", "cliff"), "o_orderpriority")
    # Fixed band limits of d and of Cliff's delta.
    out = out.withColumns({"d_band": inf.effect_band(F.col("d_pooled"), (0.2, 0.5, 0.8)), "cliff_band": inf.effect_band(F.col("cliff"), (0.147, 0.33, 0.474))})
    return _round(out, 8, "d_pooled", "d_mean_variance", "cliff")


@query(
    "sta14_multiple_tests",
    """
    WITH p AS (SELECT event_type, user_id, count(*) FILTER (WHERE value > 60) / count(*) AS p FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM p)
    SELECT event_type, user_id, round(p, 9) AS p, round(least(1, max(p * (n - i + 1)) OVER (PARTITION BY event_type ORDER BY i)), 9) + 0.0 AS holm, round(least(1, min(p * n / i) OVER (PARTITION BY event_type ORDER BY i DESC)), 9) + 0.0 AS bh, round(least(1, p * n), 9) + 0.0 AS bonferroni FROM r
    """,
)
def sta14(spark, sf):
    # Shares in 0..1 per user stand for a table of p-values.
    p = table(spark, sf, "events").groupBy("event_type", "user_id").agg(ratio(F.count_if(F.col("value") > 60), F.count("*")).alias("p"))
    return _round(inf.holm_bh(p, ["event_type"], "p", "user_id"), 9, "p", "holm", "bh", "bonferroni")


@query(
    "sta22_outliers",
    """
    WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, .25) AS a, quantile_cont(l_extendedprice, .75) AS b, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    o AS (SELECT l.l_returnflag, l_extendedprice AS x, l_extendedprice < a - .5 * (b - a) OR l_extendedprice > b + .5 * (b - a) AS fence, abs(l_extendedprice - m) / s > 1.7 AS z FROM lineitem l JOIN q USING (l_returnflag))
    SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE fence) AS n_fence, count(*) FILTER (WHERE z) AS n_z, round(count(*) FILTER (WHERE fence) / count(*), 9) AS fence_rate, round(avg(x), 5) AS mean_all, round(avg(x) FILTER (WHERE NOT fence), 5) AS mean_clean,
      round(stddev_samp(x) FILTER (WHERE NOT fence), 5) AS std_clean FROM o GROUP BY 1
    """,
)
def sta22(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    spread = df.groupBy("l_returnflag").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    # Written, so that its size is known and the rows need not be sorted by their few groups.
    limits = written(quantiles(df, ["l_returnflag"], "x", {"a": 0.25, "b": 0.75}).drop("n").join(spread, "l_returnflag"), "limits")
    x, gap = F.col("x"), F.col("b") - F.col("a")
    marked = df.join(limits, "l_returnflag").withColumns({"fence": (x < F.col("a") - 0.5 * gap) | (x > F.col("b") + 0.5 * gap), "z": F.abs(x - F.col("m")) / F.col("s") > 1.7})
    clean = F.when(~F.col("fence"), x)
    return marked.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if("fence").alias("n_fence"), F.count_if("z").alias("n_z"), rnd(F.count_if("fence") / F.count("*"), 9).alias("fence_rate"),
        rnd(F.avg(x), 5).alias("mean_all"), rnd(F.avg(clean), 5).alias("mean_clean"), rnd(F.stddev_samp(clean), 5).alias("std_clean"),
    )


@query(
    "sta33_stratified_effect",
    f"""WITH q AS (SELECT quantile_cont(o_custkey, .25) AS a, quantile_cont(o_custkey, .5) AS b, quantile_cont(o_custkey, .75) AS c FROM orders),
    y AS (SELECT CASE WHEN o_custkey <= a THEN 1 WHEN o_custkey <= b THEN 2 WHEN o_custkey <= c THEN 3 ELSE 4 END AS stratum, o_orderstatus AS st, o_totalprice AS x FROM orders, q WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY x) + (count(*) OVER (PARTITION BY stratum, x) - 1) / 2 AS r FROM y),
    s AS (SELECT stratum, CAST(count(*) FILTER (WHERE st = 'F') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE st = 'O') AS DOUBLE) AS nb, sum(r) FILTER (WHERE st = 'F') AS ra, avg(x) FILTER (WHERE st = 'F') AS m1, avg(x) FILTER (WHERE st = 'O') AS m2, var_samp(x) FILTER (WHERE st = 'F') AS v1, var_samp(x) FILTER (WHERE st = 'O') AS v2 FROM r GROUP BY 1)
    SELECT stratum, round(m1, 5) AS mean_a, round(m2, 5) AS mean_b, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 8) + 0.0 AS cliff, round((m1 - m2) / sqrt(v1/na + v2/nb), 7) + 0.0 AS t FROM s""",
)
def sta33(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    cut = attach(df, quantiles(df, [], "o_custkey", {"a": 0.25, "b": 0.5, "c": 0.75}), "q")
    k = F.col("o_custkey")
    stratum = F.when(k <= F.col("q.a"), 1).when(k <= F.col("q.b"), 2).when(k <= F.col("q.c"), 3).otherwise(4)
    rows = cut.select(stratum.alias("stratum"), "o_orderstatus", "o_totalprice")
    is_a, is_b = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    t = inf.two_arms(rows, ["stratum"], is_a, is_b, "o_totalprice").select("stratum", "m1", "m2", inf.t_statistics()["t_welch"].alias("t"))
    cliff = inf.mann_whitney(inf.rank_sums(rows, ["stratum"], "o_totalprice", {"a": is_a, "b": is_b})).select("stratum", "cliff")
    return t.join(cliff, "stratum").select("stratum", rnd("m1", 5).alias("mean_a"), rnd("m2", 5).alias("mean_b"), rnd("cliff", 8).alias("cliff"), rnd("t", 7).alias("t"))


@query(
    "sta32_validity",
    """
    WITH j AS (SELECT 'all' AS subset, quality, n_chars FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, quality, n_chars FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY quality) + (count(*) OVER (PARTITION BY subset, quality) - 1) / 2 AS ra, rank() OVER (PARTITION BY subset ORDER BY n_chars) + (count(*) OVER (PARTITION BY subset, n_chars) - 1) / 2 AS rb FROM j)
    SELECT subset, count(*) AS n, nullif(round(corr(quality, n_chars), 8) + 0.0, 'NaN'::DOUBLE) AS pearson, nullif(round(corr(ra, rb), 8) + 0.0, 'NaN'::DOUBLE) AS spearman, round(quantile_cont(n_chars, .75) FILTER (WHERE quality = 1), 6) AS good_from, round(quantile_cont(n_chars, .25) FILTER (WHERE quality = 0), 6) AS poor_to FROM r GROUP BY 1
    """,
)
def sta32(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    joined = table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")
    rows = joined.select(F.explode(F.array(F.lit("all"), "lang")).alias("subset"), "doc_id", "quality", "n_chars")
    ranked = attach_ranks(rows, ["subset"], {"quality": "ra", "n_chars": "rb"})
    r = ranked.groupBy("subset").agg(F.count("*").alias("n"), corr("quality", "n_chars").alias("pearson"), corr("ra", "rb").alias("spearman"))
    good = quantiles(rows.where("quality = 1"), ["subset"], "n_chars", {"good_from": 0.75}).drop("n")
    poor = quantiles(rows.where("quality = 0"), ["subset"], "n_chars", {"poor_to": 0.25}).drop("n")
    out = r.join(good, "subset", "left").join(poor, "subset", "left")
    return _round(out, 8, "pearson", "spearman", "good_from", "poor_to")


@query(
    "sta32_expected_score",
    """
    WITH g AS (SELECT source, avg(quality) AS q, avg(n_chars) AS x FROM labels JOIN documents USING (doc_id) GROUP BY 1), o AS (SELECT *, lag(x) OVER (ORDER BY x, source) AS px, lag(q) OVER (ORDER BY x, source) AS pq FROM g)
    SELECT source, round(x, 6) AS auto, round(CASE WHEN px IS NULL THEN q ELSE (pq + q) / 2 END, 9) AS expected_at_midpoint FROM o
    """,
)
def sta32_expected(spark, sf):
    from corpusgauge.plans.ordered import ordered

    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    g = table(spark, sf, "labels").join(docs, "doc_id").groupBy("source").agg(F.avg("quality").alias("q"), F.avg("n_chars").alias("x"))
    walked = ordered(g, [], "x", prev=["q"])
    mid = F.when(F.col("prev").isNull(), F.col("q")).otherwise((F.col("prev.q") + F.col("q")) / 2)
    return walked.select("source", rnd("x").alias("auto"), rnd(mid, 9).alias("expected_at_midpoint"))

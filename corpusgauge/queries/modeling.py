"""Models, reliability, composites and experiment comparisons."""

from pyspark.sql import functions as F

from corpusgauge.functions.common import attach, corr, ratio, rnd, scalar
from corpusgauge.operators import inference as inf
from corpusgauge.operators import modeling as mod
from corpusgauge.operators.aggregates import corrected_kurtosis, corrected_skew, top_k
from corpusgauge.plans.ordered import attach_ranks, ordered
from corpusgauge.registry import query
from corpusgauge.sources.tables import table

CONFIG = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _round(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("sta4_factorial_anova")
def sta4(spark, sf):
    return mod.factorial_anova(_lines(spark, sf).select(*CONFIG, "l_quantity"), CONFIG, "l_quantity")


@query(
    "sta4_marginal_ss",
    "WITH t AS (SELECT avg(l_quantity) AS g FROM lineitem), "
    + "m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS factor, CAST({c} AS VARCHAR) AS level, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY {c}" for c in CONFIG)
    + ") SELECT factor, count(*) AS levels, round(sum(n * (m - g) ** 2), 3) + 0.0 AS ss FROM m, t GROUP BY factor",
)
def sta4_marginal(spark, sf):
    f, s, n = (F.col(c) for c in CONFIG)
    df = _lines(spark, sf).select(*CONFIG, "l_quantity")
    # One scan serves all three factors.
    cells = df.groupingSets([[f], [s], [n], []], f, s, n).agg(F.grouping_id().alias("g"), F.count("*").alias("c"), F.avg("l_quantity").alias("m"))
    grand = scalar(cells.where("g = 7").select("m"))["m"]
    factor = F.when(F.col("g") == 3, "l_returnflag").when(F.col("g") == 5, "l_linestatus").otherwise("l_linenumber")
    return cells.where("g <> 7").groupBy(factor.alias("factor")).agg(F.count("*").alias("levels"), rnd(F.sum(F.col("c") * (F.col("m") - grand) ** 2), 3).alias("ss"))


@query(
    "sta9_partial_correlation",
    """
    WITH c AS (SELECT corr(l_extendedprice, l_tax) AS xy, corr(l_extendedprice, l_quantity) AS xa, corr(l_tax, l_quantity) AS ya, corr(l_extendedprice, l_discount) AS xb, corr(l_tax, l_discount) AS yb, corr(l_quantity, l_discount) AS ab FROM lineitem),
    d AS (SELECT (xy - xa * ya) / sqrt((1 - xa*xa) * (1 - ya*ya)) AS p, (xb - xa * ab) / sqrt((1 - xa*xa) * (1 - ab*ab)) AS q, (yb - ya * ab) / sqrt((1 - ya*ya) * (1 - ab*ab)) AS r, xy FROM c)
    SELECT round(xy, 9) + 0.0 AS raw, round((p - q * r) / sqrt((1 - q*q) * (1 - r*r)), 9) + 0.0 AS partial FROM d
    """,
)
def sta9(spark, sf):
    part = mod.partial_correlation("l_extendedprice", "l_tax", "l_quantity", "l_discount")
    return _lines(spark, sf).agg(rnd(corr("l_extendedprice", "l_tax"), 9).alias("raw"), rnd(part, 9).alias("partial"))


@query(
    "sta11_two_predictor_ols",
    """
    WITH x AS (SELECT l_linestatus, l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS a, l_quantity AS b FROM lineitem),
    s AS (SELECT l_linestatus, count(*) AS n, var_pop(a) AS s11, var_pop(b) AS s22, covar_pop(a, b) AS s12, covar_pop(a, y) AS s1, covar_pop(b, y) AS s2, var_pop(y) AS sy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY 1),
    f AS (SELECT *, (s22*s1 - s12*s2) / (s11*s22 - s12*s12) AS b1, (s11*s2 - s12*s1) / (s11*s22 - s12*s12) AS b2 FROM s)
    SELECT l_linestatus, n, round(b1, 5) + 0.0 AS system_effect, round(b2, 6) AS length_effect, round(my - b1*ma - b2*mb, 4) AS intercept, round((b1*s1 + b2*s2) / sy, 9) AS r2 FROM f
    """,
)
def sta11(spark, sf):
    df = _lines(spark, sf).select("l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("a"), F.col("l_quantity").alias("b"))
    fit = mod.two_predictor_ols("y", "a", "b")
    return df.groupBy("l_linestatus").agg(
        F.count("*").alias("n"), rnd(fit["b1"], 5).alias("system_effect"), rnd(fit["b2"]).alias("length_effect"), rnd(fit["b0"], 4).alias("intercept"), rnd(fit["r2"], 9).alias("r2")
    )


@query(
    "sta17_fold_check",
    """
    WITH x AS (SELECT l_orderkey % 5 AS fold, l_returnflag || l_linestatus AS config, l_quantity AS q FROM lineitem),
    s AS (SELECT fold, config, sum(q) AS s, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT config, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
    r AS (SELECT fold, config, (t.s - s.s) / (t.n - s.n) AS train, s.s / s.n AS test FROM s JOIN t USING (config))
    SELECT fold, arg_max(config, {'m': round(train, 9), 'c': config}) AS best, round(max(train), 9) AS train_mean, round(arg_max(test, {'m': round(train, 9), 'c': config}), 9) AS test_mean FROM r GROUP BY fold
    """,
)
def sta17(spark, sf):
    # Per-fold sums give every train set as total minus fold: no row is copied per fold.
    df = _lines(spark, sf).select((F.col("l_orderkey") % 5).alias("fold"), F.concat("l_returnflag", "l_linestatus").alias("config"), "l_quantity")
    s = df.groupBy("fold", "config").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    t = s.groupBy("config").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    r = s.join(t, "config").withColumns({"train": (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), "test": F.col("s") / F.col("n")})
    best = F.struct(rnd("train", 9), "config")
    return r.groupBy("fold").agg(F.max_by("config", best).alias("best"), rnd(F.max("train"), 9).alias("train_mean"), rnd(F.max_by("test", best), 9).alias("test_mean"))


@query(
    "sta19_best_vs_others",
    """
    WITH x AS (SELECT l_linestatus AS genre, l_returnflag || l_linenumber AS config, l_quantity AS q FROM lineitem), s AS (SELECT genre, config, count(*) AS n, avg(q) AS m, var_samp(q) AS v, sum(q) AS s, sum(q * q) AS ss FROM x GROUP BY ALL),
    b AS (SELECT genre, arg_max(config, {'m': round(m, 9), 'c': config}) AS best, arg_min(config, {'m': round(m, 9), 'c': config}) AS worst FROM s GROUP BY 1),
    o AS (SELECT b.genre, best, worst, max(n) FILTER (WHERE config = best) AS n1, max(m) FILTER (WHERE config = best) AS m1, max(v) FILTER (WHERE config = best) AS v1, sum(n) FILTER (WHERE config <> best) AS n2, sum(s) FILTER (WHERE config <> best) AS s2, sum(ss) FILTER (WHERE config <> best) AS ss2, max(m) FILTER (WHERE config = worst) AS mw FROM s JOIN b USING (genre) GROUP BY ALL),
    p AS (SELECT *, s2 / n2 AS m2, (ss2 - s2 * s2 / n2) / (n2 - 1) AS v2 FROM o)
    SELECT genre, best, worst, round(m1, 9) AS best_mean, round(m2, 9) AS others_mean, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((m1 - m2) / sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)), 8) AS d, round(100 * (m1 - m2) / m2, 7) AS pct, round(100 * (m1 - mw) / mw, 7) AS pct_vs_worst FROM p
    """,
)
def sta19(spark, sf):
    df = _lines(spark, sf).select(F.col("l_linestatus").alias("genre"), F.concat("l_returnflag", "l_linenumber").alias("config"), F.col("l_quantity").alias("q"))
    q = F.col("q")
    s = df.groupBy("genre", "config").agg(F.count("*").alias("n"), F.avg(q).alias("m"), F.var_samp(q).alias("v"), F.sum(q).alias("s"), F.sum(q * q).alias("ss"))
    key = F.struct(rnd("m", 9), "config")
    picks = s.groupBy("genre").agg(F.max_by("config", key).alias("best"), F.min_by("config", key).alias("worst"))
    is_best, is_worst = F.col("config") == F.col("best"), F.col("config") == F.col("worst")
    o = s.join(picks, "genre").groupBy("genre", "best", "worst").agg(
        *[F.max(F.when(is_best, F.col(c))).alias(f"{c}1") for c in ("n", "m", "v")], *[F.sum(F.when(~is_best, F.col(c))).alias(f"{c}2") for c in ("n", "s", "ss")],
        F.max(F.when(is_worst, F.col("m"))).alias("mw"),
    )
    o = o.withColumn("m2", F.col("s2") / F.col("n2")).withColumn("v2", (F.col("ss2") - F.col("s2") ** 2 / F.col("n2")) / (F.col("n2") - 1))
    m1, m2, mw = F.col("m1"), F.col("m2"), F.col("mw")
    return o.select(
        "genre", "best", "worst", rnd(m1, 9).alias("best_mean"), rnd(m2, 9).alias("others_mean"), rnd(inf.t_statistics()["t_welch"]).alias("t"), rnd(inf.cohens_d(), 8).alias("d"),
        rnd(100 * (m1 - m2) / m2, 7).alias("pct"), rnd(100 * (m1 - mw) / mw, 7).alias("pct_vs_worst"),
    )


@query(
    "sta20_parameter_sensitivity",
    """
    WITH m AS (SELECT l_returnflag AS genre, l_linenumber AS level, round(avg(l_extendedprice), 6) AS m FROM lineitem GROUP BY ALL)
    SELECT genre, round(max(m) - min(m), 6) AS spread, round(stddev_samp(m) / abs(avg(m)), 9) AS cv, round((max(m) - min(m)) / min(m) * 100, 7) AS relative_gain, arg_max(level, m) AS best, arg_min(level, m) AS worst FROM m GROUP BY 1
    """,
)
def sta20(spark, sf):
    m = _lines(spark, sf).groupBy(F.col("l_returnflag").alias("genre"), F.col("l_linenumber").alias("level")).agg(rnd(F.avg("l_extendedprice")).alias("m"))
    lo, hi = F.min("m"), F.max("m")
    return m.groupBy("genre").agg(
        rnd(hi - lo).alias("spread"), rnd(F.stddev_samp("m") / F.abs(F.avg("m")), 9).alias("cv"), rnd((hi - lo) / lo * 100, 7).alias("relative_gain"),
        F.max_by("level", "m").alias("best"), F.min_by("level", "m").alias("worst"),
    )


@query(
    "sta21_interactions",
    """
    WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS std, min(l_quantity) AS low, max(l_quantity) AS high, round(max(l_quantity) - min(l_quantity), 9) AS range FROM lineitem GROUP BY ALL)
    SELECT *, (row_number() OVER (ORDER BY mean DESC, l_returnflag, l_linestatus, l_linenumber) <= 5) AS top_mean, (row_number() OVER (ORDER BY std DESC, l_returnflag, l_linestatus, l_linenumber) <= 5) AS top_std,
      (row_number() OVER (ORDER BY range DESC, l_returnflag, l_linestatus, l_linenumber) <= 5) AS top_range FROM c
    """,
)
def sta21(spark, sf):
    q = F.col("l_quantity")
    c = _lines(spark, sf).groupBy(*CONFIG).agg(
        F.count("*").alias("n"), rnd(F.avg(q), 9).alias("mean"), rnd(F.stddev_samp(q), 9).alias("std"), F.min(q).alias("low"), F.max(q).alias("high"), rnd(F.max(q) - F.min(q), 9).alias("range")
    )
    out = c
    for measure in ("mean", "std", "range"):
        best = c.orderBy(F.desc(measure), *CONFIG).limit(5).select(*CONFIG, F.lit(True).alias(f"top_{measure}"))
        out = out.join(best, CONFIG, "left").withColumn(f"top_{measure}", F.coalesce(f"top_{measure}", F.lit(False)))
    return out


@query(
    "sta23_normality",
    """
    WITH s AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
    c AS (SELECT l_returnflag, any_value(n) AS n, avg((l_quantity - m) ** 2) AS m2, avg((l_quantity - m) ** 3) AS m3, avg((l_quantity - m) ** 4) AS m4 FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1),
    g AS (SELECT l_returnflag, n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) AS b2 FROM c),
    a AS (SELECT *, g1 * sqrt((n+1)*(n+3) / (6*(n-2))) AS y, 3*(n*n + 27*n - 70)*(n+1)*(n+3) / ((n-2)*(n+5)*(n+7)*(n+9)) AS be, (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3) / ((n+1)*(n+1)*(n+3)*(n+5))) AS x, 6*(n*n - 5*n + 2) / ((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5) / (n*(n-2)*(n-3))) AS sb FROM g),
    b AS (SELECT *, sqrt(2*(be-1)) - 1 AS w2, 6 + 8/sb*(2/sb + sqrt(1 + 4/(sb*sb))) AS aa FROM a),
    z AS (SELECT *, 1/sqrt(ln(sqrt(w2))) * ln(y/sqrt(2/(w2-1)) + sqrt((y*y)/(2/(w2-1)) + 1)) AS z1, ((1 - 2/(9*aa)) - sign(1 + x*sqrt(2/(aa-4))) * cbrt((1 - 2/aa) / abs(1 + x*sqrt(2/(aa-4))))) / sqrt(2/(9*aa)) AS z2 FROM b)
    SELECT l_returnflag, round(z1, 6) + 0.0 AS z_skew, round(z2, 5) AS z_kurtosis, round(z1*z1 + z2*z2, 3) AS k2, round(exp(-(z1*z1 + z2*z2)/2), 9) + 0.0 AS p FROM z
    """,
)
def sta23(spark, sf):
    # D'Agostino K2 from the two biased moments of one pass.
    m = _lines(spark, sf).groupBy("l_returnflag").agg(F.count("l_quantity").cast("double").alias("n"), F.skewness("l_quantity").alias("g1"), (F.kurtosis("l_quantity") + 3).alias("b2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    be = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (be - 1)) - 1
    scale = F.sqrt(2 / (w2 - 1))
    z1 = F.log(y / scale + F.sqrt((y / scale) ** 2 + 1)) / F.sqrt(F.log(F.sqrt(w2)))
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    base = 1 + x * F.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - F.signum(base) * F.cbrt((1 - 2 / a) / F.abs(base))) / F.sqrt(2 / (9 * a))
    zs = m.select("l_returnflag", z1.alias("z1"), z2.alias("z2"))
    k2 = F.col("z1") ** 2 + F.col("z2") ** 2
    return zs.select("l_returnflag", rnd("z1").alias("z_skew"), rnd("z2", 5).alias("z_kurtosis"), rnd(k2, 3).alias("k2"), rnd(F.exp(-k2 / 2), 9).alias("p"))


@query(
    "sta24_cronbach_alpha",
    "WITH w AS (SELECT l_partkey, "
    + ", ".join(f"avg(l_quantity) FILTER (WHERE l_linenumber = {i}) AS i{i}" for i in range(1, 8))
    + " FROM lineitem GROUP BY 1), f AS (SELECT * FROM w WHERE "
    + " AND ".join(f"i{i} IS NOT NULL" for i in range(1, 8))
    + ") SELECT count(*) AS rows, round(7 * (1 - ("
    + " + ".join(f"var_samp(i{i})" for i in range(1, 8))
    + ") / var_samp("
    + " + ".join(f"i{i}" for i in range(1, 8))
    + ")) / 6, 8) + 0.0 AS alpha FROM f",
)
def sta24(spark, sf):
    items = [str(i) for i in range(1, 8)]
    wide = _lines(spark, sf).groupBy("l_partkey").pivot("l_linenumber", list(range(1, 8))).agg(F.avg("l_quantity"))
    return _round(mod.cronbach_alpha(wide, items), 8, "alpha")


@query(
    "sta25_icc",
    """
    WITH c AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS x FROM lineitem GROUP BY ALL), k AS (SELECT l_suppkey FROM c GROUP BY 1 HAVING count(*) = 7), f AS (SELECT c.* FROM c JOIN k USING (l_suppkey)),
    g AS (SELECT avg(x) AS g FROM f), r AS (SELECT l_suppkey, avg(x) AS m FROM f GROUP BY 1), j AS (SELECT l_linenumber, avg(x) AS m FROM f GROUP BY 1),
    s AS (SELECT (SELECT 7 * sum((m - g) ** 2) FROM r, g) AS ssr, (SELECT (SELECT count(*) FROM r) * sum((m - g) ** 2) FROM j, g) AS ssc, (SELECT sum((x - g) ** 2) FROM f, g) AS sst, (SELECT CAST(count(*) AS DOUBLE) FROM r) AS n),
    m AS (SELECT n, ssr / (n - 1) AS msr, ssc / 6 AS msc, (sst - ssr - ssc) / ((n - 1) * 6) AS mse FROM s)
    SELECT n, 7.0::DOUBLE AS k, round(msr, 5) AS msr, round(msc, 5) AS msc, round(mse, 5) AS mse, round((msr - mse) / (msr + (msc - mse) / n), 6) + 0.0 AS icc,
      CASE WHEN (msr - mse) / (msr + (msc - mse) / n) >= .75 THEN 'excellent' WHEN (msr - mse) / (msr + (msc - mse) / n) >= .6 THEN 'good' WHEN (msr - mse) / (msr + (msc - mse) / n) >= .4 THEN 'fair' ELSE 'poor' END AS band FROM m
    """,
)
def sta25(spark, sf):
    cells = _lines(spark, sf).groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("x"))
    full = cells.groupBy("l_suppkey").agg(F.count("*").alias("c")).where("c = 7")
    icc = mod.icc_2k(cells.join(full, "l_suppkey", "left_semi"), "l_suppkey", "l_linenumber", "x")
    return _round(_round(icc, 5, "msr", "msc", "mse"), 6, "icc")


@query(
    "sta26_consistency",
    "SELECT l_partkey, count(*) AS raters, round(1 / (1 + stddev_samp(l_quantity)), 9) AS by_sd, round(1 / (1 + stddev_samp(l_quantity) / abs(avg(l_quantity))), 9) AS by_cv FROM lineitem GROUP BY 1 HAVING count(*) >= 3",
)
def sta26(spark, sf):
    sd = F.stddev_samp("l_quantity")
    g = _lines(spark, sf).groupBy("l_partkey").agg(F.count("*").alias("raters"), rnd(1 / (1 + sd), 9).alias("by_sd"), rnd(1 / (1 + sd / F.abs(F.avg("l_quantity"))), 9).alias("by_cv"))
    return g.where("raters >= 3")


@query(
    "sta27_variance_share",
    """
    WITH g AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round(var_samp(m), 8) AS between_var, round(avg(v), 7) AS within_var, round(var_samp(m) / avg(v), 9) AS ratio FROM g GROUP BY 1
    """,
)
def sta27(spark, sf):
    g = _lines(spark, sf).groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v"))
    b, w = F.var_samp("m"), F.avg("v")
    return g.groupBy("l_returnflag").agg(rnd(b, 8).alias("between_var"), rnd(w, 7).alias("within_var"), rnd(b / w, 9).alias("ratio"))


@query(
    "sta28_random_intercept",
    """
    WITH g AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1), t AS (SELECT avg(l_quantity) AS mu FROM lineitem),
    s AS (SELECT count(*) AS k, sum(n) AS t, sum(n * n) AS nn, sum(n * (m - mu) ** 2) AS b, sum((n - 1) * v) AS w, any_value(mu) AS mu FROM g, t), c AS (SELECT k, mu, w / (t - k) AS msw, b / (k - 1) AS msb, (t - nn / t) / (k - 1) AS n0 FROM s)
    SELECT k AS groups, round(mu, 8) AS mean, round(greatest(0, (msb - msw) / n0), 6) + 0.0 AS between, round(msw, 6) AS within, round(greatest(0, (msb - msw) / n0) / (greatest(0, (msb - msw) / n0) + msw), 8) + 0.0 AS share FROM c
    """,
)
def sta28(spark, sf):
    out = mod.random_intercept(_lines(spark, sf).select("l_partkey", "l_quantity"), "l_partkey", "l_quantity")
    return _round(_round(out, 8, "mean", "share"), 6, "between", "within")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("sta29_pca_loadings")
def sta29(spark, sf):
    return mod.pca_loadings(_lines(spark, sf).select(*_MEASURES), _MEASURES)[0]


@query("sta29_pca_composite")
def sta29_scores(spark, sf):
    per = _lines(spark, sf).groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _MEASURES])
    scored = mod.pca_loadings(per, _MEASURES)[1]
    ends = attach(scored, scored.agg(F.min("pca_score").alias("lo"), F.max("pca_score").alias("hi")), "e")
    return ends.select("l_suppkey", ((F.col("pca_score") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo"))).alias("pca_score"))


@query(
    "sta30_score_comparison",
    """
    WITH m AS (SELECT l_suppkey, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) AS d FROM lineitem GROUP BY 1), e AS (SELECT min(a) AS al, max(a) AS ah, min(b) AS bl, max(b) AS bh, min(c) AS cl, max(c) AS ch, min(d) AS dl, max(d) AS dh FROM m),
    n AS (SELECT l_suppkey, (a-al)/(ah-al) AS a, (b-bl)/(bh-bl) AS b, (c-cl)/(ch-cl) AS c, 1-(d-dl)/(dh-dl) AS d FROM m, e), s AS (SELECT l_suppkey, round((a+b+c+d)/4, 9) AS eq, round(.5*(a+b)/2 + .3*c + .2*d, 9) AS dm FROM n),
    r AS (SELECT *, rank() OVER (ORDER BY eq) + (count(*) OVER (PARTITION BY eq) - 1) / 2 AS re, rank() OVER (ORDER BY dm) + (count(*) OVER (PARTITION BY dm) - 1) / 2 AS rd FROM s)
    SELECT l_suppkey, eq AS equal_score, dm AS dimension_score, abs(re - rd) > 5 AS moved, round((SELECT corr(eq, dm) FROM r), 8) AS score_corr, round((SELECT corr(re, rd) FROM r), 8) AS rank_corr FROM r
    """,
)
def sta30(spark, sf):
    m = _lines(spark, sf).groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _MEASURES])
    ends = m.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in _MEASURES for f in (F.min, F.max)])
    unit = {c: (F.col(c) - F.col(f"e.min_{c}")) / (F.col(f"e.max_{c}") - F.col(f"e.min_{c}")) for c in _MEASURES}
    unit["l_tax"] = 1 - unit["l_tax"]
    a, b, c, d = (unit[x] for x in _MEASURES)
    scores = attach(m, ends, "e").select("l_suppkey", rnd((a + b + c + d) / 4, 9).alias("equal_score"), rnd(0.5 * (a + b) / 2 + 0.3 * c + 0.2 * d, 9).alias("dimension_score"))
    ranked = attach_ranks(scores, [], {"equal_score": "re", "dimension_score": "rd"})
    whole = ranked.agg(rnd(corr("equal_score", "dimension_score"), 8).alias("s"), rnd(corr("re", "rd"), 8).alias("r"))
    return attach(ranked, whole, "w").select(
        "l_suppkey", "equal_score", "dimension_score", (F.abs(F.col("re") - F.col("rd")) > 5).alias("moved"), F.col("w.s").alias("score_corr"), F.col("w.r").alias("rank_corr")
    )


@query(
    "sta31_within_rater",
    """
    SELECT l_suppkey, count(*) AS n, round((corr(l_quantity, l_extendedprice) + corr(l_quantity, l_discount) + corr(l_quantity, l_tax) + corr(l_extendedprice, l_discount) + corr(l_extendedprice, l_tax) + corr(l_discount, l_tax)) / 6, 8) + 0.0 AS mean_corr FROM lineitem GROUP BY 1
    """,
)
def sta31(spark, sf):
    pairs = [corr(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]
    return _lines(spark, sf).groupBy("l_suppkey").agg(F.count("*").alias("n"), rnd(sum(pairs[1:], pairs[0]) / len(pairs), 8).alias("mean_corr"))


@query(
    "sta34_stability_card",
    """
    WITH m AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), c AS (SELECT l_returnflag, stddev_samp(m) / abs(avg(m)) AS cv, max(m) - min(m) AS spread FROM m GROUP BY 1)
    SELECT l_returnflag, round(cv, 9) AS cv, round(spread, 8) AS spread, CASE WHEN cv < .01 THEN 2 WHEN cv < .02 THEN 1 ELSE 0 END + CASE WHEN spread < .5 THEN 2 WHEN spread < 1 THEN 1 ELSE 0 END AS points,
      CASE WHEN CASE WHEN cv < .01 THEN 2 WHEN cv < .02 THEN 1 ELSE 0 END + CASE WHEN spread < .5 THEN 2 WHEN spread < 1 THEN 1 ELSE 0 END >= 3 THEN 'stable' WHEN CASE WHEN cv < .01 THEN 2 WHEN cv < .02 THEN 1 ELSE 0 END + CASE WHEN spread < .5 THEN 2 WHEN spread < 1 THEN 1 ELSE 0 END >= 1 THEN 'fair' ELSE 'unstable' END AS label FROM c
    """,
)
def sta34(spark, sf):
    m = _lines(spark, sf).groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("m"))
    c = m.groupBy("l_returnflag").agg((F.stddev_samp("m") / F.abs(F.avg("m"))).alias("cv"), (F.max("m") - F.min("m")).alias("spread"))
    points = lambda col, a, b: F.when(F.col(col) < a, 2).when(F.col(col) < b, 1).otherwise(0)
    out = c.withColumn("points", points("cv", 0.01, 0.02) + points("spread", 0.5, 1.0))
    label = F.when(F.col("points") >= 3, "stable").when(F.col("points") >= 1, "fair").otherwise("unstable")
    return _round(_round(out.withColumn("label", label), 9, "cv"), 8, "spread")


@query(
    "sta35_curve_fits",
    """
    WITH u AS (SELECT event_type, user_id, CAST(count(*) AS DOUBLE) AS n, sum(value) AS y FROM events GROUP BY ALL), x AS (SELECT *, n * ln(n) AS nl, n * n AS nn FROM u),
    s AS (SELECT event_type, count(*) AS points, regr_syy(y, n) AS syy, regr_sxy(y, n) AS sn, regr_sxx(y, n) AS xn, regr_sxy(y, nl) AS sl, regr_sxx(y, nl) AS xl, regr_sxy(y, nn) AS sq, regr_sxx(y, nn) AS xq, covar_pop(n, nn) * count(*) AS nq FROM x GROUP BY 1)
    SELECT event_type, points, round(syy - sn*sn/xn, 3) AS linear, round(syy - sl*sl/xl, 3) AS n_log_n, round(syy - (sn * (xq*sn - nq*sq) + sq * (xn*sq - nq*sn)) / (xn*xq - nq*nq), 3) AS quadratic, CASE WHEN syy - sn*sn/xn <= syy - sl*sl/xl THEN 'linear' ELSE 'n log n' END AS best_one_term FROM s
    """,
)
def sta35(spark, sf):
    per_user = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("y"))
    return _round(mod.curve_fits(per_user, ["event_type"], "n", "y"), 3, "linear", "n_log_n", "quadratic")


@query(
    "sta36_cross_checks",
    """
    WITH x AS (SELECT l_returnflag, sum(l_extendedprice) / sum(l_quantity) AS ratio_of_sums, avg(l_extendedprice / l_quantity) AS mean_of_ratios, sum(l_quantity) AS s, avg(l_quantity) * count(*) AS a FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(ratio_of_sums, 6) AS ratio_of_sums, round(mean_of_ratios, 6) AS mean_of_ratios, abs(ratio_of_sums - mean_of_ratios) < .001 AS same_ratio, abs(s - a) < .001 AS same_total FROM x
    """,
)
def sta36(spark, sf):
    price, q = F.col("l_extendedprice"), F.col("l_quantity")
    x = _lines(spark, sf).groupBy("l_returnflag").agg(
        (F.sum(price) / F.sum(q)).alias("ratio_of_sums"), F.avg(price / q).alias("mean_of_ratios"), F.sum(q).alias("s"), (F.avg(q) * F.count("*")).alias("a")
    )
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.001
    return x.select("l_returnflag", rnd("ratio_of_sums").alias("ratio_of_sums"), rnd("mean_of_ratios").alias("mean_of_ratios"), same("ratio_of_sums", "mean_of_ratios").alias("same_ratio"), same("s", "a").alias("same_total"))


@query(
    "sta37_survey_gap",
    """
    SELECT l_linenumber AS question, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 9) AS with_experience, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 9) AS without_experience,
      round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F') - avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 9) + 0.0 AS gap, round(corr(l_quantity, l_extendedprice), 9) + 0.0 AS question_corr FROM lineitem GROUP BY 1
    """,
)
def sta37(spark, sf):
    q = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return _lines(spark, sf).groupBy(F.col("l_linenumber").alias("question")).agg(
        rnd(q("F"), 9).alias("with_experience"), rnd(q("O"), 9).alias("without_experience"), rnd(q("F") - q("O"), 9).alias("gap"), rnd(corr("l_quantity", "l_extendedprice"), 9).alias("question_corr")
    )


_ETA_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, '{m}' AS metric, sum(n * (m - g) ** 2) / any_value(t) AS eta FROM (SELECT {f}, count(*) AS n, avg({m}) AS m FROM lineitem GROUP BY 1), (SELECT avg({m}) AS g, var_pop({m}) * count(*) AS t FROM lineitem)"
    for f in CONFIG
    for m in _MEASURES
)


@query(
    "sta38_effect_summary",
    f"WITH e AS ({_ETA_SQL}) SELECT factor, count(*) AS n, round(avg(eta), 10) AS mean_eta, round(max(eta), 10) AS max_eta, round(min(eta), 10) AS min_eta, count(*) FILTER (WHERE eta >= .14) AS n_large, count(*) FILTER (WHERE eta >= .06 AND eta < .14) AS n_medium, count(*) FILTER (WHERE eta >= .01 AND eta < .06) AS n_small FROM e GROUP BY factor",
)
def sta38(spark, sf):
    rows = _lines(spark, sf)
    moments = [F.count("*").alias("n"), *[F.avg(m).alias(f"m_{m}") for m in _MEASURES], *[F.var_pop(m).alias(f"v_{m}") for m in _MEASURES]]
    cols = [F.col(c) for c in CONFIG]
    # One scan gives the level means of all factors and the grand row.
    cells = rows.select(*CONFIG, *_MEASURES).groupingSets([[cols[0]], [cols[1]], [cols[2]], []], *cols).agg(F.grouping_id().alias("g"), *moments)
    whole = cells.where("g = 7").select("n", *[f"m_{m}" for m in _MEASURES], *[f"v_{m}" for m in _MEASURES])
    factor = F.when(F.col("g") == 3, CONFIG[0]).when(F.col("g") == 5, CONFIG[1]).otherwise(CONFIG[2])
    with_all = attach(cells.where("g <> 7").withColumn("factor", factor), whole, "w")
    etas = with_all.groupBy("factor").agg(
        *[(F.sum(F.col("n") * (F.col(f"m_{m}") - F.col(f"w.m_{m}")) ** 2) / F.max(F.col(f"w.v_{m}") * F.col("w.n"))).alias(m) for m in _MEASURES]
    )
    e = etas.unpivot(["factor"], _MEASURES, "metric", "eta")
    x = F.col("eta")
    return e.groupBy("factor").agg(
        F.count("*").alias("n"), rnd(F.avg(x), 10).alias("mean_eta"), rnd(F.max(x), 10).alias("max_eta"), rnd(F.min(x), 10).alias("min_eta"),
        F.count_if(x >= 0.14).alias("n_large"), F.count_if((x >= 0.06) & (x < 0.14)).alias("n_medium"), F.count_if((x >= 0.01) & (x < 0.06)).alias("n_small"),
    )

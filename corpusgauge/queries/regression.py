"""Linear models with factors: robust errors and a random intercept, each with a full SQL solution."""

from pyspark.sql import functions as F

from corpusgauge.functions.common import rnd
from corpusgauge.operators import regression as rg
from corpusgauge.registry import query
from corpusgauge.sources.tables import table


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _ols_sql(columns: dict[str, str], y: str, source: str, cluster: str, places: int) -> str:
    """Least squares by sweeping X'X column by column in a recursive CTE; a swept-out column is redundant."""
    k, w = len(columns), len(columns) + 1
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(columns))
    swept = (
        f"list_transform(range(0, {w * w}), lambda p: CASE WHEN p // {w} = k AND p % {w} = k THEN 1 / a[{w} * k + k + 1] WHEN p // {w} = k THEN a[p + 1] / a[{w} * k + k + 1] "
        f"WHEN p % {w} = k THEN -a[p + 1] / a[{w} * k + k + 1] ELSE a[p + 1] - a[{w} * (p // {w}) + k + 1] * a[{w} * k + p % {w} + 1] / a[{w} * k + k + 1] END)"
    )
    sound = f"a[{w} * k + k + 1] > 1e-9 * first[{w} * k + k + 1]"
    r = lambda c: f"round({c}, {places}) + 0.0"
    return f"""
    WITH RECURSIVE x AS (SELECT row_number() OVER () AS r, {cluster} AS g, [{", ".join(columns.values())}, {y}]::DOUBLE[] AS v FROM {source}),
    cells AS (SELECT i, j, sum(v[i + 1] * v[j + 1]) AS s FROM x, range(0, {w}) a(i), range(0, {w}) b(j) GROUP BY i, j),
    sw AS (SELECT 0 AS k, list(s ORDER BY i, j) AS a, list(s ORDER BY i, j) AS first, []::BOOLEAN[] AS used FROM cells
        UNION ALL SELECT k + 1, CASE WHEN {sound} THEN {swept} ELSE a END, first, list_append(used, {sound}) FROM sw WHERE k < {k}),
    fit AS (SELECT a, used FROM sw WHERE k = {k}),
    term(i, name) AS (VALUES {names}),
    inv AS (SELECT t.i, u.i AS j, a[{w} * t.i + u.i + 1] AS s FROM fit, term t, term u WHERE used[t.i + 1] AND used[u.i + 1]),
    beta AS (SELECT i, a[{w} * i + {k} + 1] AS b FROM fit, term WHERE used[i + 1]),
    size AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM beta) AS m, (SELECT a[{w * w}] FROM fit) AS sse),
    long AS (SELECT r, g, i, v[i + 1] AS v, v[{w}] AS y FROM x, beta),
    res AS (SELECT r, any_value(y) - sum(v * b) AS e FROM long JOIN beta USING (i) GROUP BY r),
    lev AS (SELECT a.r, sum(a.v * s * b.v) AS h FROM long a JOIN inv ON inv.i = a.i JOIN long b ON b.r = a.r AND b.i = inv.j GROUP BY a.r),
    sc AS (SELECT long.*, e, e / (1 - h) AS u FROM long JOIN res USING (r) JOIN lev USING (r)),
    meat AS (SELECT a.i, b.i AS j, sum(a.v * b.v * a.u * a.u) AS s FROM sc a JOIN sc b ON a.r = b.r GROUP BY a.i, b.i),
    per AS (SELECT g, i, sum(v * e) AS s FROM sc GROUP BY g, i), among AS (SELECT a.i, b.i AS j, sum(a.s * b.s) AS s FROM per a JOIN per b ON a.g = b.g GROUP BY a.i, b.i),
    hc AS (SELECT p.i, sum(p.s * m.s * q.s) AS s FROM inv p JOIN meat m ON m.i = p.j JOIN inv q ON q.i = m.j AND q.j = p.i GROUP BY p.i),
    cl AS (SELECT p.i, sum(p.s * m.s * q.s) AS s FROM inv p JOIN among m ON m.i = p.j JOIN inv q ON q.i = m.j AND q.j = p.i GROUP BY p.i),
    gs AS (SELECT count(DISTINCT g) AS g FROM x)
    SELECT name AS term, {r("b")} AS coef, {r("sqrt(inv.s * sse / (n - m))")} AS se, {r("sqrt(hc.s)")} AS se_hc3, {r("sqrt(cl.s * (gs.g / (gs.g - 1)) * ((n - 1) / (n - m)))")} AS se_cluster
    FROM term LEFT JOIN beta USING (i) LEFT JOIN inv ON inv.i = term.i AND inv.j = term.i LEFT JOIN hc ON hc.i = term.i LEFT JOIN cl ON cl.i = term.i, size, gs
    """


def _rounded(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


@query("sta12_robust_ols", _ols_sql({"intercept": "1", "is_r": "(l_returnflag = 'R')::INT", "l_quantity": "l_quantity"}, "l_extendedprice", "lineitem", "l_suppkey", 5))
def sta12(spark, sf):
    df = _lines(spark, sf).select("l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("is_r"), "l_quantity")
    fit = rg.robust_ols(rg.design(df, ["is_r", "l_quantity"], ["l_extendedprice", "l_suppkey"]), "l_extendedprice", "l_suppkey")
    return _rounded(fit, 5, "coef", "se", "se_hc3", "se_cluster")


_FACTORS = {
    "intercept": "1",
    "l_returnflag[N]": "(l_returnflag = 'N')::INT",
    "l_returnflag[R]": "(l_returnflag = 'R')::INT",
    "l_linestatus[O]": "(l_linestatus = 'O')::INT",
    "l_quantity": "l_quantity",
    "weight": "2 * l_quantity + 3",
    "l_returnflag[N]:l_linestatus[O]": "(l_returnflag = 'N' AND l_linestatus = 'O')::INT",
    "l_returnflag[R]:l_linestatus[O]": "(l_returnflag = 'R' AND l_linestatus = 'O')::INT",
}


@query("sta12_factor_model", _ols_sql(_FACTORS, "l_extendedprice", "lineitem", "l_suppkey", 4))
def sta12_factors(spark, sf):
    """Two factors, their interaction, a number and a column that repeats it; errors by supplier."""
    df = _lines(spark, sf).select("l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", (2 * F.col("l_quantity") + 3).alias("weight"))
    model = rg.design(df, ["l_returnflag", "l_linestatus", "l_quantity", "weight", ("l_returnflag", "l_linestatus")], ["l_extendedprice", "l_suppkey"])
    return _rounded(rg.robust_ols(model, "l_extendedprice", "l_suppkey"), 4, "coef", "se", "se_hc3", "se_cluster")


def _mixed_sql() -> str:
    """REML of a three-level factor with a random intercept: the ratio of variances by bisection on the slope of the likelihood."""
    c = "anr"
    pairs = [(x, z) for i, x in enumerate(c) for z in c[i:]]
    cells = ", ".join([f"sum({x} * {z}) AS {x}{z}" for x, z in pairs] + [f"sum({x} * sy) AS {x}y" for x in c] + ["sum(sy * sy) AS yy"])
    names = [x + z for x, z in pairs] + [f"{x}y" for x in c] + ["yy"]
    folded = ", ".join(f"sum(t / (1 + t * n) * {m}) AS f_{m}, sum({m} / (1 + t * n) ** 2) AS d_{m}" for m in names)
    # X'X of a factor has nothing beside its diagonal.
    left = ", ".join(f"{f't_{x}' if x == z else '0'} - f_{x}{z} AS h_{x}{z}" for x, z in pairs) + ", " + ", ".join(f"s_{x} - f_{x}y AS r_{x}" for x in c) + ", s_yy - f_yy AS q"
    det = "h_aa * (h_nn * h_rr - h_nr * h_nr) - h_an * (h_an * h_rr - h_ar * h_nr) + h_ar * (h_an * h_nr - h_ar * h_nn)"
    inverse = {"aa": "h_nn * h_rr - h_nr * h_nr", "an": "h_ar * h_nr - h_an * h_rr", "ar": "h_an * h_nr - h_ar * h_nn", "nn": "h_aa * h_rr - h_ar * h_ar", "nr": "h_an * h_ar - h_aa * h_nr", "rr": "h_aa * h_nn - h_an * h_an"}
    inv = ", ".join(f"({e}) / det AS i_{m}" for m, e in inverse.items())
    two = lambda p, x, z: f"{p}_{min(x, z, key=c.index)}{max(x, z, key=c.index)}"
    coef = ", ".join(f"{' + '.join(f'{two("i", x, z)} * r_{z}' for z in c)} AS b_{x}" for x in c)
    rss = "q - b_a * r_a - b_n * r_n - b_r * r_r"
    moved = " + ".join(f"b_{x} * b_{z} * {two('d', x, z)}" for x in c for z in c)
    trace = " + ".join(f"{two('i', x, z)} * {two('d', x, z)}" for x in c for z in c)
    slope = f"(total - 3) * (-d_yy + 2 * (b_a * d_ay + b_n * d_ny + b_r * d_ry) - ({moved})) / ({rss}) + dlogs - ({trace})"

    def solved(source: str, carry: str) -> str:
        sums = f"SELECT {carry}, {folded}, sum(k * ln(1 + t * n)) AS logs, sum(k * n / (1 + t * n)) AS dlogs FROM {source}, sz GROUP BY {carry}"
        return f"(SELECT *, {coef} FROM (SELECT *, {inv} FROM (SELECT *, {det} AS det FROM (SELECT *, {left} FROM ({sums}), tot))))"

    se = lambda x: f"sqrt((i_aa + i_{x}{x} - 2 * i_a{x}) * within)"
    return f"""
    WITH RECURSIVE mean AS (SELECT avg(l_extendedprice) AS mu FROM lineitem),
    x AS (SELECT l_partkey AS g, l_returnflag AS c, l_extendedprice - mu AS y FROM lineitem, mean),
    gs AS (SELECT g, count(*)::DOUBLE AS n, sum((c = 'A')::INT)::DOUBLE AS a, sum((c = 'N')::INT)::DOUBLE AS nn, sum((c = 'R')::INT)::DOUBLE AS r, sum(y) AS sy FROM x GROUP BY g),
    sz AS (SELECT n, count(*)::DOUBLE AS k, {cells.replace("n *", "nn *").replace("* n)", "* nn)")} FROM gs GROUP BY n),
    tot AS (SELECT count(*)::DOUBLE AS total, {", ".join(f"sum((c = '{x.upper()}')::INT)::DOUBLE AS t_{x}, sum(y) FILTER (WHERE c = '{x.upper()}') AS s_{x}" for x in c)}, sum(y * y) AS s_yy FROM x),
    it AS (SELECT 0 AS i, 0::DOUBLE AS lo, 4096::DOUBLE AS hi, 2048::DOUBLE AS t
        UNION ALL SELECT i + 1, CASE WHEN slope < 0 THEN t ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE t END, CASE WHEN slope < 0 THEN (t + hi) / 2 ELSE (lo + t) / 2 END
        FROM (SELECT i, lo, hi, t, {slope} AS slope FROM {solved("(SELECT * FROM it WHERE i < 60)", "i, lo, hi, t")})),
    fin AS (SELECT *, ({rss}) / (total - 3) AS within FROM {solved("(SELECT t FROM it WHERE i = 60)", "t")}),
    out AS (SELECT 'intercept' AS term, b_a + mu AS estimate, sqrt(i_aa * within) AS se FROM fin, mean
        UNION ALL SELECT 'l_returnflag[N]', b_n - b_a, {se("n")} FROM fin UNION ALL SELECT 'l_returnflag[R]', b_r - b_a, {se("r")} FROM fin
        UNION ALL SELECT 'between', t * within, NULL FROM fin UNION ALL SELECT 'within', within, NULL FROM fin
        UNION ALL SELECT 'loglik', -.5 * ((total - 3) * (ln(2 * pi() * within) + 1) + logs + ln(det)), NULL FROM fin)
    SELECT term, round(estimate, 3) + 0.0 AS estimate, round(se, 4) + 0.0 AS se, round(estimate / se, 5) + 0.0 AS z FROM out
    """


@query("sta28_mixed_model", _mixed_sql())
def sta28_mixed(spark, sf):
    """score ~ config + (1 | rater), by REML."""
    model = rg.design(_lines(spark, sf).select("l_partkey", "l_returnflag", "l_extendedprice"), ["l_returnflag"], ["l_extendedprice", "l_partkey"])
    fit = rg.mixed_model(model, "l_extendedprice", "l_partkey")
    return _rounded(_rounded(_rounded(fit, 3, "estimate"), 4, "se"), 5, "z")

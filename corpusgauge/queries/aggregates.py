"""Aggregation, top-k and set operators on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge import fixed
from corpusgauge.functions.common import flat, inline, ratio, rnd, scalar, sql_values
from corpusgauge.operators import aggregates as agg
from corpusgauge.operators import signals
from corpusgauge.operators.joins import beaten_counts
from corpusgauge.operators.tables import long_form
from corpusgauge.plans.ordered import ordered, quantiles
from corpusgauge.registry import query
from corpusgauge.sources.tables import busy_table, table

WORD = r"[\p{L}\p{N}]+"
CONFIG = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _rounded(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


@query(
    "agg1_group_stats",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS std,
      min(l_quantity) AS low, max(l_quantity) AS high, round(quantile_cont(l_quantity, .5), 6) AS median FROM lineitem GROUP BY ALL
    """,
)
def agg1(spark, sf):
    df = table(spark, sf, "lineitem").select(*CONFIG, "l_quantity")
    stats = df.groupBy(*CONFIG).agg(*agg.moments("l_quantity"))
    median = quantiles(df, CONFIG, "l_quantity", {"median": 0.5}).drop("n")
    return _rounded(stats.join(median, CONFIG), 9, "mean", "std", "median")


@query(
    "agg2_grouping_sets",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 5) AS std,
      CAST(GROUPING(l_returnflag) * 4 + GROUPING(l_linestatus) * 2 + GROUPING(l_linenumber) AS BIGINT) AS level FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus, l_linenumber), ())
    """,
)
def agg2(spark, sf):
    f, s, n = (F.col(c) for c in CONFIG)
    df = table(spark, sf, "lineitem").select(*CONFIG, "l_extendedprice")
    sets = df.groupingSets([[f], [s], [n], [f, s, n], []], f, s, n)
    return sets.agg(
        F.count("*").alias("n"), rnd(F.avg("l_extendedprice")).alias("mean"), rnd(F.stddev_samp("l_extendedprice"), 5).alias("std"),
        F.grouping_id().alias("level"),
    )


@query(
    "agg3_distinct_counts",
    """
    SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderdate) AS n_days FROM orders GROUP BY ALL
    """,
)
def agg3(spark, sf):
    df = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus")
    return df.agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderdate").alias("n_days"))


@query(
    "agg4_pair_coverage",
    "SELECT event_type, count(*) AS n_users FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type",
)
def agg4(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct().groupBy("event_type").agg(F.count("*").alias("n_users"))


_PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query(
    "agg5_exact_quantiles",
    "SELECT lang, count(*) AS n, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS {n}" for n, p in _PROBS.items()) + " FROM documents GROUP BY lang",
)
def agg5(spark, sf):
    return _rounded(quantiles(table(spark, sf, "documents"), ["lang"], "n_chars", _PROBS), 6, *_PROBS)


@query(
    "agg5_exact_quantiles_all",
    "SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in _PROBS.items()) + " FROM lineitem",
)
def agg5_all(spark, sf):
    return _rounded(quantiles(table(spark, sf, "lineitem").select("l_extendedprice"), [], "l_extendedprice", _PROBS), 6, *_PROBS)


@query(
    "agg6_robust_moments",
    """
    WITH m AS (SELECT l_returnflag, quantile_cont(l_quantity, .5) AS med FROM lineitem GROUP BY 1), d AS (SELECT l.*, abs(l_quantity - med) AS dev FROM lineitem l JOIN m USING (l_returnflag))
    SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_quantity, .75) - quantile_cont(l_quantity, .25), 6) AS iqr, round(quantile_cont(dev, .5), 6) AS mad,
      round(skewness(l_quantity), 7) + 0.0 AS skewness, round(kurtosis(l_quantity), 7) + 0.0 AS kurtosis, max(l_quantity) - min(l_quantity) AS spread FROM d GROUP BY l_returnflag
    """,
)
def agg6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    out = agg.robust_moments(df, ["l_returnflag"], "l_quantity")
    return _rounded(out.select("l_returnflag", "n", "iqr", "mad", "skewness", "kurtosis", "spread"), 7, "iqr", "mad", "skewness", "kurtosis")


@query(
    "agg7_seed_variation",
    """
    WITH c AS (SELECT l_returnflag, l_linestatus, l_suppkey, stddev_samp(l_quantity) / abs(avg(l_quantity)) AS cv FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, count(*) AS n_seeds, round(avg(cv), 9) AS mean_cv, count(*) FILTER (WHERE cv < .55) AS n_stable,
      count(*) FILTER (WHERE cv >= .55 AND cv < .6) AS n_moderate, count(*) FILTER (WHERE cv >= .6) AS n_unstable FROM c GROUP BY ALL
    """,
)
def agg7(spark, sf):
    df = table(spark, sf, "lineitem")
    cv = df.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(agg.coefficient_of_variation("l_quantity").alias("cv"))
    c = F.col("cv")
    return cv.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_seeds"), rnd(F.avg(c), 9).alias("mean_cv"), F.count_if(c < 0.55).alias("n_stable"),
        F.count_if((c >= 0.55) & (c < 0.6)).alias("n_moderate"), F.count_if(c >= 0.6).alias("n_unstable"),
    )


@query(
    "agg8_top_categories",
    """
    WITH c AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_custkey)::INTEGER AS place FROM c) WHERE place <= 3
    """,
)
def agg8(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n"))
    return agg.top_k(counts, ["o_orderstatus"], [F.desc("n"), F.asc("o_custkey")], 3)


@query(
    "agg9_pivot",
    """
    SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS "F", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS "O",
      round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 6) AS "P" FROM orders GROUP BY ALL
    """,
)
def agg9(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(rnd(F.avg("o_totalprice")))


@query(
    "agg10_unpivot",
    """
    WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem) ON quantity, tax, discount INTO NAME metric VALUE score)
    SELECT l_returnflag, metric, count(*) AS n, round(avg(score), 8) AS mean, max(score) AS top FROM u GROUP BY ALL
    """,
)
def agg10(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_returnflag", "l_quantity as quantity", "l_tax as tax", "l_discount as discount")
    rows = long_form(df, ["l_returnflag"], ["quantity", "tax", "discount"], "metric", "score")
    return rows.groupBy("l_returnflag", "metric").agg(F.count("*").alias("n"), rnd(F.avg("score"), 8).alias("mean"), F.max("score").alias("top"))


@query(
    "agg11_rater_class_mean",
    """
    WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS deep, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS shallow,
      count(*) FILTER (WHERE l_returnflag = 'R') AS n_deep, count(*) FILTER (WHERE l_returnflag = 'A') AS n_shallow FROM lineitem GROUP BY 1)
    SELECT l_suppkey, n_deep, n_shallow, round(coalesce(.8 * deep + .2 * shallow, deep, shallow), 8) AS weighted,
      round(least(n_deep, n_shallow) / greatest(n_deep, n_shallow), 8) AS balance FROM m
    """,
)
def agg11(spark, sf):
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    m = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg(F.when(flag == "R", q)).alias("deep"), F.avg(F.when(flag == "A", q)).alias("shallow"),
        F.count_if(flag == "R").alias("n_deep"), F.count_if(flag == "A").alias("n_shallow"),
    )
    # Fixed shares of the two rater classes.
    both = 0.8 * F.col("deep") + 0.2 * F.col("shallow")
    return m.select(
        "l_suppkey", "n_deep", "n_shallow", rnd(F.coalesce(both, "deep", "shallow"), 8).alias("weighted"),
        rnd(ratio(F.least("n_deep", "n_shallow"), F.greatest("n_deep", "n_shallow")), 8).alias("balance"),
    )


@query(
    "agg12_rater_class",
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_configs, count(DISTINCT o_orderkey) AS n_stories,
      CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(DISTINCT o_orderkey) = 3 THEN 'deep' WHEN count(DISTINCT o_orderpriority) > 1 THEN 'shallow' ELSE 'unknown' END AS rater_class
    FROM orders GROUP BY 1
    """,
)
def agg12(spark, sf):
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_distinct("o_orderpriority").alias("n_configs"), F.count_distinct("o_orderkey").alias("n_stories")
    )
    configs, stories = F.col("n_configs"), F.col("n_stories")
    kind = F.when((configs == 1) & (stories == 3), "deep").when(configs > 1, "shallow").otherwise("unknown")
    return counted.withColumn("rater_class", kind)


@query(
    "agg13_reliability_summary",
    """
    SELECT l_partkey, count(*) AS k, round(avg(l_quantity), 9) AS mean, round(coalesce(stddev_samp(l_quantity), 0) * sqrt((count(*) - 1) / count(*)), 8) AS std,
      round(coalesce(stddev_samp(l_quantity), 0) * sqrt((count(*) - 1) / count(*)) / sqrt(count(*)), 8) AS std_error, least(1.0::DOUBLE, count(*) / 4) AS weight FROM lineitem GROUP BY 1
    """,
)
def agg13(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("k"), F.avg("l_quantity").alias("mean"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("s")
    )
    k = F.col("k")
    std = F.col("s") * F.sqrt((k - 1) / k)
    return m.select(
        "l_partkey", "k", rnd("mean", 9).alias("mean"), rnd(std, 8).alias("std"), rnd(std / F.sqrt(k), 8).alias("std_error"),
        F.least(F.lit(1.0), k / 4).alias("weight"),
    )


_PAIRS_SQL = """
    w AS (SELECT l_partkey, least(1.0, count(*) / 4) AS w FROM lineitem GROUP BY 1),
    x AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_returnflag, w FROM lineitem JOIN w USING (l_partkey)),
    p AS (SELECT a.l_partkey AS winner, b.l_partkey AS loser, a.l_returnflag AS wf, b.l_returnflag AS lf, (a.w + b.w) / 2 AS pw FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice > b.l_extendedprice)
"""


@query(
    "agg14_weighted_wins",
    "WITH"
    + _PAIRS_SQL
    + """, u AS (SELECT winner AS item, 1 AS won, 0 AS lost, pw AS ww, 0 AS wl FROM p UNION ALL SELECT loser, 0, 1, 0, pw FROM p),
    s AS (SELECT item, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(lost) AS BIGINT) AS losses, sum(ww) AS ww, sum(wl) AS wl FROM u GROUP BY item)
    SELECT item, wins, losses, round(ww - wl / 2, 6) + 0.0 AS score, round(ww / (ww + wl), 8) AS win_rate, round(least(1.0, (ww + wl) / 10), 8) AS confidence,
      rank() OVER (ORDER BY round(ww - wl / 2, 6) DESC) AS place FROM s
    """,
)
def agg14(spark, sf):
    out = agg.weighted_outcomes(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_extendedprice")
    out = out.where("wins + losses > 0").withColumn("score", rnd("score")).withColumn("down", -F.col("score"))
    ranked = ordered(out, [], "down", ["l_partkey"], rank=True)
    return ranked.select(
        F.col("l_partkey").alias("item"), "wins", "losses", "score", rnd("win_rate", 8).alias("win_rate"),
        rnd("confidence", 8).alias("confidence"), F.col("lo").alias("place"),
    )


@query(
    "agg15_wilson_interval",
    "WITH"
    + _PAIRS_SQL
    + """, u AS (SELECT wf AS f, 1 AS won FROM p UNION ALL SELECT lf, 0 FROM p), s AS (SELECT f, CAST(sum(won) AS DOUBLE) AS wins, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY f HAVING count(*) >= 3)
    SELECT f AS l_returnflag, CAST(n AS BIGINT) AS n, round(wins / n, 9) AS win_rate,
      round((wins/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96*sqrt(wins/n*(1-wins/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n), 9) AS low,
      round((wins/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96*sqrt(wins/n*(1-wins/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n), 9) AS high,
      round((wins/n - .5) / sqrt(.25/n), 7) + 0.0 AS z FROM s
    """,
)
def agg15(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey", "l_returnflag")
    out = beaten_counts(df, ["l_orderkey"], "l_extendedprice", ["l_partkey"]).groupBy("l_returnflag").agg(
        F.sum("wins").alias("wins"), F.sum(F.col("wins") + F.col("losses")).alias("n")
    )
    low, high = agg.wilson(F.col("wins"), F.col("n"))
    share = F.col("wins") / F.col("n")
    return out.where("n >= 3").select(
        "l_returnflag", "n", rnd(share, 9).alias("win_rate"), rnd(low, 9).alias("low"), rnd(high, 9).alias("high"),
        rnd((share - 0.5) / F.sqrt(0.25 / F.col("n")), 7).alias("z"),
    )


@query(
    "agg16_cost_ledger",
    """
    WITH e AS (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id FROM events)
    SELECT event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, round(sum(value), 2) AS cost, round(avg(value), 9) AS mean_time, max(value) AS longest, min(value) AS shortest,
      round(sum(value) / (SELECT sum(value) FROM e), 9) AS share, arg_max(event_id, {'v': value, 'i': event_id}) AS slowest_call FROM e GROUP BY event_type
    """,
)
def agg16(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))
    total = scalar(df.agg(F.sum("value").alias("v")))["v"]
    return df.groupBy("event_type").agg(
        F.count("*").alias("calls"), F.sum("k").alias("tokens"), rnd(F.sum("value"), 2).alias("cost"), rnd(F.avg("value"), 9).alias("mean_time"),
        F.max("value").alias("longest"), F.min("value").alias("shortest"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("slowest_call"), F.sum("value").alias("__v"),
    ).withColumn("share", rnd(F.col("__v") / total, 9)).drop("__v")


@query(
    "agg17_cache_error_counters",
    """
    SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'error') AS errors,
      round(count(*) FILTER (WHERE event_type = 'view') / count(*), 9) AS hit_rate,
      CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN round(count(*) FILTER (WHERE event_type = 'error' AND value < 20) / count(*) FILTER (WHERE event_type = 'error'), 9) END AS resolved_share FROM events GROUP BY 1
    """,
)
def agg17(spark, sf):
    kind = F.col("event_type")
    df = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.count_if(kind == "view").alias("hits"), F.count_if(kind == "error").alias("errors"),
        F.count_if((kind == "error") & (F.col("value") < 20)).alias("resolved"),
    )
    return df.select(
        "user_id", "attempts", "hits", "errors", rnd(ratio(F.col("hits"), F.col("attempts")), 9).alias("hit_rate"),
        rnd(ratio(F.col("resolved"), F.col("errors")), 9).alias("resolved_share"),
    )


@query(
    "agg18_dialogue_stats",
    """
    SELECT conv_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT role) AS n_speakers, round(avg(length(text)), 9) AS mean_chars,
      CASE WHEN avg(length(text)) BETWEEN 20 AND 300 THEN 10 WHEN avg(length(text)) BETWEEN 10 AND 600 THEN 7 ELSE 5 END AS score FROM conversations GROUP BY 1
    """,
)
def agg18(spark, sf):
    df = table(spark, sf, "conversations").withColumn("size", F.length("text"))
    mean = F.avg("size")
    return df.groupBy("conv_id").agg(
        F.count("*").alias("n_lines"), F.sum("size").alias("n_chars"), F.count_distinct("role").alias("n_speakers"), rnd(mean, 9).alias("mean_chars"),
        F.when(mean.between(20, 300), 10).when(mean.between(10, 600), 7).otherwise(5).alias("score"),
    )


@query(
    "agg19_state_complexity",
    """
    WITH s AS (SELECT role, conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS state FROM conversations)
    SELECT role, count(*) AS appearances, count(DISTINCT state) AS unique_states, round(count(DISTINCT state) / count(*), 9) AS diversity, round(count(*) / count(DISTINCT conv_id), 8) AS per_chapter FROM s GROUP BY role
    """,
)
def agg19(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    states = flat(table(spark, sf, "conversations"), ["role", "conv_id"], words, "state")
    n = F.count("*")
    # Two distinct counts from two pre-aggregated tables, so no row is expanded.
    by_state = states.groupBy("role", "state").agg(n.alias("c")).groupBy("role").agg(F.sum("c").alias("appearances"), n.alias("unique_states"))
    by_chapter = states.select("role", "conv_id").distinct().groupBy("role").agg(n.alias("chapters"))
    return by_state.join(by_chapter, "role").select(
        "role", "appearances", "unique_states", rnd(F.col("unique_states") / F.col("appearances"), 9).alias("diversity"),
        rnd(F.col("appearances") / F.col("chapters"), 8).alias("per_chapter"),
    )


@query(
    "agg20_description_complexity",
    "SELECT p_brand, count(*) AS n, round(sum((.3 * length(p_name) + .4 * length(p_type) + .3 * length(p_brand))::DOUBLE), 4) AS complexity FROM part GROUP BY 1",
)
def agg20(spark, sf):
    # Fixed weights of traits, background and motivation.
    score = 0.3 * F.length("p_name") + 0.4 * F.length("p_type") + 0.3 * F.length("p_brand")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), rnd(F.sum(score), 4).alias("complexity"))


@query(
    "agg21_structure_completeness",
    """
    WITH a AS (SELECT conv_id, 'TP' || (turn + 1) AS point, 'stage' || (turn % 6 + 1) AS stage, role AS func FROM conversations)
    SELECT conv_id, count(DISTINCT point) FILTER (WHERE point IN ('TP1','TP2','TP3','TP4','TP5')) AS points, count(DISTINCT stage) AS stages,
      count(DISTINCT func) AS functions, round(count(DISTINCT point) FILTER (WHERE point IN ('TP1','TP2','TP3','TP4','TP5')) / 5 * 10, 6) AS point_score,
      round(count(DISTINCT stage) / 6 * 10, 6) AS stage_score, round(count(DISTINCT func) / count(*), 9) AS function_diversity FROM a GROUP BY 1
    """,
)
def agg21(spark, sf):
    df = table(spark, sf, "conversations").select(
        "conv_id", F.concat(F.lit("TP"), F.col("turn") + 1).alias("point"), F.concat(F.lit("stage"), F.col("turn") % 6 + 1).alias("stage"), F.col("role").alias("func")
    )
    # Only the 5 turning points enter their set; stages are 6 and functions are roles.
    wanted = F.col("point").isin([f"TP{i}" for i in range(1, 6)])
    found = df.groupBy("conv_id").agg(
        F.collect_set(F.when(wanted, F.col("point"))).alias("p"), F.collect_set("stage").alias("s"), F.collect_set("func").alias("f"), F.count("*").alias("n")
    )
    points = F.size("p")
    return found.select(
        "conv_id", points.cast("bigint").alias("points"), F.size("s").cast("bigint").alias("stages"), F.size("f").cast("bigint").alias("functions"),
        rnd(points / 5 * 10).alias("point_score"), rnd(F.size("s") / 6 * 10).alias("stage_score"), rnd(F.size("f") / F.col("n"), 9).alias("function_diversity"),
    )


@query(
    "agg22_count_stability",
    """
    WITH r AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS run, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT user_id, count(*) AS runs, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS std FROM r GROUP BY 1)
    SELECT m.user_id, any_value(runs) AS runs, round(any_value(mean), 9) AS mean, round(any_value(mean - 1.96 * std / sqrt(runs)), 8) + 0.0 AS low,
      round(any_value(mean + 1.96 * std / sqrt(runs)), 8) AS high, round(any_value(1 - std / mean), 8) + 0.0 AS stability, arg_min(run, {'d': round(abs(n - mean), 9), 'r': run}) AS representative FROM r JOIN m USING (user_id) GROUP BY m.user_id
    """,
)
def agg22(spark, sf):
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    runs = table(spark, sf, "events").groupBy("user_id", day.alias("run")).agg(F.count("*").alias("n"))
    m = runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"))
    near = F.struct(rnd(F.abs(F.col("n") - F.col("mean")), 9), "run")
    picked = runs.join(m, "user_id").groupBy("user_id", "runs", "mean", "std").agg(F.min_by("run", near).alias("representative"))
    half = 1.96 * F.col("std") / F.sqrt("runs")
    return picked.select(
        "user_id", "runs", rnd("mean", 9).alias("mean"), rnd(F.col("mean") - half, 8).alias("low"), rnd(F.col("mean") + half, 8).alias("high"),
        rnd(1 - F.col("std") / F.col("mean"), 8).alias("stability"), "representative",
    )


@query(
    "agg23_yes_no_vote",
    """
    WITH t AS (SELECT user_id, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) / 100 AS y, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END) / 100 AS n,
      count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS yc, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'signup')) AS nc FROM events GROUP BY 1)
    SELECT user_id, round(y, 4) AS yes_weight, round(n, 4) AS no_weight, yc AS yes_count, nc AS no_count, CASE WHEN y <> n THEN y > n ELSE yc > nc END AS final,
      CASE WHEN y <> n THEN 'weighted' WHEN yc <> nc THEN 'count' ELSE 'tie-break' END AS method, greatest(yc, nc) >= 2 AS met_quorum FROM t
    """,
)
def agg23(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "value")
    out = agg.yes_no_vote(df, ["user_id"], F.col("event_type").isin("purchase", "signup"), F.col("value"))
    return _rounded(out, 4, "yes_weight", "no_weight")


@query(
    "agg24_severity_vote",
    """
    WITH v AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS i, value AS c FROM events),
    m AS (SELECT user_id, sum(i * c) / sum(c) AS mean_level, count(*) AS votes FROM v GROUP BY 1)
    SELECT user_id, votes, round(mean_level, 8) AS mean_level, CAST(CASE WHEN votes > 60 THEN floor(mean_level) ELSE ceil(mean_level) END AS INTEGER) AS level FROM m
    """,
)
def agg24(spark, sf):
    order = ["view", "click", "signup", "purchase", "error"]
    level = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("event_type")) - 1
    out = agg.severity_vote(table(spark, sf, "events"), ["user_id"], level, F.col("value"), F.col("votes") > 60)
    return _rounded(out, 8, "mean_level")


def _has_sql(word: str) -> str:
    return f"list_contains(w, '{word}')"


@query(
    "agg25_severity_rollup",
    f"""
    WITH d AS (SELECT source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    s AS (SELECT source, CASE WHEN {_has_sql('worthless')} THEN 4 WHEN {_has_sql('stupid')} THEN 3 WHEN {_has_sql('from')} AND {_has_sql('are')} THEN 2 WHEN {_has_sql('by')} THEN 1 ELSE 0 END AS lvl FROM d),
    g AS (SELECT source, max(lvl) AS top, count(*) FILTER (WHERE lvl >= 2) AS n_open FROM s GROUP BY 1)
    SELECT source, ['NONE','LOW','MEDIUM','HIGH','CRITICAL'][top + 1] AS severity, n_open, ['pass','log','rewrite','rewrite and check','block'][top + 1] AS action FROM g
    """,
)
def agg25(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    docs = busy_table(spark, sf, "documents").select("source", words.alias("w"))
    has = lambda w: F.array_contains("w", w)
    level = F.when(has("worthless"), 4).when(has("stupid"), 3).when(has("from") & has("are"), 2).when(has("by"), 1).otherwise(0)
    top = docs.select("source", level.alias("lvl")).groupBy("source").agg(F.max("lvl").alias("lvl"), F.count_if(F.col("lvl") >= 2).alias("n_open"))
    actions = inline(spark, [(i, s, a) for i, (s, a) in enumerate(fixed.SEVERITY_ACTIONS)], "lvl int, severity string, action string")
    return top.join(actions, "lvl").select("source", "severity", "n_open", "action")


_FACTS = [("spoiler", "than"), ("spoiler", "thing"), ("forbidden", "ones"), ("forbidden", "reed"), ("negated", "was"), ("opposite_time", "from")]


@query(
    "agg26_lexical_signals",
    f"""
    WITH f AS (SELECT * FROM {sql_values(_FACTS, 'signal, word')}), t AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE signal = 'spoiler') AS spoiler, count(*) FILTER (WHERE signal = 'forbidden') AS forbidden,
      count(*) FILTER (WHERE signal = 'negated') AS negated, count(*) FILTER (WHERE signal = 'opposite_time') AS opposite_time FROM t JOIN f USING (word) GROUP BY 1
    """,
)
def agg26(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    hits = flat(table(spark, sf, "conversations"), ["conv_id"], words, "word").join(inline(spark, _FACTS, "signal string, word string"), "word")
    return hits.groupBy("conv_id").agg(*[F.count_if(F.col("signal") == s).alias(s) for s in ("spoiler", "forbidden", "negated", "opposite_time")])


_FUTURE, _SETTLED = ("the reed", "is on", "der st", "with this"), ("the", "en", "that")
_UNKNOWN = (("user", "is the"), ("system", "was"), ("assistant", "de la"), ("user", "von"))


@query(
    "agg26_dialogue_signals",
    f"""
    WITH f AS (SELECT * FROM {sql_values([(p, i) for i, p in enumerate(_FUTURE)], 'phrase, place')}), s AS (SELECT * FROM {sql_values([(p,) for p in _SETTLED], 'phrase')}), d AS (SELECT * FROM {sql_values([(d,) for d in signals.DENIALS], 'denial')}),
    u AS (SELECT * FROM {sql_values(_UNKNOWN, 'role, phrase')}), t AS (SELECT conv_id, role, lower(text) AS said FROM conversations),
    a AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = place THEN 'allowed' ELSE 'spoilers' END AS about, phrase FROM t JOIN f ON contains(said, phrase)
      UNION ALL SELECT DISTINCT conv_id, 'contradicted', phrase FROM t JOIN s ON true JOIN d ON contains(said, denial || phrase)
      UNION ALL SELECT DISTINCT t.conv_id, 'breaches', u.role || ': ' || phrase FROM t JOIN u ON contains(said, phrase) JOIN conversations c ON c.conv_id = t.conv_id AND c.role = u.role),
    g AS (SELECT conv_id, {', '.join(f"coalesce(string_agg(phrase, '; ' ORDER BY phrase) FILTER (WHERE about = '{n}'), '') AS {n}, count(*) FILTER (WHERE about = '{n}') AS n_{n}" for n in ('spoilers', 'allowed', 'contradicted', 'breaches'))} FROM a GROUP BY 1),
    k AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT k.conv_id, {', '.join(f"coalesce({n}, '') AS {n}, CAST(coalesce(n_{n}, 0) AS INTEGER) AS n_{n}" for n in ('spoilers', 'allowed', 'contradicted', 'breaches'))} FROM k LEFT JOIN g ON k.conv_id = g.conv_id
    """,
)
def agg26_dialogue(spark, sf):
    """Spoilers without leave, denied facts and breaches of a role's knowledge per dialogue."""
    turns = table(spark, sf, "conversations")
    plan = F.when(F.col("conv_id").isNotNull(), F.element_at(F.array(*[F.lit(p) for p in _FUTURE]), (F.col("conv_id") % 4 + 1).cast("int")))
    found = signals.dialogue_signals(turns, _FUTURE, _SETTLED, _UNKNOWN, turns.select("conv_id", plan.alias("phrase")))
    names = ("spoilers", "allowed", "contradicted", "breaches")
    return found.select("conv_id", *[F.array_join(n, "; ").alias(n) for n in names], *[f"n_{n}" for n in names])


@query(
    "agg27_arm_comparison",
    """
    WITH m AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS n_a, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_b FROM orders GROUP BY 1)
    SELECT o_orderpriority, n_a, n_b, round(a, 5) AS mean_a, round(b, 5) AS mean_b, round(a - b, 5) + 0.0 AS diff, round(100 * (a - b) / abs(b), 8) + 0.0 AS pct, a > b AS improved FROM m
    """,
)
def agg27(spark, sf):
    df = table(spark, sf, "orders")
    out = agg.compare_arms(df, ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", "o_totalprice")
    return _rounded(_rounded(out, 5, "mean_a", "mean_b", "diff"), 8, "pct")


@query(
    "agg28_leakage_check",
    """
    WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_tax) AS d, count(*) FILTER (WHERE abs(l_discount - l_tax) < 1e-9) AS same FROM lineitem GROUP BY 1)
    SELECT n, count(*) AS n_groups, count(*) FILTER (WHERE d = 1 AND n > 1) AS n_single_value, round(sum(same) / sum(n), 9) AS equal_share FROM g GROUP BY n
    """,
)
def agg28(spark, sf):
    same = F.abs(F.col("l_discount") - F.col("l_tax")) < 1e-9
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.min("l_tax").alias("a"), F.max("l_tax").alias("b"), F.count_if(same).alias("same")
    )
    return g.groupBy("n").agg(
        F.count("*").alias("n_groups"), F.count_if((F.col("a") == F.col("b")) & (F.col("n") > 1)).alias("n_single_value"),
        rnd(F.sum("same") / F.sum("n"), 9).alias("equal_share"),
    )


@query(
    "agg29_array_alignment",
    """
    WITH d AS (SELECT source, len(regexp_extract_all(text, '[^.!?]+')) AS a, len(regexp_extract_all(text, '[^\\n]+')) AS b FROM documents)
    SELECT source, count(*) AS n, count(*) FILTER (WHERE a = b AND a > 0) AS aligned, count(*) FILTER (WHERE a = 0 OR b = 0) AS empty, count(*) FILTER (WHERE a <> b) AS issues FROM d GROUP BY 1
    """,
)
def agg29(spark, sf):
    df = table(spark, sf, "documents").select(
        "source", F.regexp_extract_all("text", F.lit("[^.!?]+"), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(r"[^\n]+"), F.lit(0)).alias("b")
    )
    a, b = F.size("a"), F.size("b")
    return df.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if((a == b) & (a > 0)).alias("aligned"), F.count_if((a == 0) | (b == 0)).alias("empty"), F.count_if(a != b).alias("issues")
    )


@query(
    "agg30_median_quadrants",
    """
    WITH m AS (SELECT quantile_cont(o_totalprice, .5) AS p, quantile_cont(o_custkey, .5) AS c FROM orders)
    SELECT o_totalprice > p AS high_coherence, o_custkey > c AS high_diversity, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders, m GROUP BY ALL
    """,
)
def agg30(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", "o_custkey")
    price = scalar(quantiles(df, [], "o_totalprice", {"m": 0.5}))
    cust = scalar(quantiles(df, [], "o_custkey", {"m": 0.5}))
    cells = df.groupBy((F.col("o_totalprice") > price["m"]).alias("high_coherence"), (F.col("o_custkey") > cust["m"]).alias("high_diversity"))
    return cells.agg(F.count("*").alias("n")).withColumn("share", rnd(F.col("n") / price["n"], 9))


@query(
    "agg31_rank_completeness",
    """
    WITH g AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(have) = 7 AS complete, array_to_string(list_sort(list_filter([1,2,3,4,5,6,7], lambda x: NOT list_contains(have, x))), ',') AS missing FROM g
    """,
)
def agg31(spark, sf):
    # Ranks outside the expected set are cut before the set is built.
    wanted = F.array(*[F.lit(i) for i in range(1, 8)])
    ranks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber").between(1, 7), F.col("l_linenumber"))).alias("have"))
    missing = F.sort_array(F.array_except(wanted, "have"))
    return ranks.select("l_orderkey", (F.size(missing) == 0).alias("complete"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query(
    "agg32_word_frequency",
    f"""
    WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM documents)
    SELECT word, count(*) AS n FROM t WHERE word NOT IN ({", ".join(f"'{w}'" for w in fixed.STOP_WORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 100
    """,
)
def agg32(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    counts = flat(busy_table(spark, sf, "documents"), [], words, "word").where(~F.col("word").isin(fixed.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(100)


@query(
    "agg33_log_sessions",
    """
    WITH l AS (SELECT event_type, user_id, TRY_CAST(regexp_extract('ts=' || ts || ' payload=' || props || ' end', 'payload=.*"k": ([0-9]+)', 1) AS INTEGER) AS expected FROM events),
    u AS (SELECT event_type, user_id, count(*) AS actual, max(expected) AS expected FROM l GROUP BY ALL)
    SELECT event_type, count(*) AS sessions, CAST(sum(actual) AS BIGINT) AS rounds, CAST(sum(expected) AS BIGINT) AS expected, count(*) FILTER (WHERE actual = expected) AS exact, count(*) FILTER (WHERE actual > expected) AS n_over FROM u GROUP BY 1
    """,
)
def agg33(spark, sf):
    line = F.concat(F.lit("ts="), F.col("ts").cast("string"), F.lit(" payload="), "props", F.lit(" end"))
    payload = F.regexp_extract(line, r"payload=(\{.*\})", 1)
    df = table(spark, sf, "events").select("event_type", "user_id", F.from_json(payload, "k int")["k"].alias("expected"))
    per_user = df.groupBy("event_type", "user_id").agg(F.count("*").alias("actual"), F.max("expected").alias("expected"))
    a, e = F.col("actual"), F.col("expected")
    return per_user.groupBy("event_type").agg(
        F.count("*").alias("sessions"), F.sum(a).alias("rounds"), F.sum(e).alias("expected"), F.count_if(a == e).alias("exact"), F.count_if(a > e).alias("n_over")
    )


@query(
    "agg34_deviation_classes",
    """
    WITH d AS (SELECT l_linenumber, l_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS dev FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE dev = 0) AS exact, count(*) FILTER (WHERE dev > 0) AS n_over, count(*) FILTER (WHERE dev < 0) AS n_under,
      CAST(max(dev) AS INTEGER) AS max_over, CAST(min(dev) AS INTEGER) AS max_under, arg_max(l_orderkey, {'d': dev, 'o': l_orderkey}) AS worst_over, arg_min(l_orderkey, {'d': dev, 'o': l_orderkey}) AS worst_under, round(avg(dev), 8) + 0.0 AS mean_dev FROM d GROUP BY 1
    """,
)
def agg34(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    dev = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    df = lines.join(orders, "l_orderkey").select("l_linenumber", "l_orderkey", dev.alias("dev"))
    d, key = F.col("dev"), F.struct("dev", "l_orderkey")
    return df.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(d > 0).alias("n_over"), F.count_if(d < 0).alias("n_under"),
        F.max(d).alias("max_over"), F.min(d).alias("max_under"), F.max_by("l_orderkey", key).alias("worst_over"),
        F.min_by("l_orderkey", key).alias("worst_under"), rnd(F.avg(d), 8).alias("mean_dev"),
    )


@query(
    "agg35_turn_blocks",
    """
    WITH t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 6 AS block FROM conversations)
    SELECT conv_id, block, count(*) AS n_turns, count(*) FILTER (WHERE contains(text, chr(10))) AS n_long, array_to_string(list_sort(list(DISTINCT role)), ',') AS speakers FROM t GROUP BY ALL
    """,
)
def agg35(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.contains("text", F.lit("\n")).alias("long"))
    placed = ordered(df, ["conv_id"], "turn", position=True).withColumn("block", F.floor((F.col("pos") - 1) / 6))
    return placed.groupBy("conv_id", "block").agg(
        F.count("*").alias("n_turns"), F.count_if("long").alias("n_long"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers")
    )


@query(
    "agg36_label_paths",
    """
    WITH l AS (SELECT conv_id, role, regexp_extract(text, '[\\p{L}]+') AS label, min(turn) AS first FROM conversations GROUP BY ALL)
    SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY first) AS place, label FROM l
    """,
)
def agg36(spark, sf):
    # A path is kept as rows (place on the path, label), so none outgrows a row.
    label = F.regexp_extract("text", r"[\p{L}]+", 0).alias("label")
    labels = table(spark, sf, "conversations").select("conv_id", "role", "turn", label)
    firsts = labels.groupBy("conv_id", "role", "label").agg(F.min("turn").alias("first"))
    placed = ordered(firsts, ["conv_id", "role"], "first", position=True)
    return placed.select("conv_id", "role", F.col("pos").alias("place"), "label")


_ENTITIES = [("narrator", ["the", "le", "der"]), ("other", ["that", "la", "die"])]
_POSITIVE = [w for w, s in fixed.LEXICON if s > 6]
_NEGATIVE = [w for w, s in fixed.LEXICON if s < 4]


def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "agg37_entity_polarity",
    "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^.!?\\n]+')) AS sent FROM documents), w AS (SELECT doc_id, regexp_extract_all(sent, '[\\p{L}\\p{N}]+') AS w FROM s), "
    + f"c AS (SELECT doc_id, w, len(list_filter(w, lambda x: list_contains({_list_sql(_POSITIVE)}, x))) AS pos, len(list_filter(w, lambda x: list_contains({_list_sql(_NEGATIVE)}, x))) AS neg FROM w), e AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS entity, pos, neg FROM c WHERE list_has_any(w, {_list_sql(a)})" for n, a in _ENTITIES)
    + """)
    SELECT doc_id, entity, count(*) AS n_sentences, CASE WHEN sum(pos) + sum(neg) > 0 THEN round((sum(pos) - sum(neg)) / (sum(pos) + sum(neg)), 9) + 0.0 END AS polarity FROM e GROUP BY ALL""",
)
def agg37(spark, sf):
    sentences = F.regexp_extract_all(F.lower("text"), F.lit(r"[^.!?\n]+"), F.lit(0))
    words = F.regexp_extract_all("sent", F.lit(WORD), F.lit(0)).alias("w")
    df = flat(busy_table(spark, sf, "documents"), ["doc_id"], sentences, "sent").select("doc_id", words)
    among = lambda names: F.array(*[F.lit(n) for n in names])
    hits = lambda names: F.size(F.filter("w", lambda x: x.isin(names)))
    who = F.array_compact(F.array(*[F.when(F.arrays_overlap("w", among(a)), F.lit(n)) for n, a in _ENTITIES]))
    rows = flat(df, ["doc_id", hits(_POSITIVE).alias("pos"), hits(_NEGATIVE).alias("neg")], who, "entity")
    totals = rows.groupBy("doc_id", "entity").agg(F.count("*").alias("n_sentences"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return totals.select("doc_id", "entity", "n_sentences", rnd(ratio(F.col("p") - F.col("q"), F.col("p") + F.col("q")), 9).alias("polarity"))


@query(
    "agg38_value_counts",
    """
    SELECT 'status' AS question, o_orderstatus AS answer, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
    """,
)
def agg38(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderstatus as status", "o_orderpriority as priority")
    return agg.value_counts_many(df, ["status", "priority"])


@query(
    "top1_best_and_worst",
    """
    (SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
    UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)
    """,
)
def top1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).withColumn("side", F.lit("top"))
    bottom = df.orderBy("o_totalprice", "o_orderkey").limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


@query(
    "top2_per_group",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders) WHERE place <= 2
    """,
)
def top2(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.top_k(df, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query(
    "top3_ordered_collection",
    """
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY -length(text), turn) AS place, role || ':' || length(text) AS entry FROM conversations
    """,
)
def top3(spark, sf):
    # The timeline stays rows in order; places come from the lane-split order.
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role", (-F.length("text")).alias("k"))
    placed = ordered(df, ["conv_id"], "k", ["turn"], position=True)
    return placed.select("conv_id", F.col("pos").alias("place"), F.concat("role", F.lit(":"), -F.col("k")).alias("entry"))


@query("set1_union", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def set1(spark, sf):
    nations = table(spark, sf, "nation").selectExpr("n_nationkey as id", "n_name as name")
    return nations.unionByName(table(spark, sf, "region").selectExpr("r_regionkey as id", "r_name as name"))


def _early_late(spark, sf):
    df = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    cols = ["o_custkey", "o_orderpriority"]
    return df.where(F.col("o_orderdate") < cut).select(*cols), df.where(F.col("o_orderdate") >= cut).select(*cols)


@query(
    "set2_intersection",
    """
    SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < '1998-01-01' INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= '1998-01-01'
    """,
)
def set2(spark, sf):
    early, late = _early_late(spark, sf)
    return early.intersect(late)


@query(
    "set3_difference",
    """
    SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < '1998-01-01' EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= '1998-01-01'
    """,
)
def set3(spark, sf):
    early, late = _early_late(spark, sf)
    return early.exceptAll(late)


@query(
    "set4_overlap_ratio",
    """
    WITH d AS (SELECT doc_id, list_distinct(string_split(regexp_extract(lower(text), '^[^.\\n]*'), '')) AS a, list_distinct(string_split(source || lang, '')) AS b FROM documents),
    x AS (SELECT doc_id, a, b, len(list_intersect(a, b)) AS i FROM d)
    SELECT doc_id, round(i / (len(a) + len(b) - i), 9) AS overlap, i / (len(a) + len(b) - i) > .6 AS similar FROM x
    """,
)
def set4(spark, sf):
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\s\S]"), F.lit(0)))
    df = table(spark, sf, "documents").select(
        "doc_id", chars(F.regexp_extract(F.lower("text"), r"^[^.\n]*", 0)).alias("a"), chars(F.concat("source", "lang")).alias("b")
    )
    share = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return df.select("doc_id", rnd(share, 9).alias("overlap"), (share > 0.6).alias("similar"))

"""Projections, filters, scores and scalar parsing on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge.functions.common import inline, ratio, rnd, scalar, sql_values
from corpusgauge.functions.records import parsed_list, parsed_ratio, truthy
from corpusgauge.operators import scoring
from corpusgauge.operators.tables import completeness, varying_columns
from corpusgauge.plans.ordered import ordered, quantiles
from corpusgauge.registry import query
from corpusgauge.sources import readers
from corpusgauge.sources.tables import busy_table, table


@query(
    "prj1_baseline_split",
    """
    SELECT o_orderkey, o_orderstatus = 'F' AS is_baseline,
      TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS score
    FROM orders
    """,
)
def prj1(spark, sf):
    flag = F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("0")
    raw = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", truthy(flag).alias("is_baseline"), raw.try_cast("double").alias("score"))


@query(
    "prj2_ratio_columns",
    """
    SELECT l_returnflag, l_linestatus, count(cost_per_1k) AS n_cost, round(avg(cost_per_1k), 4) AS cost_per_1k,
      round(avg(effectiveness), 8) AS effectiveness, count(time_per_quality) AS n_time, round(avg(time_per_quality), 5) AS time_per_quality
    FROM (SELECT l_returnflag, l_linestatus, l_extendedprice / (l_quantity * 10) * 1000 AS cost_per_1k,
            (1 - l_discount) / l_extendedprice * 1000 AS effectiveness,
            CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS time_per_quality FROM lineitem)
    GROUP BY ALL
    """,
)
def prj2(spark, sf):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    df = table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (ratio(price, quantity * 10) * 1000).alias("cost_per_1k"),
        (ratio(1 - F.col("l_discount"), price) * 1000).alias("effectiveness"),
        ratio(quantity, F.col("l_tax")).alias("time_per_quality"),
    )
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("cost_per_1k").alias("n_cost"),
        rnd(F.avg("cost_per_1k"), 4).alias("cost_per_1k"),
        rnd(F.avg("effectiveness"), 8).alias("effectiveness"),
        F.count("time_per_quality").alias("n_time"),
        rnd(F.avg("time_per_quality"), 5).alias("time_per_quality"),
    )


@query(
    "prj3_weighted_composite",
    """
    SELECT l_suppkey, count(*) AS n, round(avg(.3 * (1 - l_discount) + .3 * l_quantity / 50 + .2 * l_tax + .2 * (l_linenumber / 7)), 8) AS quality
    FROM lineitem GROUP BY l_suppkey
    """,
)
def prj3(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_suppkey",
        (1 - F.col("l_discount")).alias("uniqueness"),
        (F.col("l_quantity") / 50).alias("coherence"),
        F.col("l_tax").alias("distinct"),
        (F.col("l_linenumber") / 7).alias("group_diversity"),
    )
    # Fixed weights of the published quality score.
    score = scoring.weighted_sum({"uniqueness": 0.3, "coherence": 0.3, "distinct": 0.2, "group_diversity": 0.2})
    return df.groupBy("l_suppkey").agg(F.count("*").alias("n"), rnd(F.avg(score), 8).alias("quality"))


@query(
    "prj4_threshold_buckets",
    """
    WITH b AS (SELECT CASE WHEN o_totalprice < 100000 THEN 'excellent' WHEN o_totalprice < 300000 THEN 'good' ELSE 'poor' END AS ppl_quality,
      CASE WHEN o_orderpriority < '2' THEN 'high_quality' WHEN o_orderpriority < '4' THEN 'medium_quality' ELSE 'poor_quality' END AS error_quality FROM orders),
    s AS (SELECT *, ((CASE ppl_quality WHEN 'excellent' THEN 3 WHEN 'good' THEN 2 ELSE 1 END) +
        (CASE error_quality WHEN 'high_quality' THEN 3 WHEN 'medium_quality' THEN 2 ELSE 1 END)) / 2 AS mean_rank FROM b)
    SELECT ppl_quality, error_quality, CASE WHEN mean_rank >= 2.5 THEN 'high' WHEN mean_rank >= 1.5 THEN 'medium' ELSE 'low' END AS combined,
      count(*) AS n FROM s GROUP BY ALL
    """,
)
def prj4(spark, sf):
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    df = table(spark, sf, "orders").select(
        scoring.bands(F.col("o_totalprice"), [(100000, "excellent"), (300000, "good")], "poor").alias("ppl_quality"),
        scoring.bands(priority, [(2, "high_quality"), (4, "medium_quality")], "poor_quality").alias("error_quality"),
    )
    points = lambda c, best, mid: F.when(F.col(c) == best, 3).when(F.col(c) == mid, 2).otherwise(1)
    mean_rank = (points("ppl_quality", "excellent", "good") + points("error_quality", "high_quality", "medium_quality")) / 2
    combined = F.when(mean_rank >= 2.5, "high").when(mean_rank >= 1.5, "medium").otherwise("low")
    return df.withColumn("combined", combined).groupBy("ppl_quality", "error_quality", "combined").agg(F.count("*").alias("n"))


@query(
    "prj5_equal_width_tiers",
    """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    t AS (SELECT o_orderpriority, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 3) + 1 AS INTEGER), 3) AS tier FROM orders, e)
    SELECT o_orderpriority AS config, count(*) FILTER (WHERE tier = 1) AS low, count(*) FILTER (WHERE tier = 2) AS mid,
      count(*) FILTER (WHERE tier = 3) AS high FROM t GROUP BY ALL
    """,
)
def prj5(spark, sf):
    df = table(spark, sf, "orders")
    ends = scalar(df.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))
    tier = scoring.equal_width_tier(F.col("o_totalprice"), ends["lo"], ends["hi"], 3)
    counts = df.withColumn("tier", tier).groupBy(F.col("o_orderpriority").alias("config")).pivot("tier", [1, 2, 3]).count()
    return counts.select("config", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(n) for i, n in ((1, "low"), (2, "mid"), (3, "high"))])


@query(
    "prj6_optimal_range",
    """
    WITH c AS (SELECT greatest(8, least(14, quantile_cont(p_size, .95))) AS upper FROM part)
    SELECT p_partkey, round(CASE WHEN p_size < 5 THEN p_size / 5 WHEN p_size <= 8 THEN 1.0 ELSE greatest(0, 1 - (p_size - 8) / 8) END, 6) + 0.0 AS fixed_range,
      round(CASE WHEN p_size < 5 THEN p_size / 5 WHEN p_size <= upper THEN 1.0 ELSE greatest(0, 1 - (p_size - upper) / upper) END, 6) + 0.0 AS clipped_range
    FROM part, c
    """,
)
def prj6(spark, sf):
    df = table(spark, sf, "part")
    p95 = scalar(quantiles(df, [], "p_size", {"p95": 0.95}))["p95"]
    upper = F.greatest(F.lit(8.0), F.least(F.lit(14.0), p95))
    size = F.col("p_size").cast("double")
    return df.select(
        "p_partkey",
        rnd(scoring.optimal_range(size, 5, 8.0)).alias("fixed_range"),
        rnd(scoring.optimal_range(size, 5, upper)).alias("clipped_range"),
    )


_CARD_SQL = """
    WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS chars, CAST(len(regexp_extract_all(text, '[^ \\n]+')) AS DOUBLE) AS words,
        CAST(len(regexp_extract_all(text, '[.!?]+')) AS DOUBLE) AS sentences,
        CAST(len(regexp_extract_all(text, '\\n')) + 1 AS DOUBLE) AS chapters,
        CAST(len(regexp_extract_all(text, '[,;:]')) AS DOUBLE) AS casting FROM documents)
"""


@query(
    "prj7_quality_card",
    _CARD_SQL
    + """,
    s AS (SELECT doc_id,
      CASE WHEN words > 0 AND sentences > 0 THEN least(25, (CASE WHEN words/sentences < 5 THEN words/sentences/5*15
          WHEN words/sentences > 25 THEN greatest(15, 25-(words/sentences-25)*.5) ELSE 25 END) + least(chars/words/2.5*10, 10)) ELSE 0 END AS text_richness,
      CASE WHEN words > 0 THEN least(25, (CASE WHEN words/chapters BETWEEN 300 AND 800 THEN 15 WHEN words/chapters < 300 THEN words/chapters/300*15
          ELSE greatest(10, 15-(words/chapters-800)/200) END) + (CASE WHEN chapters BETWEEN 3 AND 15 THEN 10 WHEN chapters < 3 THEN chapters/3*10
          ELSE greatest(5, 10-(chapters-15)*.3) END)) ELSE 0 END AS story_structure,
      CASE WHEN casting > 0 THEN least(25, (CASE WHEN casting BETWEEN 2 AND 8 THEN 15 WHEN casting = 1 THEN 10 ELSE greatest(8, 15-abs(casting-5)) END)
          + least(chars/50, 10)) ELSE 0 END AS content_consistency,
      CASE WHEN sentences > 0 THEN (CASE WHEN sentences/chapters BETWEEN 10 AND 40 THEN 25 WHEN sentences/chapters < 10 THEN sentences/chapters/10*25
          ELSE greatest(15, 25-(sentences/chapters-40)*.2) END) ELSE 0 END AS text_coherence FROM d)
    SELECT doc_id, round(text_richness, 9) + 0.0 AS text_richness, round(story_structure, 9) + 0.0 AS story_structure,
      round(content_consistency, 9) + 0.0 AS content_consistency, round(text_coherence, 9) + 0.0 AS text_coherence,
      round(text_richness + story_structure + content_consistency + text_coherence, 9) + 0.0 AS total FROM s
    """,
)
def prj7_quality(spark, sf):
    df = busy_table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").alias("chars"),
        F.regexp_count("text", F.lit(r"[^ \n]+")).alias("words"),
        F.regexp_count("text", F.lit("[.!?]+")).alias("sentences"),
        (F.regexp_count("text", F.lit("\n")) + 1).alias("chapters"),
        F.regexp_count("text", F.lit("[,;:]")).alias("casting"),
    )
    card = scoring.quality_card(*[F.col(c) for c in ("words", "chars", "sentences", "chapters", "casting", "chars")])
    scored = df.select("doc_id", *[c.alias(n) for n, c in card.items()])
    total = sum((F.col(n) for n in card), F.lit(0.0))
    return scored.select("doc_id", *[rnd(n, 9).alias(n) for n in card], rnd(total, 9).alias("total"))


def _user_totals_sql(extra: str) -> str:
    return (
        "WITH u AS (SELECT user_id, count(*) * 100 AS words, sum(value) AS seconds, sum(value) / 2000 AS cost, max(value) AS memory, "
        "CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS tokens FROM events GROUP BY user_id) " + extra
    )


def _step_sql(amount: str, full: float, passing: float, slope: float) -> str:
    return (
        f"CASE WHEN {amount}/words <= {full} THEN 25 WHEN {amount}/words <= {passing} "
        f"THEN 15 + ({passing} - {amount}/words)/({passing} - {full})*10 ELSE greatest(5, 15 - ({amount}/words - {passing})*{slope}) END"
    )


@query(
    "prj7_efficiency_card",
    _user_totals_sql(
        f"""
    SELECT user_id, round(CASE WHEN words/seconds >= 3 THEN 25 WHEN words/seconds >= 1 THEN 15 + (words/seconds - 1)/2*10 ELSE words/seconds*15 END, 5) + 0.0 AS time_efficiency,
      round({_step_sql('cost', 0.0005, 0.002, 5000)}, 5) + 0.0 AS cost_efficiency,
      round({_step_sql('memory', 0.005, 0.02, 500)}, 5) + 0.0 AS memory_efficiency,
      round({_step_sql('tokens', 1.5, 3.0, 5)}, 5) + 0.0 AS token_efficiency FROM u"""
    ),
)
def prj7_efficiency(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    totals = table(spark, sf, "events").groupBy("user_id").agg(
        (F.count("*") * 100).alias("words"),
        F.sum("value").alias("seconds"),
        (F.sum("value") / 2000).alias("cost"),
        F.max("value").alias("memory"),
        F.sum(k).cast("double").alias("tokens"),
    )
    card = scoring.efficiency_card(*[F.col(c) for c in ("words", "seconds", "cost", "memory", "tokens")])
    return totals.select("user_id", *[rnd(c, 5).alias(n) for n, c in card.items()])


@query(
    "prj8_varying_columns",
    """
    SELECT 'l_quantity' AS metric, count(DISTINCT l_quantity) > 1 AS kept FROM lineitem UNION ALL
    SELECT 'l_tax', count(DISTINCT l_tax) > 1 FROM lineitem UNION ALL
    SELECT 'fixed', count(DISTINCT l_linenumber * 0) > 1 FROM lineitem
    """,
)
def prj8(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("fixed", F.col("l_linenumber") * 0)
    return varying_columns(df, ["l_quantity", "l_tax", "fixed"])


@query(
    "prj9_completeness",
    """
    WITH d AS (SELECT CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax,
        CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_discount END AS discount, l_quantity AS quantity FROM lineitem)
    SELECT 'tax' AS metric, round(avg(CASE WHEN tax IS NULL THEN 0 ELSE 1 END), 6) AS filled, round(avg(CASE WHEN tax IS NULL THEN 0 ELSE 1 END), 6) AS finite, true AS flagged FROM d
    UNION ALL SELECT 'discount', 1.0, round(avg(CASE WHEN isfinite(discount) THEN 1 ELSE 0 END), 6), avg(CASE WHEN isfinite(discount) THEN 1 ELSE 0 END) < .95 FROM d
    UNION ALL SELECT 'quantity', 1.0, 1.0, false
    """,
)
def prj9(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_discount")).alias("discount"),
        F.col("l_quantity").alias("quantity"),
    )
    report = completeness(df, ["tax", "discount", "quantity"], 0.95)
    return report.select("metric", rnd("filled").alias("filled"), rnd("finite").alias("finite"), "flagged")


_ADVICE = [
    ("price", 0.0, 150000.0, "raise detail"),
    ("price", 300000.0, 1e12, "cut cost"),
    ("share", 0.0, 0.4, "too few urgent"),
    ("share", 0.4, 1.01, "urgent share fine"),
]


@query(
    "prj10_advice_rules",
    f"""
    WITH s AS (SELECT o_custkey, avg(o_totalprice) AS price, avg(CASE WHEN o_orderpriority < '3' THEN 1.0 ELSE 0.0 END) AS share FROM orders GROUP BY 1),
    l AS (SELECT o_custkey, 'price' AS part, price AS score FROM s UNION ALL SELECT o_custkey, 'share', share FROM s),
    r AS (SELECT * FROM {sql_values(_ADVICE, "part, low, high, advice")})
    SELECT o_custkey, coalesce(string_agg(advice, '; ' ORDER BY advice), 'keep watching') AS advice
    FROM l LEFT JOIN r ON l.part = r.part AND score >= low AND score < high GROUP BY o_custkey
    """,
)
def prj10(spark, sf):
    scores = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("price"),
        F.avg(F.when(F.col("o_orderpriority") < "3", 1.0).otherwise(0.0)).alias("share"),
    )
    parts = scores.unpivot(["o_custkey"], ["price", "share"], "part", "score")
    rules = inline(spark, _ADVICE, "rule string, low double, high double, advice string")
    hit = (F.col("part") == F.col("rule")) & (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high"))
    joined = parts.join(rules, hit, "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list("advice")).alias("a"))
    return joined.select("o_custkey", F.when(F.size("a") > 0, F.array_join("a", "; ")).otherwise("keep watching").alias("advice"))


@query(
    "prj11_health_shares",
    """
    WITH m AS (SELECT 'distinct' AS metric, l_discount * 10 AS v, .6 AS hi, .5 AS lo FROM lineitem
               UNION ALL SELECT 'diversity', l_quantity / 50, .7, .3 FROM lineitem)
    SELECT metric, count(*) AS n, count(*) FILTER (WHERE v > hi) AS n_high, count(*) FILTER (WHERE v < lo) AS n_low,
      round(100.0 * count(*) FILTER (WHERE v > hi) / count(*), 6) AS pct_high, round(100.0 * count(*) FILTER (WHERE v < lo) / count(*), 6) AS pct_low,
      count(*) FILTER (WHERE v > hi) > count(*) FILTER (WHERE v < lo) AS met FROM m GROUP BY metric
    """,
)
def prj11(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("distinct"), (F.col("l_quantity") / 50).alias("diversity"))
    # Fixed limits of the health report.
    limits = {"distinct": (0.6, 0.5), "diversity": (0.7, 0.3)}
    counts = [
        F.struct(
            F.lit(m).alias("metric"), F.count(m).alias("n"),
            F.count_if(F.col(m) > hi).alias("n_high"), F.count_if(F.col(m) < lo).alias("n_low"),
        )
        for m, (hi, lo) in limits.items()
    ]
    rows = df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
    return rows.select(
        "*",
        rnd(100 * ratio(F.col("n_high"), F.col("n"))).alias("pct_high"),
        rnd(100 * ratio(F.col("n_low"), F.col("n"))).alias("pct_low"),
        (F.col("n_high") > F.col("n_low")).alias("met"),
    )


@query(
    "prj12_range_rules",
    """
    SELECT 'discount in [0,1]' AS rule, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 1)) AS n_bad,
           count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 1)) = 0 AS passed FROM lineitem
    UNION ALL SELECT 'quantity in [-1,1]', count(*) FILTER (WHERE NOT (l_quantity BETWEEN -1 AND 1)), count(*) FILTER (WHERE NOT (l_quantity BETWEEN -1 AND 1)) = 0 FROM lineitem
    UNION ALL SELECT 'high discount implies low tax', count(*) FILTER (WHERE l_discount > .08 AND l_tax > .04), count(*) FILTER (WHERE l_discount > .08 AND l_tax > .04) = 0 FROM lineitem
    """,
)
def prj12(spark, sf):
    broken = {
        "discount in [0,1]": ~F.col("l_discount").between(0, 1),
        "quantity in [-1,1]": ~F.col("l_quantity").between(-1, 1),
        "high discount implies low tax": (F.col("l_discount") > 0.08) & (F.col("l_tax") > 0.04),
    }
    one = table(spark, sf, "lineitem").agg(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("n_bad")) for n, c in broken.items()]).alias("r")
    )
    return one.select(F.inline("r")).withColumn("passed", F.col("n_bad") == 0)


@query(
    "mth1_ratio_strings",
    """
    WITH s AS (SELECT l_linenumber AS k, CASE WHEN l_returnflag = 'A' THEN l_linenumber || '/' || CAST(l_quantity AS INTEGER) || ' (note)'
        WHEN l_returnflag = 'N' THEN ' ' || CAST(l_discount AS VARCHAR) ELSE 'bad ' || l_linenumber END AS txt FROM lineitem),
    p AS (SELECT k, CASE WHEN txt LIKE '%(note)' THEN k / CAST(regexp_extract(txt, '/([0-9]+)', 1) AS DOUBLE) WHEN txt LIKE ' %' THEN CAST(trim(txt) AS DOUBLE) END AS ratio,
        CAST(nullif(regexp_extract(txt, '/([0-9]+)', 1), '') AS DOUBLE) AS bottom FROM s)
    SELECT k, count(*) AS n, count(ratio) AS n_ratio, round(avg(ratio), 8) AS mean_ratio, round(sum(bottom), 2) AS sum_bottom FROM p GROUP BY k
    """,
)
def mth1(spark, sf):
    text = (
        F.when(F.col("l_returnflag") == "A", F.concat("l_linenumber", F.lit("/"), F.col("l_quantity").cast("int"), F.lit(" (note)")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit(" "), F.col("l_discount").cast("string")))
        .otherwise(F.concat(F.lit("bad "), "l_linenumber"))
    )
    df = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("k"), text.alias("txt"))
    parsed = df.select("k", *[c.alias(n) for n, c in parsed_ratio(F.col("txt")).items()])
    return parsed.groupBy("k").agg(
        F.count("*").alias("n"), F.count("ratio").alias("n_ratio"), rnd(F.avg("ratio"), 8).alias("mean_ratio"), rnd(F.sum("bottom"), 2).alias("sum_bottom")
    )


@query(
    "mth2_list_strings",
    """
    SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE 64 END AS n,
      CASE WHEN label = 0 THEN NULL ELSE round(list_sum(embedding::DOUBLE[]), 5) + 0.0 END AS total FROM embeddings
    """,
)
def mth2(spark, sf):
    text = F.when(F.col("label") == 0, "[0.1, bad").otherwise(F.to_json(F.col("embedding").cast("array<double>")))
    df = table(spark, sf, "embeddings").select("vec_id", parsed_list(text).alias("xs"))
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.size("xs").alias("n"), F.when(F.size("xs") > 0, rnd(total, 5)).alias("total"))


@query(
    "mth3_min_max",
    """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 8) AS higher_better, round(1 - (o_totalprice - lo) / (hi - lo), 8) AS lower_better, .5::DOUBLE AS constant FROM orders, e
    """,
)
def mth3(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("flat"))
    df = scoring.min_max(df, "o_totalprice", "higher_better")
    df = scoring.min_max(df, "o_totalprice", "lower_better", higher_better=False)
    df = scoring.min_max(df, "flat", "constant")
    return df.select("o_orderkey", rnd("higher_better", 8).alias("higher_better"), rnd("lower_better", 8).alias("lower_better"), "constant")


@query(
    "mth4_robust_scale",
    """
    WITH e AS (SELECT quantile_cont(n_chars, .05) AS lo, quantile_cont(n_chars, .95) AS hi FROM documents)
    SELECT doc_id, round(least(1, greatest(0, (n_chars - lo) / (hi - lo))), 8) + 0.0 AS higher_better,
      round(1 - least(1, greatest(0, (n_chars - lo) / (hi - lo))), 8) + 0.0 AS lower_better FROM documents, e
    """,
)
def mth4(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    df = scoring.robust_scale(df, "n_chars", "higher_better")
    df = scoring.robust_scale(df, "n_chars", "lower_better", higher_better=False)
    return df.select("doc_id", rnd("higher_better", 8).alias("higher_better"), rnd("lower_better", 8).alias("lower_better"))


@query(
    "mth5_winsorize_log1p",
    """
    WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders),
    e AS (SELECT min(CASE WHEN i >= floor(n * .02) THEN o_totalprice END) AS lo, max(CASE WHEN i <= n - floor(n * .02) - 1 THEN o_totalprice END) AS hi FROM r)
    SELECT o_orderkey, least(hi, greatest(lo, o_totalprice)) AS winsorized, round(ln(1 + o_totalprice), 8) AS logged FROM orders, e
    """,
)
def mth5(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    clipped = scoring.winsorized(df, "o_totalprice", 0.02)
    return clipped.select("o_orderkey", "winsorized", rnd(F.log1p("o_totalprice"), 8).alias("logged"))


@query(
    "mth6_conservative_min",
    """
    WITH e AS (SELECT quantile_cont(l_quantity, .2) AS p20 FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (WHERE l_quantity < p20) AS n_short, round(avg(least(1 - l_discount, 1 - l_tax)), 8) AS fluency,
      round(avg(l_discount * 10 * CASE WHEN l_quantity < p20 THEN .97 ELSE 1 END), 8) AS diversity,
      round(avg((least(1 - l_discount, 1 - l_tax) + l_discount * 10 * CASE WHEN l_quantity < p20 THEN .97 ELSE 1 END) / 2), 8) AS overall
    FROM lineitem, e GROUP BY l_suppkey
    """,
)
def mth6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax")
    short = F.col("l_quantity") < scalar(quantiles(df, [], "l_quantity", {"p20": 0.2}))["p20"]
    scored = df.select(
        "l_suppkey",
        short.alias("short"),
        F.least(1 - F.col("l_discount"), 1 - F.col("l_tax")).alias("fluency"),
        (F.col("l_discount") * 10 * F.when(short, 0.97).otherwise(1.0)).alias("diversity"),
    )
    return scored.groupBy("l_suppkey").agg(
        F.count_if("short").alias("n_short"),
        rnd(F.avg("fluency"), 8).alias("fluency"),
        rnd(F.avg("diversity"), 8).alias("diversity"),
        rnd(F.avg((F.col("fluency") + F.col("diversity")) / 2), 8).alias("overall"),
    )


@query(
    "mth7_length_normalised",
    "SELECT doc_id, round(100 / ln(n_chars + 1), 8) AS by_log, round(100 / sqrt(n_chars + 1), 8) AS by_root FROM documents",
)
def mth7(spark, sf):
    n = F.col("n_chars") + 1
    # Spark fails on a divisor of 0 and has no logarithm of 0; the SQL's values are infinite.
    over = lambda x: F.when(x == 0, float("inf")).otherwise(100 / F.nullif(x, F.lit(0.0)))
    log = F.when(n == 0, float("-inf")).otherwise(F.log(n))
    return table(spark, sf, "documents").select("doc_id", rnd(over(log), 8).alias("by_log"), rnd(over(F.sqrt(n)), 8).alias("by_root"))


@query(
    "mth8_complexity_rates",
    """
    WITH u AS (SELECT user_id, sum(value) AS t, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id)
    SELECT user_id, round(t / n, 8) AS linear, CASE WHEN n > 1 THEN round(t / (n * ln(n)), 8) END AS n_log_n, round(t / sqrt(n), 8) AS root,
      round(t / (n * n), 8) AS quadratic, round(n / (t / 60), 8) AS per_minute FROM u
    """,
)
def mth8(spark, sf):
    df = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("t"), F.count("*").cast("double").alias("n"))
    t, n = F.col("t"), F.col("n")
    return df.select(
        "user_id",
        rnd(ratio(t, n), 8).alias("linear"),
        rnd(ratio(t, n * F.log(n)), 8).alias("n_log_n"),
        rnd(ratio(t, F.sqrt(n)), 8).alias("root"),
        rnd(ratio(t, n * n), 8).alias("quadratic"),
        rnd(ratio(n, t / 60), 8).alias("per_minute"),
    )


@query(
    "map1_map_of_map",
    """
    SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place, md5(text) AS state_md5 FROM conversations
    """,
)
def map1(spark, sf):
    # One turn's map of map (conversation -> role -> state) flattened to rows; the
    # rebuilt nesting is an ordered list per (conversation, role), kept as rows with
    # places, so no row holds a whole conversation.
    nested = F.create_map("conv_id", F.create_map("role", "text")).alias("story")
    stories = table(spark, sf, "conversations").select("turn", nested)
    outer = stories.select("turn", F.explode("story").alias("conv_id", "roles"))
    rows = outer.select("turn", "conv_id", F.explode("roles").alias("role", "state"))
    placed = ordered(rows.withColumn("state_md5", F.md5("state")).drop("state"), ["conv_id", "role"], "turn", position=True)
    return placed.select("conv_id", "role", F.col("pos").alias("place"), "state_md5")


@query(
    "map1_nested_rebuild",
    """
    WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations),
    i AS (SELECT conv_id, turn, 'r' || (length(line) % 3) AS outer_key, 'k' || (length(line) % 5) AS inner_key, string_agg(CAST(length(line) AS VARCHAR), ',' ORDER BY place) AS items, count(*) AS n FROM l GROUP BY ALL),
    o AS (SELECT conv_id, turn, outer_key, string_agg('"' || inner_key || '":[' || items || ']', ',' ORDER BY inner_key) AS inside, count(*) AS n_inner, sum(n) AS n FROM i GROUP BY ALL)
    SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS n_outer, CAST(sum(n_inner) AS BIGINT) AS n_inner, CAST(sum(n) AS BIGINT) AS n_items, '{' || string_agg('"' || outer_key || '":{' || inside || '}', ',' ORDER BY outer_key) || '}' AS rebuilt, true AS same FROM o GROUP BY ALL
    """,
)
def map1_rebuild(spark, sf):
    """A map of maps of lists out of its JSON text to rows, and back from the rows; ``same`` compares with what was read."""
    sizes = F.transform(F.split("text", "\n"), F.length)

    def grouped(items, divisor, letter, inside):
        keys = F.array_sort(F.array_distinct(F.transform(items, lambda x: x % divisor)))
        entry = lambda k: F.struct(F.concat(F.lit(letter), k.cast("string")), inside(F.filter(items, lambda x: x % divisor == k)))
        return F.map_from_entries(F.transform(keys, entry))

    nested = grouped(sizes, 3, "r", lambda own: grouped(own, 5, "k", lambda items: items))
    texts = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(nested).alias("json"))
    docs = texts.withColumn("doc", readers.report(F.col("json")))
    roles = readers.report_entries(docs, "doc", "$", "outer_key", "states").drop("doc")
    states = readers.report_entries(roles, "states", "$", "inner_key", "items").drop("states")
    rows = readers.report_items(states, "items", "$", "place", "item").drop("items").withColumn("item", readers.report_field(F.col("item"), "$", "int"))
    # Each step holds what one report holds, no more.
    per = ["conv_id", "turn", "json"]
    lists = rows.groupBy(*per, "outer_key", "inner_key").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("list"))
    inner = lists.groupBy(*per, "outer_key").agg(F.array_sort(F.collect_list(F.struct("inner_key", F.col("list.item").alias("item")))).alias("list"))
    outer = inner.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct("outer_key", "list"))).alias("list"))
    rebuilt = F.map_from_entries(F.transform("list", lambda o: F.struct(o["outer_key"], F.map_from_entries(o["list"]))))
    n_inner = F.aggregate("list", F.lit(0).cast("long"), lambda n, o: n + F.size(o["list"]))
    n_items = F.aggregate("list", F.lit(0).cast("long"), lambda n, o: n + F.aggregate(o["list"], F.lit(0).cast("long"), lambda m, i: m + F.size(i["item"])))
    out = outer.select(*per, F.size("list").cast("long").alias("n_outer"), n_inner.alias("n_inner"), n_items.alias("n_items"), F.to_json(rebuilt).alias("rebuilt"))
    return out.select("conv_id", "turn", "n_outer", "n_inner", "n_items", "rebuilt", (F.col("rebuilt") == F.col("json")).alias("same"))


@query(
    "jsn1_fields_with_defaults",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 0 AS missing, 'none' AS label FROM events
    """,
)
def jsn1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"),
        F.coalesce(F.get_json_object("props", "$.a.b").try_cast("int"), F.lit(0)).alias("missing"),
        F.coalesce(F.get_json_object("props", "$.label"), F.lit("none")).alias("label"),
    )


@query(
    "dat1_stage_durations",
    """
    WITH d AS (SELECT user_id, event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events)
    SELECT event_type, count(us) AS n, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS longest_us FROM d GROUP BY event_type
    """,
)
def dat1(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    walked = ordered(df, ["user_id"], "ts", ["event_id"], nxt=["ts"])
    timed = walked.withColumn("next_ts", F.col("nxt.ts")).withColumn("us", F.expr("timestampdiff(MICROSECOND, ts, next_ts)"))
    return timed.groupBy("event_type").agg(F.count("us").alias("n"), F.sum("us").alias("total_us"), F.max("us").alias("longest_us"))

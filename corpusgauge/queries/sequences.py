"""Window-type operators and array series on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge.functions.common import ratio, rnd, scalar
from corpusgauge.operators import sequences as seq
from corpusgauge.operators.aggregates import top_k
from corpusgauge.plans.ordered import average_rank, ordered
from corpusgauge.registry import query
from corpusgauge.sources.tables import table

_SIMS_SQL = """
    v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS gap FROM embeddings),
    s AS (SELECT label, vec_id, gap, list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) AS similarity FROM v WHERE p IS NOT NULL)
"""


def _sims(spark, sf):
    return seq.adjacent_similarity(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding")


def _events(spark, sf, *extra):
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "value", *extra)


def _round(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


@query("win1_adjacent_similarity", f"WITH {_SIMS_SQL} SELECT label, vec_id, gap, round(similarity, 8) + 0.0 AS similarity FROM s")
def win1(spark, sf):
    return _round(_sims(spark, sf), 8, "similarity")


@query(
    "win2_breakpoints",
    f"""WITH {_SIMS_SQL}, m AS (SELECT label, avg(similarity) - stddev_pop(similarity) AS cut FROM s GROUP BY 1)
    SELECT label, gap AS position, round(similarity, 8) + 0.0 AS similarity FROM s JOIN m USING (label) WHERE similarity < cut""",
)
def win2(spark, sf):
    low = seq.breakpoints(_sims(spark, sf), ["label"])
    return low.select("label", F.col("gap").alias("position"), rnd("similarity", 8).alias("similarity"))


@query(
    "win3_high_segments",
    """
    WITH m AS (SELECT user_id, avg(value) + .5 * stddev_pop(value) AS cut FROM events GROUP BY 1),
    r AS (SELECT user_id, value, value > cut AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events JOIN m USING (user_id)),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM r WHERE high)
    SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS length, round(avg(value), 9) AS average FROM i GROUP BY user_id, island HAVING count(*) >= 2
    """,
)
def win3(spark, sf):
    return _round(seq.high_segments(_events(spark, sf), ["user_id"], "ts", "value", ["event_id"]), 9, "average")


@query(
    "win4_moving_average",
    """
    WITH r AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3,
        avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(CASE WHEN pos IN (1, n) THEN value ELSE m3 END, 8) AS ma3, round(m5, 8) AS ma5 FROM r
    """,
)
def win4(spark, sf):
    out = seq.moving_averages(_events(spark, sf), ["user_id"], "ts", "value", ["event_id"])
    return out.select("event_id", rnd("ma3", 8).alias("ma3"), rnd("ma5", 8).alias("ma5"))


@query(
    "win5_exponential_smoothing",
    """
    WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
    s AS (SELECT conv_id, turn, pos, x::DOUBLE AS s FROM r WHERE pos = 1 UNION ALL SELECT r.conv_id, r.turn, r.pos, .3 * r.x + .7 * s.s FROM s JOIN r ON r.conv_id = s.conv_id AND r.pos = s.pos + 1)
    SELECT conv_id, turn, round(s, 7) AS smoothed FROM s
    """,
)
def win5(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("x"))
    return seq.exponential_smoothing(df, ["conv_id"], "turn", "x").select("conv_id", "turn", rnd("smoothed", 7).alias("smoothed"))


@query(
    "win6_group_z",
    """
    SELECT l_suppkey, l_linenumber, count(*) AS n, round(max(z), 8) + 0.0 AS top, round(min(z), 8) + 0.0 AS bottom, round(sum(z * z), 6) AS energy FROM (
      SELECT *, (l_quantity - avg(l_quantity) OVER w) / CASE WHEN stddev_samp(l_quantity) OVER w > 0 THEN stddev_samp(l_quantity) OVER w ELSE 1 END AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linenumber)) GROUP BY ALL
    """,
)
def win6(spark, sf):
    keys = ["l_suppkey", "l_linenumber"]
    z = seq.group_z(table(spark, sf, "lineitem").select(*keys, "l_quantity"), keys, "l_quantity")
    return z.groupBy(*keys).agg(
        F.count("*").alias("n"), rnd(F.max("z"), 8).alias("top"), rnd(F.min("z"), 8).alias("bottom"), rnd(F.sum(F.col("z") * F.col("z"))).alias("energy")
    )


@query(
    "win7_ranks",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS ordinal, rank() OVER (ORDER BY o_totalprice) AS lowest,
      rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS average FROM orders
    """,
)
def win7(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = ordered(df, [], "o_totalprice", ["o_orderkey"], rank=True, position=True)
    return out.select("o_orderkey", F.col("pos").alias("ordinal"), F.col("lo").alias("lowest"), average_rank().alias("average"))


@query(
    "win7_ranks_hot_values",
    """
    SELECT l_linenumber, l_quantity, count(*) AS n, min(r) AS lowest, max(r) AS highest FROM (SELECT *, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) AS r FROM lineitem) GROUP BY ALL
    """,
)
def win7_hot(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey")
    out = ordered(df, ["l_linenumber"], "l_quantity", ["l_orderkey"], rank=True)
    return out.groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n"), F.min("lo").alias("lowest"), F.max("lo").alias("highest"))


@query(
    "win8_reference_percentile",
    """
    WITH r AS (SELECT n_chars FROM documents WHERE lang = 'en'), c AS (SELECT n_chars AS v, (SELECT count(*) FROM r WHERE r.n_chars <= d.n_chars) / (SELECT count(*) FROM r) AS le, (SELECT count(*) FROM r WHERE r.n_chars < d.n_chars) / (SELECT count(*) FROM r) AS lt
        FROM (SELECT DISTINCT n_chars FROM documents) d)
    SELECT doc_id, round(le, 9) AS at_or_below, round(lt, 9) AS below, CASE WHEN le >= .95 THEN 'top 5%' WHEN le >= .9 THEN 'top 10%' WHEN le >= .75 THEN 'above' WHEN le >= .5 THEN 'upper half' WHEN le >= .25 THEN 'lower half' ELSE 'low' END AS band
    FROM documents JOIN c ON n_chars = v
    """,
)
def win8(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    shares = seq.reference_percentiles(df, "n_chars", F.col("lang") == "en")
    le = F.col("at_or_below")
    band = F.when(le >= 0.95, "top 5%").when(le >= 0.9, "top 10%").when(le >= 0.75, "above").when(le >= 0.5, "upper half").when(le >= 0.25, "lower half").otherwise("low")
    joined = df.join(shares, "n_chars").withColumn("band", band)
    return joined.select("doc_id", rnd(le, 9).alias("at_or_below"), rnd("below", 9).alias("below"), "band")


_WALK_SQL = """
    w AS (SELECT user_id, value AS x, lag(value) OVER o AS a, lead(value) OVER o AS b, row_number() OVER o AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


@query(
    "win9_fluctuation",
    f"""WITH {_WALK_SQL}
    SELECT user_id, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 8) AS std, round(max(x) - min(x), 6) AS spread, round(arg_max(x, pos) - arg_min(x, pos), 6) + 0.0 AS trend,
      count(*) FILTER (WHERE x > a AND x > b) AS peaks, count(*) FILTER (WHERE x < a AND x < b) AS valleys, round(avg(abs(x - a)), 8) AS volatility, round(max(abs(x - a)), 6) AS max_change,
      count(*) FILTER (WHERE sign(x - a) <> sign(b - x)) AS turns, count(*) FILTER (WHERE x > .1) AS positive, count(*) FILTER (WHERE x < -.1) AS negative, count(*) FILTER (WHERE abs(x) <= .1) AS neutral FROM w GROUP BY 1""",
)
def win9(spark, sf):
    out = seq.fluctuation(_events(spark, sf), ["user_id"], "ts", "value", ["event_id"])
    return _round(_round(out, 8, "std", "volatility"), 6, "spread", "trend", "max_change").withColumn("mean", rnd("mean", 9))


_DECIDE_SQL = """
    l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CASE WHEN role = 'system' THEN 'DENIED' WHEN length(text) < 150 THEN 'UNCERTAIN' ELSE 'AFFIRMED' END AS presence,
        CASE WHEN length(text) > 700 THEN 'HIGH' WHEN length(text) > 250 THEN 'MED' ELSE 'LOW' END AS intensity, CASE WHEN contains(text, chr(10)) THEN 'HIGH' ELSE 'LOW' END AS info,
        CASE WHEN contains(text, 'the ') THEN 'ENCOURAGE' ELSE 'NEUTRAL' END AS pacing FROM conversations),
    f AS (SELECT *, (CASE WHEN intensity = 'MED' THEN 1 ELSE 0 END) + (CASE WHEN info = 'HIGH' THEN 1 ELSE 0 END) + (CASE WHEN pacing = 'ENCOURAGE' THEN 1 ELSE 0 END) AS votes FROM l)
"""


def _labels(spark, sf):
    size = F.length("text")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", "DENIED").when(size < 150, "UNCERTAIN").otherwise("AFFIRMED").alias("presence"),
        F.when(size > 700, "HIGH").when(size > 250, "MED").otherwise("LOW").alias("intensity"),
        F.when(F.contains("text", F.lit("\n")), "HIGH").otherwise("LOW").alias("info"),
        F.when(F.contains("text", F.lit("the ")), "ENCOURAGE").otherwise("NEUTRAL").alias("pacing"),
    )


@query(
    "win11_cooldown_decisions",
    f"""WITH RECURSIVE {_DECIDE_SQL},
    s AS (SELECT conv_id, turn, pos, 0 AS last, CASE WHEN presence = 'DENIED' THEN 0 WHEN intensity = 'HIGH' THEN 1 WHEN votes >= 2 AND presence <> 'UNCERTAIN' THEN 1
            WHEN info = 'HIGH' AND intensity = 'LOW' THEN CASE WHEN pacing = 'ENCOURAGE' AND presence <> 'UNCERTAIN' THEN 1 ELSE 0 END ELSE 0 END AS decision FROM f WHERE pos = 1
          UNION ALL SELECT f.conv_id, f.turn, f.pos, s.decision, CASE WHEN presence = 'DENIED' THEN 0 WHEN intensity = 'HIGH' THEN 1 WHEN s.decision = 1 AND pacing <> 'ENCOURAGE' THEN 0
            WHEN votes >= 2 AND presence <> 'UNCERTAIN' THEN 1 WHEN info = 'HIGH' AND intensity = 'LOW' THEN CASE WHEN pacing = 'ENCOURAGE' AND presence <> 'UNCERTAIN' THEN 1 ELSE 0 END ELSE 0 END
          FROM s JOIN f ON f.conv_id = s.conv_id AND f.pos = s.pos + 1)
    SELECT conv_id, turn, decision FROM s""",
)
def win11(spark, sf):
    labels = _labels(spark, sf)
    rules = seq.cooldown_answers(*[F.col(c) for c in ("presence", "intensity", "info", "pacing")])
    rows = labels.withColumns({n: rules[n] for n in ("if_off", "if_on")})
    return seq.two_state_scan(rows, ["conv_id"], "turn", "if_off", "if_on").select("conv_id", "turn", "decision")


@query(
    "win12_running_totals",
    """
    SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
      round(value / sum(value) OVER (PARTITION BY event_type), 9) AS share FROM events
    """,
)
def win12(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    walked = ordered(df, ["event_type"], "ts", ["event_id"], running={"v": "value"})
    return walked.select("event_id", rnd(F.col("before_v") + F.col("value"), 2).alias("running"), rnd(F.col("value") / F.col("total_v"), 9).alias("share"))


@query(
    "win13_best_and_worst",
    """
    WITH c AS (SELECT l_returnflag, l_suppkey, round(avg(l_quantity), 9) AS m FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, arg_max(l_suppkey, {'m': m, 'k': -l_suppkey}) AS best, max(m) AS best_mean, arg_min(l_suppkey, {'m': m, 'k': l_suppkey}) AS worst, min(m) AS worst_mean FROM c GROUP BY 1
    """,
)
def win13(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(rnd(F.avg("l_quantity"), 9).alias("m"))
    return c.groupBy("l_returnflag").agg(
        F.max_by("l_suppkey", F.struct("m", -F.col("l_suppkey"))).alias("best"), F.max("m").alias("best_mean"),
        F.min_by("l_suppkey", F.struct("m", "l_suppkey")).alias("worst"), F.min("m").alias("worst_mean"),
    )


@query(
    "win14_baseline_gap",
    """
    WITH m AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS s, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
    SELECT o_custkey, round(s - b, 5) + 0.0 AS gap FROM m WHERE s IS NOT NULL AND b IS NOT NULL
    """,
)
def win14(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    m = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg(F.when(status == "O", price)).alias("s"), F.avg(F.when(status == "F", price)).alias("b"))
    return m.where("s is not null and b is not null").select("o_custkey", rnd(F.col("s") - F.col("b"), 5).alias("gap"))


@query(
    "win15_series_shape",
    f"""WITH {_WALK_SQL}
    SELECT user_id, arg_min(x, pos) AS first, arg_max(x, pos) AS last, round(arg_max(x, pos) - arg_min(x, pos), 6) + 0.0 AS change, max(x) AS peak, min(x) AS valley,
      round(regr_slope(x, pos), 8) + 0.0 AS slope FROM w GROUP BY 1""",
)
def win15(spark, sf):
    placed = ordered(_events(spark, sf), ["user_id"], "ts", ["event_id"], position=True)
    first, last = F.min_by("value", "pos"), F.max_by("value", "pos")
    return placed.groupBy("user_id").agg(
        first.alias("first"), last.alias("last"), rnd(last - first).alias("change"), F.max("value").alias("peak"), F.min("value").alias("valley"),
        rnd(F.regr_slope("value", "pos"), 8).alias("slope"),
    )


@query(
    "win16_even_spread",
    """
    WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot FROM conversations WHERE role = 'assistant'),
    m AS (SELECT conv_id, max(slot) AS m FROM a GROUP BY 1), n AS (SELECT conv_id, max(i) AS n FROM u GROUP BY 1),
    t AS (SELECT u.*, CASE WHEN i <= (n % m) * (n // m + 1) THEN (i - 1) // (n // m + 1) + 1 ELSE n % m + (i - 1 - (n % m) * (n // m + 1)) // greatest(n // m, 1) + 1 END AS slot FROM u JOIN m USING (conv_id) JOIN n USING (conv_id))
    SELECT conv_id, turn, slot, target FROM t JOIN a USING (conv_id, slot)
    """,
)
def win16(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    items = ordered(df.where("role = 'user'"), ["conv_id"], "turn", position=True).select("conv_id", "turn", F.col("pos").alias("i"), F.col("n").alias("items"))
    slots = ordered(df.where("role = 'assistant'"), ["conv_id"], "turn", position=True)
    slots = slots.select("conv_id", F.col("turn").alias("target"), F.col("pos").alias("slot"))
    sizes = slots.groupBy("conv_id").agg(F.count("*").alias("slots"))
    placed = items.join(sizes, "conv_id").withColumn("slot", seq.even_slots(F.col("i"), F.col("items"), F.col("slots")))
    return placed.join(slots, ["conv_id", "slot"]).select("conv_id", "turn", "slot", "target")


@query(
    "arr1_arc_labels",
    f"""WITH {_WALK_SQL}, t AS (SELECT user_id, n, x - 35 AS x, (pos - 1) / (n - 1) AS t FROM w),
    c AS (SELECT user_id, n, x, unnest([{{'o': 0, 'name': 'Rags to riches', 'code': 'RR', 'c': .8 * (t - .2)}}, {{'o': 1, 'name': 'Tragedy', 'code': 'TR', 'c': .8 * (.8 - t)}}, {{'o': 2, 'name': 'Man in a hole', 'code': 'MH', 'c': .5 * sin(pi() * t - pi() / 2)}},
        {{'o': 3, 'name': 'Icarus', 'code': 'IC', 'c': .5 * sin(pi() * t + pi() / 2)}}, {{'o': 4, 'name': 'Cinderella', 'code': 'CN', 'c': .5 * sin(2 * pi() * t - pi() / 2)}}, {{'o': 5, 'name': 'Oedipus', 'code': 'OE', 'c': .5 * sin(2 * pi() * t + pi() / 2)}}]) AS k FROM t),
    s AS (SELECT user_id, n, k.name AS arc, k.code AS code, k.o AS o, round(greatest(0, sum(x * k.c) / (sqrt(sum(x * x)) * sqrt(sum(k.c * k.c)))), 4) + 0.0 AS confidence FROM c GROUP BY ALL)
    SELECT user_id, n, arc, code, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, o) AS r FROM s) WHERE r = 1""",
)
def arr1(spark, sf):
    df = _events(spark, sf).withColumn("value", F.col("value") - 35)
    return seq.arc_labels(df, ["user_id"], "ts", "value", ["event_id"])


@query(
    "arr2_direction_agreement",
    """
    WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), d AS (SELECT user_id, value - lag(value) OVER o AS da, k - lag(k) OVER o AS db FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS steps, round(avg(CASE WHEN sign(da) = sign(db) THEN 1.0 ELSE 0.0 END), 9) AS agreement,
      round(avg(CASE WHEN sign(da) = sign(db) THEN 1.0 ELSE 0.0 END) FILTER (WHERE abs(da) >= 1e-6 OR abs(db) >= 1e-6), 9) AS agreement_moving FROM d WHERE da IS NOT NULL GROUP BY 1
    """,
)
def arr2(spark, sf):
    df = _events(spark, sf, F.from_json("props", "k double")["k"].alias("k"))
    return _round(seq.direction_agreement(df, ["user_id"], "ts", "value", "k", ["event_id"]), 9, "agreement", "agreement_moving")


@query(
    "arr3_disagreement_counts",
    """
    WITH e AS (SELECT user_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), m AS (SELECT user_id, sqrt((var_samp(value) + var_samp(k)) / 2) AS sd FROM e GROUP BY 1)
    SELECT user_id, mult, count(*) AS n, count(*) FILTER (WHERE abs(value - k) > mult * sd) AS n_differ FROM e JOIN m USING (user_id), (VALUES (.4::DOUBLE), (.5::DOUBLE), (.6::DOUBLE)) AS x(mult) GROUP BY ALL
    """,
)
def arr3(spark, sf):
    df = table(spark, sf, "events").select("user_id", "value", F.from_json("props", "k double")["k"].alias("k"))
    sd = df.groupBy("user_id").agg(F.sqrt((F.var_samp("value") + F.var_samp("k")) / 2).alias("sd"))
    gap = F.abs(F.col("value") - F.col("k"))
    levels = [0.4, 0.5, 0.6]
    counts = df.join(sd, "user_id").groupBy("user_id").agg(
        F.count("*").alias("n"), F.array(*[F.struct(F.lit(m).alias("mult"), F.count_if(gap > m * F.col("sd")).alias("n_differ")) for m in levels]).alias("c")
    )
    return counts.select("user_id", "n", F.inline("c"))

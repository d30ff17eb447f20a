"""Join operators on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge import fixed
from corpusgauge.functions.common import flat, inline, ratio, rnd, scalar, sql_values
from corpusgauge.operators import joins
from corpusgauge.plans.ordered import ordered, quantiles
from corpusgauge.registry import query
from corpusgauge.sources.tables import busy_table, table

WORD = r"[\p{L}\p{N}]+"


@query(
    "join1_master_table",
    """
    SELECT c_mktsegment, o_orderstatus, count(*) AS n, count(o_orderkey) AS n_order, count(c_custkey) AS n_customer, round(sum(l_extendedprice), 2) AS total
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL
    """,
)
def join1(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    # Lines collapse per order before they move.
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    master = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(
        people, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    have = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0))
    return master.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.sum("n").alias("n"), have("o_orderkey").alias("n_order"), have("c_custkey").alias("n_customer"), rnd(F.sum("total"), 2).alias("total")
    )


@query(
    "join1_document_master",
    "SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def join1_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


@query(
    "join2_paired_delta",
    """
    WITH b AS (SELECT user_id, avg(value) AS base FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT event_type, count(*) AS n, round(avg(value - base), 7) + 0.0 AS delta_mean, round(stddev_samp(value - base), 7) AS delta_std
    FROM events JOIN b USING (user_id) WHERE event_type <> 'view' GROUP BY event_type
    """,
)
def join2(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "value")
    paired = joins.paired_delta(df, ["user_id"], F.col("event_type") == "view", "value")
    return paired.groupBy("event_type").agg(
        F.count("*").alias("n"), rnd(F.avg("delta"), 7).alias("delta_mean"), rnd(F.stddev_samp("delta"), 7).alias("delta_std")
    )


@query(
    "join3_qualified_groups",
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4)
    """,
)
def join3(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return joins.qualified(df, "o_custkey", "o_orderpriority", 4).select("o_orderkey", "o_custkey")


_SENTENCES_SQL = "regexp_extract_all(text, '[^.!?\\n]+')"


@query(
    "join4_missed_and_extra",
    f"""
    WITH r AS (SELECT item_id, trim(unnest({_SENTENCES_SQL})) AS s FROM benchmark), g AS (SELECT source, trim(unnest({_SENTENCES_SQL})) AS s FROM documents)
    SELECT 'missed' AS side, CAST(item_id AS VARCHAR) AS owner, count(DISTINCT s) AS n FROM r WHERE s <> '' AND s NOT IN (SELECT s FROM g) GROUP BY item_id
    UNION ALL SELECT 'extra', source, count(DISTINCT s) FROM g WHERE s <> '' AND s NOT IN (SELECT s FROM r) GROUP BY source
    """,
)
def join4(spark, sf):
    def sentences(name, owner):
        found = F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0))
        df = flat(table(spark, sf, name), [F.col(owner).cast("string").alias("owner")], found, "s")
        return df.select("owner", F.trim("s").alias("s")).where("s <> ''").distinct()

    reference, generated = sentences("benchmark", "item_id"), sentences("documents", "source")
    missed = reference.join(generated.select("s").distinct(), "s", "left_anti")
    extra = generated.join(reference.select("s").distinct(), "s", "left_anti")
    both = missed.withColumn("side", F.lit("missed")).unionByName(extra.withColumn("side", F.lit("extra")))
    return both.groupBy("side", "owner").agg(F.count("*").alias("n"))


@query(
    "join5_fuzzy_match",
    """
    WITH bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM benchmark),
    dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents),
    b AS (SELECT item_id || ':' || i AS anchor, list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) AS w FROM bl), d AS (SELECT doc_id, i, list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) AS w FROM dl),
    bt AS (SELECT anchor, len(w) AS n, unnest(w) AS t FROM b), dt AS (SELECT doc_id, i, len(w) AS n, unnest(w) AS t FROM d),
    o AS (SELECT anchor, doc_id, i, count(*) AS c, any_value(bt.n) AS bn, any_value(dt.n) AS dn FROM bt JOIN dt USING (t) GROUP BY ALL),
    j AS (SELECT anchor, doc_id, i, c / (bn + dn - c) AS jaccard FROM o WHERE c / (bn + dn - c) >= .6),
    f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY doc_id, i) AS rn FROM j)
    SELECT anchor, doc_id, i AS line, round(jaccard, 9) AS jaccard FROM f WHERE rn = 1
    """,
)
def join5(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words")
    lines = lambda df, key: flat(df, [key], F.split("text", "\n"), "text", "line")
    left = lines(table(spark, sf, "benchmark"), "item_id").select(F.concat_ws(":", "item_id", "line").alias("anchor"), words)
    right = lines(busy_table(spark, sf, "documents"), "doc_id").select("doc_id", "line", words)
    found = joins.fuzzy_matches(left, right, "anchor", ["doc_id", "line"], "words", 0.6)
    return found.select("anchor", "doc_id", "line", rnd("jaccard", 9).alias("jaccard"))


@query(
    "join5_hit_rate",
    """
    WITH r AS (SELECT item_id, trim(unnest(regexp_extract_all(lower(text), '[^.!?\\n]+'))) AS s FROM benchmark),
    g AS (SELECT DISTINCT trim(unnest(regexp_extract_all(lower(text), '[^.!?\\n]+'))) AS s FROM documents)
    SELECT item_id, count(*) AS n_reference, count(g.s) AS n_matched, round(count(g.s) / count(*), 9) AS hit_rate
    FROM (SELECT DISTINCT item_id, s FROM r WHERE s <> '') r LEFT JOIN g ON r.s = g.s GROUP BY item_id
    """,
)
def join5_rate(spark, sf):
    def sentences(name, *owner):
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"[^.!?\n]+"), F.lit(0))
        return flat(table(spark, sf, name), owner, found, "s").withColumn("s", F.trim("s")).where("s <> ''").distinct()

    reference = sentences("benchmark", "item_id")
    hits = reference.join(sentences("documents").withColumn("hit", F.lit(1)), "s", "left")
    return hits.groupBy("item_id").agg(
        F.count("*").alias("n_reference"), F.count("hit").alias("n_matched"), rnd(ratio(F.count("hit"), F.count("*")), 9).alias("hit_rate")
    )


_ROWS_SQL = "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem"


@query(
    "join6_pair_outcomes",
    f"""
    WITH x AS ({_ROWS_SQL}),
    p AS (SELECT a.id, a.l_orderkey, a.l_extendedprice, count(*) FILTER (WHERE b.l_extendedprice < a.l_extendedprice) AS wins,
        count(*) FILTER (WHERE b.l_extendedprice > a.l_extendedprice) AS losses, count(*) FILTER (WHERE b.l_extendedprice = a.l_extendedprice) - 1 AS draws
      FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey GROUP BY ALL)
    SELECT l_orderkey, l_extendedprice, wins, losses, draws FROM p
    """,
)
def join6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_partkey")
    out = joins.beaten_counts(df, ["l_orderkey"], "l_extendedprice", ["l_partkey"])
    return out.select("l_orderkey", "l_extendedprice", "wins", "losses", "draws")


@query(
    "join6_class_pairs",
    """
    WITH c AS (SELECT DISTINCT l_returnflag AS f FROM lineitem),
    p AS (SELECT a.l_returnflag AS winner, b.l_returnflag AS loser, count(*) AS n FROM lineitem a JOIN lineitem b
      ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice > b.l_extendedprice GROUP BY ALL)
    SELECT w.f AS winner, l.f AS loser, coalesce(n, 0) AS n FROM c w CROSS JOIN c l LEFT JOIN p ON p.winner = w.f AND p.loser = l.f
    """,
)
def join6_classes(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag")
    return joins.wins_by_class(df, ["l_orderkey"], "l_extendedprice", "l_returnflag")


@query(
    "join7_nearest_match",
    """
    WITH b AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM b),
    t AS (SELECT o_totalprice AS p, min(o_orderkey) AS id FROM orders, e WHERE o_orderstatus <> 'F' AND o_totalprice BETWEEN lo AND hi GROUP BY 1),
    x AS (SELECT b.o_orderkey AS base_id, b.o_totalprice AS base_value, bk.id AS bid, bk.p AS bp FROM b ASOF LEFT JOIN t bk ON b.o_totalprice >= bk.p),
    y AS (SELECT b.o_orderkey AS base_id, fw.id AS fid, fw.p AS fp FROM b ASOF LEFT JOIN t fw ON b.o_totalprice <= fw.p)
    SELECT base_id, base_value, CASE WHEN bid IS NOT NULL AND (fid IS NULL OR base_value - bp <= fp - base_value) THEN bid ELSE fid END AS match_id,
      CASE WHEN bid IS NOT NULL AND (fid IS NULL OR base_value - bp <= fp - base_value) THEN bp ELSE fp END AS match_value
    FROM x JOIN y USING (base_id)
    """,
)
def join7(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return joins.nearest_match(df, "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "F")


@query(
    "join8_strata",
    """
    WITH q AS (SELECT quantile_cont(n_chars, .25) AS a, quantile_cont(n_chars, .5) AS b, quantile_cont(n_chars, .75) AS c FROM documents)
    SELECT doc_id, CASE WHEN n_chars <= a THEN 'short' WHEN n_chars <= b THEN 'medium' WHEN n_chars <= c THEN 'long' ELSE 'very long' END AS stratum FROM documents, q
    """,
)
def join8(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    cut = scalar(quantiles(df, [], "n_chars", {"a": 0.25, "b": 0.5, "c": 0.75}))
    n = F.col("n_chars")
    label = F.when(n <= cut["a"], "short").when(n <= cut["b"], "medium").when(n <= cut["c"], "long").otherwise("very long")
    return df.select("doc_id", label.alias("stratum"))


@query(
    "join9_pareto_front",
    """
    SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice
      AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))
    """,
)
def join9(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return joins.pareto_front(df, "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


@query(
    "join9_pareto_orders",
    """
    WITH o AS (SELECT o_orderkey, o_totalprice, -o_custkey AS q FROM orders),
    m AS (SELECT *, max(q) OVER (ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM o),
    s AS (SELECT *, min(o_totalprice) OVER (PARTITION BY top) AS first_cost FROM m)
    SELECT o_orderkey FROM s WHERE q = top AND o_totalprice = first_cost
    """,
)
def join9_orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_custkey")).alias("q"))
    return joins.pareto_front(df, "o_totalprice", "q").select("o_orderkey")


_SLICE_SQL = """
    WITH a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1)
"""


def _slices(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")

    def part(rows):
        return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))

    return part(df.where(F.col("o_orderdate") < cut)), part(df.where(F.col("o_orderdate") >= cut))


@query(
    "join10_full_outer",
    _SLICE_SQL
    + "SELECT o_custkey, coalesce(a.n, 0) AS wins, coalesce(b.n, 0) AS losses, coalesce(a.n, 0) - coalesce(b.n, 0) AS net FROM a FULL JOIN b USING (o_custkey)",
)
def join10(spark, sf):
    a, b = _slices(spark, sf)
    wins, losses = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    return joins.full_merge(a, b, ["o_custkey"], ["n"]).select("o_custkey", wins.alias("wins"), losses.alias("losses"), (wins - losses).alias("net"))


@query(
    "join11_version_diff",
    _SLICE_SQL
    + """SELECT o_custkey, a.n AS a_n, b.n AS b_n, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n""",
)
def join11(spark, sf):
    a, b = _slices(spark, sf)
    return joins.version_diff(a, b, ["o_custkey"], ["n"])


@query(
    "join12_lexicon_scores",
    f"""
    WITH l AS (SELECT * FROM {sql_values(fixed.LEXICON, 'word, score')}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents)
    SELECT doc_id, count(*) AS n_hits, round(avg(score), 9) AS mean_score FROM t JOIN l USING (word) GROUP BY doc_id
    """,
)
def join12(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    tokens = flat(busy_table(spark, sf, "documents"), ["doc_id"], words, "word")
    scored = tokens.join(inline(spark, fixed.LEXICON, "word string, score double"), "word")
    return scored.groupBy("doc_id").agg(F.count("*").alias("n_hits"), rnd(F.avg("score"), 9).alias("mean_score"))


def _side_sql(words) -> str:
    return "list_has_any(w, [" + ", ".join(f"'{w}'" for w in words) + "])"


@query(
    "join13_opposed_words",
    "WITH d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), f AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, source, '{p}' AS pattern, {_side_sql(a)} AS a, {_side_sql(b)} AS b FROM d" for p, a, b in fixed.OPPOSED
    )
    + """)
    SELECT x.doc_id, x.pattern, count(*) AS n_conflicts FROM f x JOIN f y ON x.source = y.source AND x.pattern = y.pattern AND x.doc_id <> y.doc_id
      AND ((x.a AND y.b) OR (x.b AND y.a)) GROUP BY ALL""",
)
def join13(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    docs = busy_table(spark, sf, "documents").select("doc_id", "source", words.alias("w"))
    has = lambda side: F.arrays_overlap("w", F.array(*[F.lit(x) for x in side]))
    flags = [F.struct(F.lit(p).alias("pattern"), has(a).alias("a"), has(b).alias("b")) for p, a, b in fixed.OPPOSED]
    rows = docs.select("doc_id", "source", F.inline(F.array(*flags)))
    # Counts of the four flag cases per group stand for the pairs.
    cases = rows.groupBy("source", "pattern").agg(
        F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") | F.col("b")).alias("n_any")
    )
    a, b = F.col("a"), F.col("b")
    n = F.when(a & b, F.col("n_any") - 1).when(a, F.col("n_b")).when(b, F.col("n_a")).otherwise(0)
    return rows.join(cases, ["source", "pattern"]).select("doc_id", "pattern", n.alias("n_conflicts")).where("n_conflicts > 0")


@query(
    "join14_entity_mentions",
    """
    WITH names AS (SELECT DISTINCT regexp_extract(text, '[\\p{L}\\p{N}]+') AS name FROM benchmark),
    d AS (SELECT doc_id, text, regexp_split_to_array(text, '[^\\p{L}\\p{N}]') AS parts FROM documents),
    p AS (SELECT doc_id, unnest(parts) AS name, generate_subscripts(parts, 1) AS pos FROM d),
    m AS (SELECT doc_id, name, count(*) AS n, min(pos) AS pos FROM p JOIN names USING (name) GROUP BY ALL),
    o AS (SELECT m.*, text, CASE WHEN pos = 1 THEN 0 ELSE length(array_to_string(list_slice(parts, 1, pos - 1), 'x')) + 1 END AS start_at FROM m JOIN d USING (doc_id))
    SELECT doc_id, name, n, substr(text, greatest(start_at - 50, 0) + 1, start_at - greatest(start_at - 50, 0) + length(name) + 50) AS context FROM o
    """,
)
def join14(spark, sf):
    names = table(spark, sf, "benchmark").select(F.regexp_extract("text", WORD, 0).alias("name")).distinct()
    docs = busy_table(spark, sf, "documents").select("doc_id", "text")
    parts = F.split("text", r"[^\p{L}\p{N}]")
    # Words that are no names go before anything moves; a frequent name is one row per document.
    places = flat(docs, ["doc_id"], parts, "name", "pos").join(names, "name", "left_semi")
    counted = places.groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    found = counted.join(docs, "doc_id")
    before = F.array_join(F.slice(parts, F.lit(1), F.col("pos")), "x")
    at = F.when(F.col("pos") == 0, 0).otherwise(F.length(before) + 1)
    located = found.select("doc_id", "name", "n", "text", at.alias("at"))
    start = F.greatest(F.col("at") - 50, F.lit(0))
    width = F.col("at") - start + F.length("name") + 50
    return located.select("doc_id", "name", "n", F.substring("text", start + 1, width).alias("context"))


@query(
    "join15_change_impact",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[\\p{L}]{5,}')) AS name FROM conversations),
    c AS (SELECT conv_id, name FROM t WHERE turn = 0)
    SELECT t.conv_id, t.turn, min(name) AS reason, count(*) AS n_shared FROM t JOIN c USING (conv_id, name) WHERE turn > 0 GROUP BY ALL
    """,
)
def join15(spark, sf):
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}]{5,}"), F.lit(0)))).alias("name")
    mentions = table(spark, sf, "conversations").select("conv_id", "turn", names)
    changed = mentions.where("turn = 0").select("conv_id", "name").distinct()
    later = mentions.where("turn > 0").distinct().join(changed, ["conv_id", "name"])
    return later.groupBy("conv_id", "turn").agg(F.min("name").alias("reason"), F.count("*").alias("n_shared"))


@query(
    "join16_order_mapping",
    """
    WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS orig,
        row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, turn, orig, pos, CASE WHEN pos = 0 THEN CASE WHEN orig > n // 2 THEN 'Jump opening' ELSE 'Sequential' END
      WHEN orig < pos THEN 'Flashback' ELSE 'Sequential' END AS timeline,
      coalesce(orig < lag(orig) OVER (PARTITION BY conv_id ORDER BY pos), false) AS steps_back FROM o
    """,
)
def join16(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    first = ordered(df, ["conv_id"], "turn", position=True).withColumn("orig", F.col("pos") - 1).drop("pos")
    second = ordered(first.drop("n"), ["conv_id"], "size", ["turn"], prev=["orig"], position=True)
    second = second.withColumn("pos", F.col("pos") - 1)
    opening = F.when(F.col("orig") > F.floor(F.col("n") / 2), "Jump opening").otherwise("Sequential")
    timeline = F.when(F.col("pos") == 0, opening).when(F.col("orig") < F.col("pos"), "Flashback").otherwise("Sequential")
    back = F.coalesce(F.col("orig") < F.col("prev.orig"), F.lit(False))
    return second.select("conv_id", "turn", "orig", "pos", timeline.alias("timeline"), back.alias("steps_back"))


@query(
    "join17_human_auto",
    """
    WITH h AS (SELECT source, avg(quality) AS human, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
    a AS (SELECT source, avg(n_chars) AS auto FROM documents WHERE lang <> 'en' AND source <> 'src3' GROUP BY source), f AS (SELECT avg(n_chars) AS auto FROM documents WHERE lang = 'en')
    SELECT source, round(human, 9) AS human, n, round(coalesce(a.auto, f.auto), 6) AS auto, a.auto IS NULL AS is_fallback FROM h LEFT JOIN a USING (source), f
    """,
)
def join17(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    human = table(spark, sf, "labels").join(docs, "doc_id").groupBy("source").agg(F.avg("quality").alias("human"), F.count("*").alias("n"))
    auto = docs.where("lang <> 'en' and source <> 'src3'").groupBy("source").agg(F.avg("n_chars").alias("auto"))
    fallback = scalar(docs.where("lang = 'en'").agg(F.avg("n_chars").alias("auto")))["auto"]
    return human.join(auto, "source", "left").select(
        "source", rnd("human", 9).alias("human"), "n", rnd(F.coalesce("auto", fallback)).alias("auto"), F.col("auto").isNull().alias("is_fallback")
    )


@query(
    "join18_price_list",
    f"""
    WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN ['GPT-4-Turbo-2024', 'gpt-4.1-mini'][event_id % 2 + 1] WHEN 'click' THEN 'gpt-4' WHEN 'purchase' THEN ['models/Gemini-1.5', 'Llama-2-70B-chat'][event_id % 2 + 1]
        WHEN 'signup' THEN 'gpt-3.5-turbo-0125' ELSE 'unknown-model' END AS model, CAST(value * 10 AS BIGINT) AS tin, CAST(json_extract(props, '$.k') AS BIGINT) AS tout FROM events),
    a AS (SELECT * FROM {sql_values(fixed.MODEL_ALIASES, 'priority, fragment, row_name')}), p AS (SELECT * FROM {sql_values(fixed.PRICES, 'model, price_in, price_out')}),
    k AS (SELECT e.*, (SELECT arg_min(row_name, priority) FROM a WHERE contains(lower(e.model), fragment)) AS row_name FROM e)
    SELECT k.model, coalesce(row_name, 'default') AS priced_as, count(*) AS n, round(sum(tin / 1000 * price_in + tout / 1000 * price_out), 6) AS cost
    FROM k JOIN p ON p.model = coalesce(row_name, 'default') GROUP BY ALL
    """,
)
def join18(spark, sf):
    names = {
        "view": ("GPT-4-Turbo-2024", "gpt-4.1-mini"),
        "click": ("gpt-4", "gpt-4"),
        "purchase": ("models/Gemini-1.5", "Llama-2-70B-chat"),
        "signup": ("gpt-3.5-turbo-0125", "gpt-3.5-turbo-0125"),
    }
    model = F.lit("unknown-model")
    for kind, (even, odd) in names.items():
        name = F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    calls = table(spark, sf, "events").select(
        model.alias("model"),
        F.bround(F.col("value") * 10, 0).cast("bigint").alias("tokens_in"),
        F.from_json("props", "k bigint")["k"].alias("tokens_out"),
    )
    # Tokens add up per model name before prices are looked up.
    totals = calls.groupBy("model").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    aliases = [F.when(F.contains(F.lower("model"), F.lit(fragment)), row) for _, fragment, row in sorted(fixed.MODEL_ALIASES)]
    priced = totals.withColumn("priced_as", F.coalesce(*aliases, F.lit("default")))
    prices = inline(spark, fixed.PRICES, "priced_as string, price_in double, price_out double")
    cost = F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out")
    return priced.join(prices, "priced_as").select("model", "priced_as", "n", rnd(cost).alias("cost"))


@query(
    "join19_cross_sample",
    """
    WITH h AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) FILTER (WHERE l_shipdate < '1998-01-01') AS main, avg(l_quantity) FILTER (WHERE l_shipdate >= '1998-01-01') AS val FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, round(main, 9) AS main, round(val, 9) AS validation, round(abs(main - val), 9) AS gap FROM h
    WHERE main IS NOT NULL AND val IS NOT NULL ORDER BY round(abs(main - val), 9) DESC, l_suppkey, l_returnflag LIMIT 10
    """,
)
def join19(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")

    def half(rows, name):
        return rows.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias(name))

    main, validation = half(df.where(F.col("l_shipdate") < cut), "main"), half(df.where(F.col("l_shipdate") >= cut), "validation")
    both = main.join(validation, ["l_suppkey", "l_returnflag"])
    gaps = both.withColumn("gap", rnd(F.abs(F.col("main") - F.col("validation")), 9))
    top = gaps.orderBy(F.desc("gap"), "l_suppkey", "l_returnflag").limit(10)
    return top.select("l_suppkey", "l_returnflag", rnd("main", 9).alias("main"), rnd("validation", 9).alias("validation"), "gap")


@query(
    "join20_correction_merge",
    _SLICE_SQL + "SELECT o_custkey, coalesce(b.n, a.n) AS n, coalesce(b.total, a.total) AS total FROM a FULL JOIN b USING (o_custkey)",
)
def join20(spark, sf):
    a, b = _slices(spark, sf)
    return joins.corrected(a, b, ["o_custkey"], ["n", "total"])

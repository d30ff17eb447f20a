"""Composite text-quality measures on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge import fixed
from corpusgauge.functions import text as tx
from corpusgauge.functions.common import attach, corr, ratio, rnd, scalar
from corpusgauge.operators import backoff, ngrams, scoring
from corpusgauge.operators import sequences as seq
from corpusgauge.plans.ordered import attach_ranks, ordered, quantiles
from corpusgauge.queries.sequences import _SIMS_SQL, _WALK_SQL, _sims
from corpusgauge.queries.text import _GRAMMAR_SQL, _TOK_SQL, _WINDOW_SQL, TWO_SQL, _distinct, two_scorers
from corpusgauge.registry import query
from corpusgauge.session import reliable
from corpusgauge.sources.tables import busy_table, table

GROUP = ["source", "lang"]


def _tokens(spark, sf, *extra):
    return busy_table(spark, sf, "documents").select("doc_id", *GROUP, *extra, tx.tokens(tx.strip_markdown(F.col("text"))).alias("t"))


def _round(df, places, *names):
    return df.withColumns({n: rnd(n, places) for n in names})


_BLEU_SQL = f"""
    d0 AS (SELECT doc_id, source, lang, {_TOK_SQL} AS w FROM documents),
    g0 AS (SELECT doc_id, source, lang, 1 AS k, unnest(w) AS item FROM d0
      UNION ALL SELECT doc_id, source, lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM d0
      UNION ALL SELECT doc_id, source, lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM d0
      UNION ALL SELECT doc_id, source, lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) FROM d0),
    c0 AS (SELECT doc_id, source, lang, k, item, count(*) AS c FROM g0 GROUP BY ALL),
    o0 AS (SELECT a.doc_id, a.k, a.c, max(b.c) AS top FROM c0 a JOIN c0 b ON a.source = b.source AND a.lang = b.lang AND a.k = b.k AND a.item = b.item AND a.doc_id <> b.doc_id GROUP BY a.doc_id, a.k, a.item, a.c),
    m0 AS (SELECT doc_id, k, sum(least(c, top)) AS m FROM o0 GROUP BY ALL),
    r0 AS (SELECT a.doc_id, len(a.w) AS n, arg_min(len(b.w), {{'d': abs(len(a.w) - len(b.w)), 'l': len(b.w)}}) AS ref FROM d0 a JOIN d0 b ON a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY ALL),
    p0 AS (SELECT r0.doc_id, n, ref, k.k AS k, n - k.k + 1 AS total, coalesce(m, 0) AS m FROM r0 CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(k) LEFT JOIN m0 ON m0.doc_id = r0.doc_id AND m0.k = k.k),
    z0 AS (SELECT *, sum(CASE WHEN total > 0 AND m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS zeros FROM p0),
    l0 AS (SELECT doc_id, n, ref, sum(m) AS any_match, avg(CASE WHEN m > 0 THEN ln(m / total) ELSE -ln(2 ** zeros * total) END) FILTER (WHERE total > 0) AS lg FROM z0 GROUP BY ALL),
    bl AS (SELECT doc_id, n, ref, CASE WHEN any_match > 0 THEN exp(lg) * CASE WHEN n < ref THEN exp(1 - ref / n) ELSE 1 END ELSE 0 END AS bleu FROM l0)
"""


@query(
    "txt2_self_bleu",
    f"WITH {_BLEU_SQL} SELECT d0.doc_id, CAST(len(w) AS INTEGER) AS len, CAST(ref AS INTEGER) AS ref_len, round(bleu, 9) + 0.0 AS self_bleu FROM d0 LEFT JOIN bl USING (doc_id)",
)
def txt2(spark, sf):
    return _round(ngrams.self_bleu(_tokens(spark, sf), "doc_id", GROUP, "t"), 9, "self_bleu").drop(*GROUP)


@query(
    "txt3_overlap_bleu",
    f"""
    WITH d AS (SELECT doc_id, source, lang, {_TOK_SQL} AS w FROM documents), s AS (SELECT doc_id, source, lang, len(w) AS n, list_distinct(w) AS a, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM d),
    p AS (SELECT x.doc_id, any_value(x.n) AS n, count(y.doc_id) AS refs, sum(len(list_intersect(x.a, y.a))) AS m1, sum(len(list_intersect(x.b, y.b))) AS m2 FROM s x LEFT JOIN s y ON x.source = y.source AND x.lang = y.lang AND x.doc_id <> y.doc_id GROUP BY x.doc_id)
    SELECT doc_id, round(CASE WHEN refs > 0 AND n > 1 AND m1 > 0 AND m2 > 0 THEN sqrt(m1 / (n * refs) * (m2 / ((n - 1) * refs))) ELSE 0 END, 9) + 0.0 AS overlap FROM p
    """,
)
def txt3(spark, sf):
    return _round(ngrams.overlap_bleu(_tokens(spark, sf), "doc_id", GROUP, "t"), 9, "overlap").drop(*GROUP)


@query(
    "txt4_group_diversity",
    f"""WITH {_BLEU_SQL}, {_WINDOW_SQL},
    xa AS (SELECT r.doc_id, r.source, r.lang, bleu, (d1 + d2) / 2 AS dist FROM r JOIN bl USING (doc_id)),
    ga AS (SELECT source, lang, count(*) AS n, avg(bleu) AS sb, avg(dist) AS dg, coalesce(stddev_samp(bleu), 0) / (abs(avg(bleu)) + 1e-8) AS cv1, coalesce(stddev_samp(dist), 0) / (abs(avg(dist)) + 1e-8) AS cv2, CAST(replace(source, 'src', '') AS INTEGER) / 10 AS temp FROM xa GROUP BY ALL),
    ea AS (SELECT quantile_cont(sb, .05) AS lo, quantile_cont(sb, .95) AS hi FROM ga),
    ha AS (SELECT ga.*, 1 - least(1, greatest(0, (sb - lo) / (hi - lo))) AS om FROM ga, ea),
    ka AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY round(om, 9)) + (count(*) OVER (PARTITION BY lang, round(om, 9)) - 1) / 2 AS r1, rank() OVER (PARTITION BY lang ORDER BY round(dg, 9)) + (count(*) OVER (PARTITION BY lang, round(dg, 9)) - 1) / 2 AS r2,
        rank() OVER (PARTITION BY lang ORDER BY temp) AS rt FROM ha),
    ca AS (SELECT lang, abs(corr(r1, rt)) AS rho1, abs(corr(r2, rt)) AS rho2 FROM ka GROUP BY 1 HAVING count(*) >= 3),
    wa AS (SELECT (SELECT avg(rho1) FROM ca) * (SELECT least(1, greatest(0, 1 - avg(cv1))) FROM ga) AS q1, (SELECT avg(rho2) FROM ca) * (SELECT least(1, greatest(0, 1 - avg(cv2))) FROM ga) AS q2),
    aa AS (SELECT CASE WHEN q1 + q2 > 0 THEN least(.8, greatest(.4, q1 / (q1 + q2))) ELSE .7 END AS alpha FROM wa)
    SELECT source, lang, n, round(sb, 8) AS self_bleu_group, round(om, 7) + 0.0 AS one_minus_self_bleu, round(dg, 8) AS distinct_group, round(alpha, 6) AS alpha, round(alpha * om + (1 - alpha) * dg, 6) + 0.0 AS diversity_score FROM ha, aa""",
)
def txt4(spark, sf):
    bleu = ngrams.self_bleu(_tokens(spark, sf), "doc_id", GROUP, "t").select("doc_id", "self_bleu")
    dist = _distinct(spark, sf).select("doc_id", *GROUP, ((F.col("distinct_1") + F.col("distinct_2")) / 2).alias("dist"))
    scored = dist.join(bleu, "doc_id").where("self_bleu is not null")
    noise = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)) / (F.abs(F.avg(c)) + 1e-8)
    groups = scored.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.avg("self_bleu").alias("sb"), F.avg("dist").alias("dg"), noise("self_bleu").alias("cv1"), noise("dist").alias("cv2")
    )
    # One row per configuration group is written once and read by every limit below.
    groups = reliable(groups.withColumn("temp", F.regexp_extract("source", "src([0-9]+)", 1).cast("int") / 10))
    scaled = scoring.robust_scale(groups, "sb", "om", higher_better=False)
    keyed = scaled.select("lang", rnd("om", 9).alias("om9"), rnd("dg", 9).alias("dg9"), "temp")
    keyed = attach_ranks(keyed, ["lang"], {"om9": "r1", "dg9": "r2", "temp": "rt"})
    per_lang = keyed.groupBy("lang").agg(F.abs(corr("r1", "rt")).alias("rho1"), F.abs(corr("r2", "rt")).alias("rho2"), F.count("*").alias("m"))
    rho = scalar(per_lang.where("m >= 3").agg(F.avg("rho1").alias("a"), F.avg("rho2").alias("b")))
    stable = scalar(groups.agg(F.avg("cv1").alias("a"), F.avg("cv2").alias("b")))
    clip = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    q1, q2 = rho["a"] * clip(1 - stable["a"], 0.0, 1.0), rho["b"] * clip(1 - stable["b"], 0.0, 1.0)
    # Fixed limits of the learned weight.
    out = scaled.withColumn("alpha", F.when(q1 + q2 > 0, clip(q1 / (q1 + q2), 0.4, 0.8)).otherwise(0.7))
    score = F.col("alpha") * F.col("om") + (1 - F.col("alpha")) * F.col("dg")
    return out.select(
        *GROUP, "n", rnd("sb", 8).alias("self_bleu_group"), rnd("om", 7).alias("one_minus_self_bleu"), rnd("dg", 8).alias("distinct_group"),
        rnd("alpha").alias("alpha"), rnd(score).alias("diversity_score"),
    )


_PPL_SQL = f"""
    d1 AS (SELECT doc_id, lang, source < 'src15' AS ref, {_TOK_SQL} AS w FROM documents), u1 AS (SELECT lang, ref, unnest(w) AS w FROM d1),
    b1 AS (SELECT doc_id, lang, ref, unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM d1),
    uc AS (SELECT lang, w, count(*) FILTER (WHERE ref) AS k FROM u1 GROUP BY ALL), tc AS (SELECT lang, sum(k) AS total, count(*) FILTER (WHERE k > 0) AS v FROM uc GROUP BY 1),
    bc AS (SELECT lang, p, count(*) FILTER (WHERE ref) AS k FROM b1 GROUP BY ALL),
    lp AS (SELECT bc.lang, bc.p, ln((y.k + 1) / (total + v + 1)) AS lp1, ln(CASE WHEN x.k > 0 THEN .7 * bc.k / x.k + .3 * (y.k + 1) / (total + v + 1) ELSE (y.k + 1) / (total + v + 1) END) AS lp2
      FROM bc JOIN uc x ON x.lang = bc.lang AND x.w = bc.p.a JOIN uc y ON y.lang = bc.lang AND y.w = bc.p.b JOIN tc ON tc.lang = bc.lang),
    pp AS (SELECT doc_id, count(*) AS n, exp(-avg(lp2)) AS ppl_bigram, exp(-avg(lp1)) AS ppl_unigram FROM b1 JOIN lp ON lp.lang = b1.lang AND lp.p = b1.p GROUP BY doc_id)
"""


def _perplexity(spark, sf):
    docs = _tokens(spark, sf).withColumn("ref", F.col("source") < "src15")
    return ngrams.perplexity(docs, "doc_id", ["lang"], "t", "ref")


@query("txt5_perplexity", f"WITH {_PPL_SQL} SELECT doc_id, n, round(ppl_bigram, 5) AS ppl_bigram, round(ppl_unigram, 5) AS ppl_unigram FROM pp")
def txt5(spark, sf):
    return _round(_perplexity(spark, sf), 5, "ppl_bigram", "ppl_unigram")


@query(
    "txt5_trigram_backoff",
    f"""WITH x AS (SELECT doc_id, lang, source < 'src15' AS ref, list_concat(['', ''], {_TOK_SQL}) AS w FROM documents),
    g AS (SELECT doc_id, lang, ref, unnest(list_transform(range(3, len(w) + 1), lambda i: {{'a': w[i - 2], 'b': w[i - 1], 'w': w[i]}}), recursive := true) FROM x),
    t3 AS (SELECT lang, a, b, w, count(*) FILTER (WHERE ref) AS k FROM g GROUP BY ALL), t1 AS (SELECT lang, w, sum(k) AS k FROM t3 GROUP BY ALL),
    p1 AS (SELECT lang, w, (k + 1) / (sum(k) OVER l + count(*) FILTER (WHERE k > 0) OVER l + 1) AS p FROM t1 WINDOW l AS (PARTITION BY lang)),
    t2 AS (SELECT t.lang, b, w, k, p FROM (SELECT lang, b, w, sum(k) AS k FROM t3 GROUP BY ALL) t JOIN p1 USING (lang, w)),
    p2 AS (SELECT lang, b, w, CASE WHEN sum(k) OVER c = 0 THEN p WHEN k > 0 THEN (k - .75) / sum(k) OVER c ELSE p * .75 * count(*) FILTER (WHERE k > 0) OVER c / sum(k) OVER c / (1 - coalesce(sum(p) FILTER (WHERE k > 0) OVER c, 0)) END AS p FROM t2 WINDOW c AS (PARTITION BY lang, b)),
    u3 AS (SELECT t3.*, p FROM t3 JOIN p2 USING (lang, b, w)),
    p3 AS (SELECT lang, a, b, w, CASE WHEN sum(k) OVER c = 0 THEN p WHEN k > 0 THEN (k - .75) / sum(k) OVER c ELSE p * .75 * count(*) FILTER (WHERE k > 0) OVER c / sum(k) OVER c / (1 - coalesce(sum(p) FILTER (WHERE k > 0) OVER c, 0)) END AS p FROM u3 WINDOW c AS (PARTITION BY lang, a, b))
    SELECT doc_id, count(*) AS n, round(exp(-avg(ln(p))), 5) AS ppl_trigram FROM g JOIN p3 USING (lang, a, b, w) GROUP BY doc_id""",
)
def txt5_trigram(spark, sf):
    """Trigrams with absolute discounting and backoff; every token is scored."""
    docs = _tokens(spark, sf).withColumn("ref", F.col("source") < "src15")
    return _round(backoff.trigram_perplexity(docs, "doc_id", ["lang"], "t", "ref"), 5, "ppl_trigram")


@query(
    "txt6_fluency_score",
    f"""WITH {_PPL_SQL}, g1 AS (SELECT doc_id, ({_GRAMMAR_SQL}) / greatest(len(regexp_extract_all(text, '[A-Za-z]+')), 1) * 100 AS err FROM documents), j AS (SELECT pp.doc_id, ppl_bigram AS p, err FROM pp JOIN g1 USING (doc_id)),
    e AS (SELECT quantile_cont(p, .05) AS pl, quantile_cont(p, .95) AS ph, quantile_cont(err, .05) AS el, quantile_cont(err, .95) AS eh FROM j)
    SELECT doc_id, round(1 - least(1, greatest(0, (p - pl) / (ph - pl))), 7) + 0.0 AS ppl_score, round(1 - least(1, greatest(0, (err - el) / (eh - el))), 7) + 0.0 AS grammar_score,
      round(.8 * (1 - least(1, greatest(0, (p - pl) / (ph - pl)))) + .2 * (1 - least(1, greatest(0, (err - el) / (eh - el)))), 7) + 0.0 AS fluency FROM j, e""",
)
def txt6(spark, sf):
    text = F.col("text")
    rate = tx.grammar_errors(text) / F.greatest(tx.count_words(text, "letters"), F.lit(1)) * 100
    errors = busy_table(spark, sf, "documents").select("doc_id", rate.alias("err"))
    # Two narrow columns per document are written once for limits and scores.
    df = reliable(_perplexity(spark, sf).select("doc_id", "ppl_bigram").join(errors, "doc_id"))
    df = scoring.robust_scale(df, "ppl_bigram", "ppl_score", higher_better=False)
    df = scoring.robust_scale(df, "err", "grammar_score", higher_better=False)
    # Fixed shares of the two parts.
    df = df.withColumn("fluency", 0.8 * F.col("ppl_score") + 0.2 * F.col("grammar_score"))
    return _round(df.select("doc_id", "ppl_score", "grammar_score", "fluency"), 7, "ppl_score", "grammar_score", "fluency")


@query(
    "txt7_embedding_continuity",
    f"""WITH {_SIMS_SQL} SELECT label, count(*) AS gaps, round(avg(similarity), 8) + 0.0 AS mean, round(stddev_pop(similarity), 8) AS std, round(max(similarity), 8) AS high, round(min(similarity), 8) AS low,
      round(quantile_cont(similarity, .5), 8) + 0.0 AS median FROM s GROUP BY 1""",
)
def txt7(spark, sf):
    sims = _sims(spark, sf).select("label", "similarity")
    stats = sims.groupBy("label").agg(
        F.count("*").alias("gaps"), F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std"), F.max("similarity").alias("high"), F.min("similarity").alias("low")
    )
    median = quantiles(sims, ["label"], "similarity", {"median": 0.5}).drop("n")
    return _round(stats.join(median, "label"), 8, "mean", "std", "high", "low", "median")


@query(
    "txt7_sentence_continuity",
    """
    WITH s AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^.!?\\n]+')) AS st, generate_subscripts(regexp_extract_all(lower(text), '[^.!?\\n]+'), 1) AS i FROM documents),
    t AS (SELECT doc_id, i, unnest(regexp_extract_all(st, '[\\p{L}\\p{N}]+')) AS item FROM s), c AS (SELECT doc_id, i, item, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, i FROM t)),
    f AS (SELECT item, count(*) AS df FROM c GROUP BY 1), w AS (SELECT doc_id, i, item, c * ln(1 + n / df) AS x FROM c JOIN f USING (item), n), m AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM w GROUP BY ALL),
    d AS (SELECT a.doc_id, a.i, sum(a.x * b.x) AS d FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.item = b.item AND b.i = a.i + 1 GROUP BY ALL),
    g AS (SELECT a.doc_id, coalesce(d, 0) / (a.norm * b.norm) AS s FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.i = a.i + 1 LEFT JOIN d ON d.doc_id = a.doc_id AND d.i = a.i)
    SELECT doc_id, count(*) AS gaps, round(avg(s), 8) + 0.0 AS mean, round(stddev_pop(s), 7) + 0.0 AS std, round(max(s), 8) AS high, round(min(s), 8) AS low FROM g GROUP BY 1
    """,
)
def txt7_documents(spark, sf):
    out = ngrams.sentence_continuity(busy_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return _round(_round(out, 8, "mean", "high", "low"), 7, "std")


@query(
    "txt11_method_agreement",
    """
    WITH e AS (SELECT user_id, event_id, ts, value AS a, CAST(json_extract(props, '$.k') AS DOUBLE) AS b FROM events),
    r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY a) + (count(*) OVER (PARTITION BY user_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY user_id ORDER BY b) + (count(*) OVER (PARTITION BY user_id, b) - 1) / 2 AS rb,
      a - lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS da, b - lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS db FROM e)
    SELECT user_id, count(*) AS n, round(corr(a, b), 8) + 0.0 AS pearson, round(corr(ra, rb), 8) + 0.0 AS spearman, round(avg(CASE WHEN da IS NULL THEN NULL WHEN sign(da) = sign(db) THEN 1.0 ELSE 0.0 END), 9) AS direction,
      CASE WHEN abs(corr(a, b)) > .7 THEN 'High' WHEN abs(corr(a, b)) > .5 THEN 'Medium' ELSE 'Low' END AS level FROM r GROUP BY 1
    """,
)
def txt11(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("a"), F.from_json("props", "k double")["k"].alias("b"))
    ranked = attach_ranks(df, ["user_id"], {"a": "ra", "b": "rb"})
    stats = ranked.groupBy("user_id").agg(F.count("*").alias("n"), corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"))
    ways = seq.direction_agreement(df, ["user_id"], "ts", "a", "b", ["event_id"]).select("user_id", F.col("agreement").alias("direction"))
    strength = F.abs("pearson")
    level = F.when(strength > 0.7, "High").when(strength > 0.5, "Medium").otherwise("Low")
    return _round(_round(stats.join(ways, "user_id", "left").withColumn("level", level), 8, "pearson", "spearman"), 9, "direction")


_ARC_SQL = ", ".join(f"{{'o': {i}, 'code': '{code}', 'c': {curve}}}" for i, (_, code, curve) in enumerate(seq.ARCS))


@query(
    "txt13_archetypes",
    f"""WITH {TWO_SQL}, w2 AS (SELECT doc_id, primary_score AS x, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1) / nullif(count(*) OVER (PARTITION BY doc_id) - 1, 0) AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM s2),
    c2 AS (SELECT doc_id, n, x, unnest([{_ARC_SQL}]) AS k FROM w2), sc AS (SELECT doc_id, n, k.o AS o, k.code AS code, round(greatest(0, coalesce(sum(x * k.c) / nullif(sqrt(sum(x * x)) * sqrt(sum(k.c * k.c)), 0), 0)), 4) AS s FROM c2 GROUP BY ALL),
    a2 AS (SELECT doc_id, CASE WHEN n < 3 THEN 'UK' ELSE arg_max(code, {{'s': s, 'o': -o}}) END AS code FROM sc GROUP BY doc_id, n), ct AS (SELECT lang, code, count(*) AS n FROM a2 JOIN documents USING (doc_id) GROUP BY ALL),
    tt AS (SELECT sum(n) AS t FROM ct), ex AS (SELECT l.lang, k.code, coalesce(ct.n, 0) AS n, l.n * k.n / t AS e FROM (SELECT lang, sum(n) AS n FROM ct GROUP BY 1) l CROSS JOIN (SELECT code, sum(n) AS n FROM ct GROUP BY 1) k LEFT JOIN ct ON ct.lang = l.lang AND ct.code = k.code, tt)
    SELECT lang, code, CAST(n AS BIGINT) AS n, round(e, 7) AS expected, round((n - e) * (n - e) / e, 7) AS chi_part FROM ex""",
)
def txt13(spark, sf):
    from corpusgauge.operators.inference import contingency

    arcs = seq.arc_labels(two_scorers(spark, sf), ["doc_id"], "block", "primary").select("doc_id", "code")
    labelled = arcs.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    cells = contingency(labelled, "lang", "code")
    part = (F.col("n") - F.col("expected")) ** 2 / F.col("expected")
    return cells.select("lang", "code", "n", rnd("expected", 7).alias("expected"), rnd(part, 7).alias("chi_part"))


_COMPLEX_SQL = """
    p AS (SELECT l_suppkey, CASE WHEN l_linenumber < 3 THEN l_linenumber / 3 WHEN l_linenumber <= 5 THEN 1.0 ELSE greatest(0, 1 - (l_linenumber - 5) / 5) END AS ch, l_tax AS li, l_quantity AS ev, l_extendedprice AS x, l_discount AS y FROM lineitem WHERE l_discount >= .02),
    e AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh, quantile_cont(li, .05) AS ll, quantile_cont(li, .95) AS lh, quantile_cont(ev, .05) AS el, quantile_cont(ev, .95) AS eh FROM p),
    q AS (SELECT p.*, .5 * (x - xl) / (xh - xl) + .5 * (y - yl) / (yh - yl) AS target, least(1, greatest(0, (li - ll) / (lh - ll))) AS ln, least(1, greatest(0, (ev - el) / (eh - el))) AS en FROM p, e),
    k AS (SELECT greatest(.05, .5 * (1 + .15 * corr(ch, target))) AS a, greatest(.05, .3 * (1 + .15 * corr(li, target))) AS b, greatest(.05, .2 * (1 + .15 * corr(ev, target))) AS c FROM q),
    w AS (SELECT a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM k)
"""


def complexity_frame(spark, sf):
    """Gate, normalised components and quality target of the structure index."""
    line = F.col("l_linenumber").cast("double")
    base = table(spark, sf, "lineitem").where("l_discount >= 0.02").select(
        "l_suppkey", scoring.optimal_range(line, 3, 5.0).alias("ch"), F.col("l_tax").alias("li"), F.col("l_quantity").alias("ev"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y")
    )
    # All limits are taken on the base rows, so no subquery nests another.
    df = attach(base, base.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]), "ends")
    for c in ("li", "ev"):
        df = attach(df, quantiles(base, [], c, {"lo": 0.05, "hi": 0.95}), f"q_{c}")
    part = lambda c: 0.5 * (F.col(c) - F.col(f"ends.min_{c}")) / (F.col(f"ends.max_{c}") - F.col(f"ends.min_{c}"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"q_{c}.lo")) / (F.col(f"q_{c}.hi") - F.col(f"q_{c}.lo"))))
    return df.select("l_suppkey", "ch", "li", "ev", (part("x") + part("y")).alias("target"), unit("li").alias("ln"), unit("ev").alias("en"))


# Theory weights, largest shift by correlation, least weight.
BASE_WEIGHTS = {"ch": 0.5, "li": 0.3, "ev": 0.2}


def shifted_weights(df):
    """One row of weights: theory weight moved by up to 15% of its correlation."""
    raw = {c: F.greatest(F.lit(0.05), F.lit(w) * (1 + 0.15 * F.coalesce(corr(c, "target"), F.lit(0.0)))) for c, w in BASE_WEIGHTS.items()}
    row = df.agg(*[v.alias(c) for c, v in raw.items()])
    total = F.col("ch") + F.col("li") + F.col("ev")
    return row.select(*[(F.col(c) / total).alias(c) for c in BASE_WEIGHTS])


@query(
    "txt14_structure_complexity",
    f"WITH {_COMPLEX_SQL} SELECT l_suppkey, count(*) AS n, round(avg(a * ch + b * ln + c * en), 7) AS complexity, round(any_value(a), 7) AS w_chapter, round(any_value(b), 7) AS w_function, round(any_value(c), 7) AS w_event FROM q, w GROUP BY 1",
)
def txt14(spark, sf):
    df = complexity_frame(spark, sf)
    rows = attach(df, shifted_weights(df), "w")
    score = F.col("w.ch") * F.col("ch") + F.col("w.li") * F.col("ln") + F.col("w.ev") * F.col("en")
    return rows.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), rnd(F.avg(score), 7).alias("complexity"),
        *[rnd(F.max(F.col(f"w.{c}")), 7).alias(n) for c, n in (("ch", "w_chapter"), ("li", "w_function"), ("ev", "w_event"))],
    )


@query(
    "txt15_weight_sensitivity",
    f"""WITH {_COMPLEX_SQL}, sc AS (SELECT 'base' AS scenario, a, b, c FROM w UNION ALL SELECT 'ch', a * 1.1, b * (1 - a * 1.1) / (1 - a), c * (1 - a * 1.1) / (1 - a) FROM w
      UNION ALL SELECT 'li', a * (1 - b * 1.1) / (1 - b), b * 1.1, c * (1 - b * 1.1) / (1 - b) FROM w UNION ALL SELECT 'ev', a * (1 - c * 1.1) / (1 - c), b * (1 - c * 1.1) / (1 - c), c * 1.1 FROM w)
    SELECT scenario, round(any_value(sc.a), 7) AS w_chapter, round(any_value(sc.b), 7) AS w_function, round(any_value(sc.c), 7) AS w_event, round(avg(sc.a * ch + sc.b * ln + sc.c * en), 7) AS mean, round(stddev_samp(sc.a * ch + sc.b * ln + sc.c * en), 7) AS std FROM q, sc GROUP BY scenario""",
)
def txt15(spark, sf):
    df = complexity_frame(spark, sf)
    df = attach(df, shifted_weights(df), "w")
    w = {c: F.col(f"w.{c}") for c in BASE_WEIGHTS}
    parts = {"ch": "ch", "li": "ln", "ev": "en"}
    scenarios = []
    for raised in (None, *parts):
        if raised is None:
            weights = {c: w[c] for c in parts}
        else:
            shrink = (1 - w[raised] * 1.1) / (1 - w[raised])
            weights = {c: w[c] * (1.1 if c == raised else shrink) for c in parts}
        score = sum((weights[c] * F.col(n) for c, n in parts.items()), F.lit(0.0))
        scenarios.append(
            F.struct(
                F.lit(raised or "base").alias("scenario"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
                *[F.max(weights[c]).alias(n) for c, n in (("ch", "w_chapter"), ("li", "w_function"), ("ev", "w_event"))],
            )
        )
    # All scenarios come from one pass over the rows.
    rows = df.agg(F.array(*scenarios).alias("s")).select(F.inline("s"))
    return _round(rows, 7, "mean", "std", "w_chapter", "w_function", "w_event")


def _neighbour_overlap(sentences):
    """Mean word Jaccard of neighbouring sentences held in one array."""

    def mean(sets):
        later = F.slice(sets, F.lit(2), F.size(sets))
        earlier = F.slice(sets, F.lit(1), F.greatest(F.size(sets) - 1, F.lit(0)))
        jac = F.zip_with(earlier, later, lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))
        return F.coalesce(F.try_divide(F.aggregate(jac, F.lit(0.0), lambda acc, x: acc + x), F.size(jac)), F.lit(0.0))

    return tx.let(F.transform(sentences, lambda s: F.array_distinct(tx.words(s))), mean)


@query(
    "txt17_version_alerts",
    """
    WITH s AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: trim(x)) AS e, list_transform(regexp_extract_all(text, '[^.!?\\n]+'), lambda x: list_distinct(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+'))) AS w FROM conversations),
    m AS (SELECT *, coalesce(list_avg(list_transform(range(1, len(w)), lambda i: len(list_intersect(w[i], w[i+1])) / greatest(len(list_distinct(list_concat(w[i], w[i+1]))), 1))), 0) AS cont FROM s),
    v AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m WHERE turn % 2 = 1),
    j AS (SELECT a.conv_id, b.turn, len(list_filter(list_distinct(b.e), lambda x: NOT list_contains(a.e, x))) AS added, len(list_filter(list_distinct(a.e), lambda x: NOT list_contains(b.e, x))) AS removed, b.cont - a.cont AS change FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn = b.before)
    SELECT conv_id, turn, CAST(added AS INTEGER) AS added, CAST(removed AS INTEGER) AS removed, round(change, 8) + 0.0 AS continuity_change,
      CASE WHEN change < -.2 OR removed > 2 THEN 'high' WHEN change < -.1 OR added > 0 OR removed > 0 THEN 'medium' ELSE 'low' END AS severity FROM j
    """,
)
def txt17(spark, sf):
    # Odd turns are versions of an answer; each is compared with the version before it.
    sentences = tx.found(F.col("text"), r"[^.!?\n]+")
    events = F.transform(sentences, lambda s: F.trim(s))
    df = table(spark, sf, "conversations").where("turn % 2 = 1").select("conv_id", "turn", events.alias("e"), _neighbour_overlap(sentences).alias("cont"))
    versions = ordered(df, ["conv_id"], "turn", prev=["e", "cont"]).where("prev.cont is not null")
    both = versions.select(
        "conv_id",
        "turn",
        F.size(F.array_except("e", F.col("prev.e"))).alias("added"),
        F.size(F.array_except(F.col("prev.e"), "e")).alias("removed"),
        (F.col("cont") - F.col("prev.cont")).alias("change"),
    )
    worse, gone, any_event = F.col("change"), F.col("removed"), (F.col("added") > 0) | (F.col("removed") > 0)
    severity = F.when((worse < -0.2) | (gone > 2), "high").when((worse < -0.1) | any_event, "medium").otherwise("low")
    return both.select("conv_id", "turn", "added", "removed", rnd("change", 8).alias("continuity_change"), severity.alias("severity"))


@query(
    "txt18_exact_copies",
    "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
)
def txt18(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    firsts = df.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    return df.join(firsts, "digest").where("doc_id <> first_id").select("doc_id", "first_id")


@query(
    "txt18_near_copies",
    f"""
    WITH t AS (SELECT doc_id, {_TOK_SQL} AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM t WHERE len(w) > 1),
    p AS (SELECT b.doc_id, a.doc_id AS first_id, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM s a JOIN s b
      ON a.doc_id < b.doc_id AND len(a.s) >= .6 * len(b.s) AND len(b.s) >= .6 * len(a.s))
    SELECT doc_id, min(first_id) AS first_id, round(arg_min(c / (n - c), first_id), 9) AS jaccard FROM p WHERE c / (n - c) >= .6 GROUP BY doc_id
    """,
)
def txt18_near(spark, sf):
    docs = busy_table(spark, sf, "documents").select("doc_id", "text")
    out = ngrams.first_copies(docs, "doc_id", tx.tokens(tx.strip_markdown(F.col("text"))))
    return _round(out, 9, "jaccard")


@query(
    "txt19_scorer_comparison",
    f"""WITH {TWO_SQL}, d2 AS (SELECT doc_id, round(avg(primary_score), 9) AS a, round(avg(validation), 9) AS b FROM s2 GROUP BY 1),
    r2 AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d2)
    SELECT x.scorer, n, round(m, 8) + 0.0 AS mean, n_zero, CASE WHEN n_zero * 2 > n THEN 'weak' ELSE 'ok' END AS status, round((SELECT corr(ra, rb) FROM r2), 7) AS rank_agreement FROM (
      SELECT 'primary' AS scorer, count(*) AS n, avg(a) AS m, count(*) FILTER (WHERE a = 0) AS n_zero FROM d2 UNION ALL SELECT 'validation', count(*), avg(b), count(*) FILTER (WHERE b = 0) FROM d2) x""",
)
def txt19(spark, sf):
    per_doc = two_scorers(spark, sf).groupBy("doc_id").agg(rnd(F.avg("primary"), 9).alias("primary"), rnd(F.avg("validation"), 9).alias("validation"))
    per_doc = reliable(per_doc)  # one narrow row per document, read by each scorer
    ranked = attach_ranks(per_doc, [], {"primary": "ra", "validation": "rb"})
    agree = scalar(ranked.agg(corr("ra", "rb").alias("r")))["r"]
    rows = per_doc.unpivot(["doc_id"], ["primary", "validation"], "scorer", "score")
    stats = rows.groupBy("scorer").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.count_if(F.col("score") == 0).alias("n_zero"))
    status = F.when(F.col("n_zero") * 2 > F.col("n"), "weak").otherwise("ok")
    return stats.select("scorer", "n", rnd("m", 8).alias("mean"), "n_zero", status.alias("status"), rnd(agree, 7).alias("rank_agreement"))

"""String rules and token-level measures on the driver tables."""

from pyspark.sql import functions as F

from corpusgauge import fixed
from corpusgauge.functions import text as tx
from corpusgauge.functions.common import flat, flat_structs, inline, ratio, rnd, sql_values
from corpusgauge.operators import scoring
from corpusgauge.registry import query
from corpusgauge.session import reliable
from corpusgauge.sources.tables import busy_table, table


def _docs(spark, sf, *extra):
    return busy_table(spark, sf, "documents").select("doc_id", *extra, "text")


_MD_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '#+[ \\t\\r\\n\\f]*[^\\n]*\\n', '', 'g'), '[*_`]', '', 'g'), '\\n+', ' ', 'g')"
_TOK_SQL = f"regexp_extract_all(lower({_MD_SQL}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query("str1_strip_markdown", f"SELECT doc_id, md5({_MD_SQL}) AS clean_md5, length({_MD_SQL}) AS n FROM documents")
def str1(spark, sf):
    clean = tx.strip_markdown(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("bigint").alias("n"))


@query(
    "str1_strip_html",
    """
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS clean_md5 FROM a
    """,
)
def str1_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("clean_md5"))


@query(
    "str2_chapter_split",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)
    SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(number AS VARCHAR) || ' in C#' AS title, length(body) + length('\n## notes in C#\n')
      - CASE WHEN doc_id % 3 = 0 AND number < max(number) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS n_body FROM l
    """,
)
def str2(spark, sf):
    # Every line becomes a chapter; headings come in both kinds (or as plain "# "
    # lines in every third document) and bodies hold marks that are no headings.
    number = lambda i: (i + 1).cast("string")
    western = lambda i: F.concat(F.lit("# Chapter "), number(i), F.lit(": "))
    eastern = lambda i: F.concat(F.lit("# 第"), number(i), F.lit("章："))
    plain = F.col("doc_id") % 3 == 0
    head = lambda i: F.when(plain, F.lit("# ")).when(i % 2 == 0, western(i)).otherwise(eastern(i))
    titled = F.transform(
        F.split("text", "\n"), lambda s, i: F.concat(head(i), number(i), F.lit(" in C#\n"), s, F.lit("\n## notes in C#\n"))
    )
    story = _docs(spark, sf).select("doc_id", F.array_join(titled, "").alias("story"))
    rows = flat_structs(story, ["doc_id"], tx.chapters(F.col("story")), "number")
    return rows.select("doc_id", F.col("number").cast("int").alias("number"), "title", F.length("body").cast("bigint").alias("n_body"))


@query(
    "str3_sentence_rules",
    """
    WITH a AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(replace(trim(text), '...', '〈E〉'), '[^.。!！?？;；\\n]+[.。!！?？;；]+|[^.。!！?？;；\\n]+$|[^.。!！?？;；\\n]+'), lambda s: trim(replace(s, '〈E〉', '...'))), lambda s: length(s) >= 2) AS k,
      list_transform(string_split_regex(text, '[。！？.!?]+'), lambda s: trim(regexp_replace(s, '^[ \\n]+|[ \\n]+$', '', 'g'))) AS p FROM documents)
    SELECT doc_id, len(k) AS kept, md5(array_to_string(k, '|')) AS kept_md5, len(list_filter(p, lambda s: length(s) > 0)) AS split_all, len(list_filter(p, lambda s: length(s) > 10)) AS split_long FROM a
    """,
)
def str3(spark, sf):
    t = F.col("text")
    kept = tx.sentences_kept(t)
    return _docs(spark, sf).select(
        "doc_id",
        F.size(kept).cast("bigint").alias("kept"),
        F.md5(F.array_join(kept, "|")).alias("kept_md5"),
        F.size(tx.sentences_split(t)).cast("bigint").alias("split_all"),
        F.size(tx.sentences_split(t, 10)).cast("bigint").alias("split_long"),
    )


@query(
    "str4_word_counts",
    "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS INTEGER) AS {n}" for n, p in tx.WORD_RULES.items()) + " FROM documents",
)
def str4(spark, sf):
    return _docs(spark, sf).select("doc_id", *[tx.count_words(F.col("text"), r).alias(r) for r in tx.WORD_RULES])


@query("str5_tokenise", f"SELECT doc_id, len({_TOK_SQL}) AS n, md5(array_to_string({_TOK_SQL}, ' ')) AS tokens_md5 FROM documents")
def str5(spark, sf):
    toks = _docs(spark, sf).select("doc_id", tx.tokens(tx.strip_markdown(F.col("text"))).alias("t"))
    return toks.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "str6_punctuation",
    """
    WITH w AS (SELECT doc_id, replace(text, ',', '，') || '!!??' AS t FROM documents),
    x AS (SELECT doc_id, t, CASE WHEN len(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]')) > len(regexp_extract_all(t, '[A-Za-z]')) THEN translate(t, ',.!?:;()', '，。！？：；（）') ELSE translate(t, '，。！？：；（）', ',.!?:;()') END AS y FROM w)
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, ',+', ',', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g'), ':+', ':', 'g'), ';+', ';', 'g')) AS clean_md5, length(t) - length(replace(t, '，', '')) AS n_changed FROM x
    """,
)
def str6(spark, sf):
    wide = F.concat(F.replace("text", F.lit(","), F.lit("，")), F.lit("!!??"))
    df = _docs(spark, sf).select("doc_id", wide.alias("t"))
    return df.select(
        "doc_id", F.md5(tx.normal_punctuation(F.col("t"))).alias("clean_md5"), F.regexp_count("t", F.lit("，")).cast("bigint").alias("n_changed")
    )


_GRAMMAR_SQL = (
    "len(regexp_extract_all(text, '[ \\t\\r\\n\\f]{3,}')) + len(list_filter(regexp_extract_all(lower(text), '[\\p{L}]+'), lambda w: w IN ("
    + ", ".join(f"'{w}'" for w in fixed.MISSPELLINGS)
    + "))) + len(regexp_extract_all(text, '(^|[^\\p{L}])a[ \\t\\r\\n\\f]+[aeiouAEIOU]')) + len(regexp_extract_all(text, '(^|[^\\p{L}])an[ \\t\\r\\n\\f]+[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]'))"
)


@query(
    "str7_grammar_rate",
    f"""
    WITH g AS (SELECT doc_id, {_GRAMMAR_SQL} AS errors, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents)
    SELECT doc_id, CAST(errors AS INTEGER) AS errors, CAST(words AS INTEGER) AS words, CASE WHEN words > 0 THEN round(errors / words * 100, 8) END AS per_100 FROM g
    """,
)
def str7(spark, sf):
    df = _docs(spark, sf).select("doc_id", tx.grammar_errors(F.col("text")).alias("errors"), tx.count_words(F.col("text"), "letters").alias("words"))
    return df.withColumn("per_100", rnd(ratio(F.col("errors"), F.col("words")) * 100, 8))


_PROFILES = {"emotion": fixed.EMOTION_WORDS, "action": fixed.ACTION_WORDS, "object": fixed.OBJECT_WORDS}


def _mentions(wanted):
    return lambda sentence: tx.contains_any(sentence, wanted)


def _list_sql(items) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


@query(
    "str8_concreteness",
    "WITH s AS (SELECT doc_id, regexp_extract_all(unnest(regexp_extract_all(lower(text), '[^.!?\\n]+')), '[\\p{L}\\p{N}]+') AS w FROM documents) SELECT doc_id, count(*) AS n_sentences, "
    + ", ".join(f"count(*) FILTER (WHERE list_has_any(w, {_list_sql(v)})) AS n_{k}, round(count(*) FILTER (WHERE list_has_any(w, {_list_sql(v)})) / count(*), 9) AS {k}_share" for k, v in _PROFILES.items())
    + " FROM s GROUP BY doc_id",
)
def str8(spark, sf):
    # Sentences stay inside the document row: counts need no shuffle.
    parts = F.transform(tx.found(F.lower("text"), r"[^.!?\n]+"), lambda s: tx.found(s, tx.WORD))
    df = _docs(spark, sf).select("doc_id", parts.alias("s"))
    n = F.nullif(F.size("s"), F.lit(0))
    out = [F.col("doc_id"), n.cast("bigint").alias("n_sentences")]
    for name, wanted in _PROFILES.items():
        hits = F.size(F.filter("s", _mentions(wanted)))
        out += [hits.cast("bigint").alias(f"n_{name}"), rnd(hits / n, 9).alias(f"{name}_share")]
    return df.select(*out).where("n_sentences is not null")


@query(
    "str9_token_estimate",
    """
    SELECT doc_id, CAST(greatest(floor(len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) / 1.5 + (length(text) - len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))) / 4), 1) AS BIGINT) AS tokens FROM documents
    """,
)
def str9(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    "str10_recompose",
    """
    WITH p AS (SELECT conv_id, turn // 2 AS s, turn, text FROM conversations WHERE role <> 'assistant'), d AS (SELECT conv_id, turn // 2 AS s, turn, '"' || text || '" ——' || role AS line FROM conversations WHERE role = 'assistant'),
    l AS (SELECT conv_id, s, 0 AS kind, turn, text AS line FROM p UNION ALL SELECT conv_id, s, 1, turn, line FROM d)
    SELECT conv_id, s AS sentence, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY kind, turn)) AS block_md5 FROM l GROUP BY ALL
    """,
)
def str10(spark, sf):
    said = F.concat(F.lit('"'), "text", F.lit('" ——'), "role")
    is_plot = F.col("role") != "assistant"
    line = F.struct(F.when(is_plot, 0).otherwise(1).alias("kind"), "turn", F.when(is_plot, F.col("text")).otherwise(said).alias("line"))
    rows = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("sentence"), line.alias("x"))
    # One block holds one sentence and its own lines.
    blocks = rows.groupBy("conv_id", "sentence").agg(F.sort_array(F.collect_list("x")).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["line"]), "\n")
    return blocks.select("conv_id", "sentence", F.size("a").cast("bigint").alias("n_lines"), F.md5(text).alias("block_md5"))


@query(
    "str11_quoted_dialogue",
    """
    SELECT conv_id, turn, role AS speaker, length(replace(text, '"', '')) AS n_chars FROM conversations WHERE role IN ('user', 'assistant') AND replace(text, '"', '') <> ''
    """,
)
def str11(spark, sf):
    plain = F.replace("text", F.lit('"'), F.lit(""))
    story = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('He waited. "'), plain, F.lit('" ——'), "role", F.lit(" left.")).alias("text"))
    pattern = F.lit(r'"([^"]+)" ——([\p{L}]+)')
    pairs = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("said"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("speaker"))
    rows = story.select("conv_id", "turn", F.inline(pairs))
    return rows.where(F.col("speaker").isin("user", "assistant")).select("conv_id", "turn", "speaker", F.length("said").cast("bigint").alias("n_chars"))


_WINDOW_SQL = f"""
    t AS (SELECT doc_id, source, lang, {_TOK_SQL} AS w FROM documents),
    s AS (SELECT doc_id, source, lang, w, unnest(CASE WHEN len(w) < 1000 THEN [0] ELSE list_distinct(list_concat(range(0, len(w) - 1000 + 1, 500), [len(w) - 1000])) END) AS st FROM t),
    u AS (SELECT doc_id, source, lang, st, w[st + 1 : st + 1000] AS x, len(w) AS n FROM s),
    g AS (SELECT *, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) AS b FROM u),
    d AS (SELECT doc_id, source, lang, st, n, len(list_distinct(x)) / (len(x) + 1) AS d1, len(list_distinct(b)) / (len(b) + 1) AS d2, len(x) AS size FROM g),
    r AS (SELECT doc_id, source, lang, any_value(n) AS n_tokens, CASE WHEN any_value(n) >= 10 THEN avg(d1) ELSE 0 END AS d1, CASE WHEN any_value(n) >= 10 THEN avg(d2) ELSE 0 END AS d2 FROM d GROUP BY ALL)
"""


def _distinct(spark, sf):
    toks = busy_table(spark, sf, "documents").select("doc_id", "source", "lang", tx.tokens(tx.strip_markdown(F.col("text"))).alias("t"))
    scored = toks.select("doc_id", "source", "lang", F.size("t").cast("bigint").alias("n_tokens"), tx.distinct_scores(F.col("t")).alias("s"))
    return scored.select("doc_id", "source", "lang", "n_tokens", "s.distinct_1", "s.distinct_2")


@query("win10_token_windows", f"WITH {_WINDOW_SQL} SELECT doc_id, CAST(st AS INTEGER) AS start, CAST(size AS INTEGER) AS size, round(d1, 9) AS distinct_share FROM d")
def win10(spark, sf):
    toks = _docs(spark, sf).select("doc_id", tx.tokens(tx.strip_markdown(F.col("text"))).alias("t"))

    def window(t, start):
        x = F.slice(t, start + 1, F.lit(1000))
        share = F.size(F.array_distinct(x)) / (F.size(x) + 1)
        return F.struct(start.alias("start"), F.size(x).alias("size"), rnd(share, 9).alias("distinct_share"))

    windows = tx.let(F.col("t"), lambda t: F.transform(tx.window_starts(F.size(t), 1000, 500), lambda s: window(t, s)))
    return flat_structs(toks, ["doc_id"], windows, "start")


@query("txt1_distinct_n", f"WITH {_WINDOW_SQL} SELECT doc_id, n_tokens, round(d1, 9) AS distinct_1, round(d2, 9) AS distinct_2, round(.5 * d1 + .5 * d2, 9) AS distinct_avg FROM r")
def txt1(spark, sf):
    d = _distinct(spark, sf)
    mean = 0.5 * F.col("distinct_1") + 0.5 * F.col("distinct_2")
    return d.select("doc_id", "n_tokens", rnd("distinct_1", 9).alias("distinct_1"), rnd("distinct_2", 9).alias("distinct_2"), rnd(mean, 9).alias("distinct_avg"))


@query(
    "entry_lexical_diversity",
    f"""WITH {_WINDOW_SQL}, a AS (SELECT *, .5 * d1 + .5 * d2 AS m FROM r), e AS (SELECT quantile_cont(m, .05) AS lo, quantile_cont(m, .95) AS hi FROM a),
    z AS (SELECT a.*, least(1, greatest(0, (m - lo) / (hi - lo))) AS score FROM a, e)
    SELECT source, lang, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, round(avg(m), 9) AS distinct_avg, round(avg(score), 8) AS distinct_score, round(stddev_samp(score), 8) AS score_std FROM z GROUP BY ALL""",
)
def entry_query(spark, sf):
    # One narrow row per document is written once; limits and means read it back.
    d = reliable(_distinct(spark, sf).withColumn("m", 0.5 * F.col("distinct_1") + 0.5 * F.col("distinct_2")))
    scored = scoring.robust_scale(d, "m", "score")
    return scored.groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), rnd(F.avg("m"), 9).alias("distinct_avg"),
        rnd(F.avg("score"), 8).alias("distinct_score"), rnd(F.stddev_samp("score"), 8).alias("score_std"),
    )


_LEX = [(w, s) for w, s in fixed.LEXICON if s < 4 or s > 6]
_LEX_B = [(w, s) for w, s in fixed.LEXICON_B if s < 4 or s > 6]


def lexicon_scores(tokens_df, lexicon, keys, out):
    """Mean lexicon value of matched tokens as (mean - 5) / 4 in -1..1; no match is 0."""
    spark = tokens_df.sparkSession
    lex = inline(spark, lexicon, "word string, happiness double")
    marked = tokens_df.join(lex, "word", "left").groupBy(*keys).agg(F.avg("happiness").alias("m"), F.count("happiness").alias(f"n_{out}"))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("m") - 5) / 4))
    return marked.withColumn(out, F.when(F.col("m").isNull(), 0.0).otherwise(value)).drop("m")


def lexicon_sql(tokens: str, lexicon, keys: str, out: str) -> str:
    return (
        f"SELECT {keys}, CASE WHEN count(h) = 0 THEN 0 ELSE greatest(-1, least(1, (avg(h) - 5) / 4)) END AS {out}, count(h) AS n_{out} FROM {tokens} "
        f"LEFT JOIN (SELECT * FROM {sql_values(lexicon, 'word, h')}) USING (word) GROUP BY {keys}"
    )


@query(
    "txt9_lexicon_emotion",
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents), s AS ("
    + lexicon_sql("t", _LEX, "doc_id", "score")
    + ") SELECT doc_id, n_score, round(score, 9) + 0.0 AS score FROM s",
)
def txt9(spark, sf):
    toks = flat(_docs(spark, sf), ["doc_id"], tx.words(F.col("text")), "word")
    return lexicon_scores(toks, _LEX, ["doc_id"], "score").select("doc_id", "n_score", rnd("score", 9).alias("score"))


def block_tokens(spark, sf):
    """Word rows per non-empty line (chapter) of each document, numbered from 1."""
    lines = flat(busy_table(spark, sf, "documents"), ["doc_id"], F.split("text", "\n"), "line", "i")
    return flat(lines, ["doc_id", (F.col("i") + 1).alias("block")], tx.words(F.col("line")), "word")


BLOCK_SQL = """b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS block FROM documents),
    t AS (SELECT doc_id, block, unnest(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+')) AS word FROM b)"""


def two_scorers(spark, sf):
    """Both lexicon scores per block from one pass over the tokens."""
    toks = block_tokens(spark, sf)
    both = {w: [None, None] for w, _ in [*_LEX, *_LEX_B]}
    for i, lex in enumerate((_LEX, _LEX_B)):
        for w, s in lex:
            both[w][i] = s
    lex = inline(spark, [(w, a, b) for w, (a, b) in both.items()], "word string, h1 double, h2 double")
    means = toks.join(lex, "word", "left").groupBy("doc_id", "block").agg(F.avg("h1").alias("m1"), F.avg("h2").alias("m2"))
    score = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(c) - 5) / 4)))
    return means.select("doc_id", "block", score("m1").alias("primary"), score("m2").alias("validation"))


TWO_SQL = BLOCK_SQL + ", p AS (" + lexicon_sql("t", _LEX, "doc_id, block", "primary_score") + "), q AS (" + lexicon_sql("t", _LEX_B, "doc_id, block", "validation") + "), s2 AS (SELECT doc_id, block, primary_score, validation FROM p JOIN q USING (doc_id, block))"


@query("txt10_two_method_series", f"WITH {TWO_SQL} SELECT doc_id, block, round(primary_score, 9) + 0.0 AS primary_score, round(validation, 9) + 0.0 AS validation FROM s2")
def txt10(spark, sf):
    s = two_scorers(spark, sf)
    return s.select("doc_id", "block", rnd("primary", 9).alias("primary_score"), rnd("validation", 9).alias("validation"))


@query(
    "txt12_lexicon_diagnostics",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w, text FROM documents), t AS (SELECT doc_id, unnest(w) AS word FROM d),
    l AS (SELECT * FROM {sql_values(fixed.LEXICON, 'word, h')}),
    s AS (SELECT doc_id, count(*) AS n_words, count(h) AS n_covered, count(*) FILTER (WHERE word IN ({", ".join(f"'{w}'" for w in fixed.NEGATORS)})) AS n_negators,
      round(avg(h), 9) AS with_stops, round(avg(h) FILTER (WHERE word NOT IN ({", ".join(f"'{w}'" for w in fixed.STOP_WORDS)})), 9) AS without_stops FROM t LEFT JOIN l USING (word) GROUP BY 1)
    SELECT s.*, round(n_covered / n_words, 9) AS coverage, n_covered / n_words < .7 AS low_confidence, len(regexp_extract_all(text, '[A-Za-z]+')) AS by_letters, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS by_spaces FROM s JOIN d USING (doc_id)
    """,
)
def txt12(spark, sf):
    # Each word meets its lexicon value in the row: map lookup, no shuffle.
    lex = F.create_map(*[F.lit(x) for pair in fixed.LEXICON for x in pair])
    docs = _docs(spark, sf).select("doc_id", "text", tx.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    kept = lambda ws: F.filter(F.transform(ws, lambda x: F.element_at(lex, x)), lambda h: h.isNotNull())
    total = lambda hs: F.aggregate(hs, F.lit(0.0), lambda a, h: a + h)
    df = docs.select(
        "doc_id", "text", F.size("w").alias("n"), kept(F.col("w")).alias("h"), kept(F.filter("w", lambda x: ~x.isin(fixed.STOP_WORDS))).alias("hs"),
        F.size(F.filter("w", lambda x: x.isin(fixed.NEGATORS))).alias("n_negators"),
    )
    n, c = F.col("n"), F.size("h")
    return df.select(
        "doc_id", n.cast("bigint").alias("n_words"), c.cast("bigint").alias("n_covered"), F.col("n_negators").cast("bigint").alias("n_negators"),
        rnd(F.try_divide(total(F.col("h")), c), 9).alias("with_stops"), rnd(F.try_divide(total(F.col("hs")), F.size("hs")), 9).alias("without_stops"),
        rnd(c / n, 9).alias("coverage"), (c / n < 0.7).alias("low_confidence"),
        tx.count_words(F.col("text"), "letters").cast("bigint").alias("by_letters"), tx.count_words(F.col("text"), "whitespace").cast("bigint").alias("by_spaces"),
    )


@query(
    "txt16_text_features",
    """
    WITH f AS (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, len(regexp_extract_all(text, '[^.!?\\n]+')) AS sentences, len(regexp_extract_all(text, '[^\\n]+')) AS chapters FROM documents)
    SELECT *, round(words / nullif(sentences, 0), 9) AS words_per_sentence, round(words / nullif(chapters, 0), 9) AS words_per_chapter FROM f
    """,
)
def txt16(spark, sf):
    t = F.col("text")
    df = _docs(spark, sf).select(
        "doc_id", F.length(t).cast("bigint").alias("chars"), tx.count_words(t, "letters").cast("bigint").alias("words"),
        F.regexp_count(t, F.lit(r"[^.!?\n]+")).cast("bigint").alias("sentences"), F.regexp_count(t, F.lit(r"[^\n]+")).cast("bigint").alias("chapters"),
    )
    return df.select(
        "*", rnd(ratio(F.col("words"), F.col("sentences")), 9).alias("words_per_sentence"), rnd(ratio(F.col("words"), F.col("chapters")), 9).alias("words_per_chapter")
    )

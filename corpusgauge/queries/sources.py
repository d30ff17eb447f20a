"""Scans, parsing, reshaping and sinks on the driver tables."""

import uuid

from pyspark.sql import functions as F

from corpusgauge.functions.common import rnd
from corpusgauge.functions.records import repaired_json, run_parameters
from corpusgauge.operators.tables import keep_first, long_form, standard_layout, tagged_union
from corpusgauge.registry import query
from corpusgauge.session import shared_folder
from corpusgauge.sources import readers, sinks
from corpusgauge.sources.readers import decoded, pick_story_file
from corpusgauge.sources.sinks import csv_line, markdown_rows
from corpusgauge.sources.tables import table


@query("src1_metrics_scan", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def src1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "src1_csv_quarantine",
    """
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 OR o_orderkey % 97 = 0 OR o_orderkey % 83 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
      CASE WHEN o_orderkey % 89 = 0 THEN 'fields' WHEN o_orderkey % 97 = 0 THEN 'type: o_totalprice' END AS reason FROM orders
    """,
)
def src1_quarantine(spark, sf):
    """Orders as CSV files, some lines cut short, some prices no number, some NaN; read back with the reason of every broken line."""
    n = F.col("o_orderkey")
    price = F.when(n % 97 == 0, "n/a").when(n % 83 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    lines = table(spark, sf, "orders").select(n, "o_orderstatus", F.concat(F.lit('pri "'), "o_orderpriority", F.lit('", late')).alias("note"), price.alias("o_totalprice"))
    path = f"{shared_folder(spark).rstrip('/')}/orders-csv-{uuid.uuid4().hex}"
    sinks.write_csv(lines.where(n % 89 != 0), path)
    lines.where(n % 89 == 0).drop("o_totalprice").write.mode("append").csv(path, header=True, escape='"')
    found = readers.checked_metrics_csv(spark, path, "o_orderkey long, o_orderstatus string, note string, o_totalprice double")
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice", "reason")


@query(
    "src2_story_per_folder",
    """
    WITH f AS (SELECT source || '/' || lang AS folder, doc_id, text,
        CASE WHEN n_chars > 4000 THEN 'enhanced_story.md' WHEN n_chars > 1500 THEN 'novel_story.md'
             WHEN n_chars > 600 THEN 'story.md' ELSE 'notes.md' END AS file FROM documents),
    p AS (SELECT *, CASE file WHEN 'enhanced_story.md' THEN 1 WHEN 'novel_story.md' THEN 2
             WHEN 'story.md' THEN 3 END AS choice FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY choice, doc_id) AS rn
          FROM p WHERE choice IS NOT NULL)
    SELECT folder, file, doc_id, md5(text) AS text_md5 FROM r WHERE rn = 1
    """,
)
def src2(spark, sf):
    n = F.col("n_chars")
    file = (
        F.when(n > 4000, "enhanced_story.md").when(n > 1500, "novel_story.md").when(n > 600, "story.md").otherwise("notes.md")
    )
    files = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang").alias("folder"), file.alias("file"), "doc_id", "text"
    )
    # Among files of one name the lowest doc_id stands for the folder's file.
    single = keep_first(files.select("folder", "file", "doc_id", F.md5("text").alias("text_md5")), ["folder", "file"], ["doc_id"])
    picked = pick_story_file(single, "folder", "file", ["enhanced_story.md", "novel_story.md", "story.md"])
    return picked.select("folder", "file", "doc_id", "text_md5")


@query(
    "src3_nested_json",
    """
    SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n,
           round(avg(value), 10) AS mean_value
    FROM events GROUP BY ALL
    """,
)
def src3(spark, sf):
    parsed = F.from_json("props", "k int")
    df = table(spark, sf, "events").select("event_type", parsed["k"].alias("k"), "value")
    return df.groupBy("event_type", "k").agg(F.count("*").alias("n"), rnd(F.avg("value"), 10).alias("mean_value"))


def _reports(turns):
    """Turns as nested JSON reports whose shape differs by role, as analysis files of several tools do."""
    lines = F.split("text", "\n")
    detailed = F.transform(lines, lambda x: F.struct(F.length(x).alias("size"), F.left(x, F.lit(1)).alias("first")))
    whole = F.to_json(F.struct(F.struct(F.lit("story").alias("kind"), F.struct(F.left("text", F.lit(5)).alias("title")).alias("meta")).alias("head"), detailed.alias("chapters")))
    plain = F.to_json(F.struct(F.transform(lines, F.length).alias("chapters")))
    failed = F.to_json(F.struct(F.lit("no analysis").alias("error"), F.lit("none").alias("chapters")))
    text = F.when(F.col("role") == "user", whole).when(F.col("role") == "assistant", plain).otherwise(failed)
    return turns.select("conv_id", "turn", readers.report(text).alias("doc"))


@query(
    "src3_varying_reports",
    """
    WITH l AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS lines FROM conversations), c AS (SELECT *, unnest(range(len(lines))) AS chapter FROM l WHERE role IN ('user', 'assistant'))
    SELECT conv_id, turn, CAST(chapter AS INTEGER) AS chapter, CAST(length(lines[chapter + 1]) AS INTEGER) AS size, CASE WHEN role = 'user' THEN left(lines[chapter + 1], 1) ELSE '?' END AS first,
      CASE WHEN role = 'user' THEN left(text, 5) ELSE '(none)' END AS title FROM c
    """,
)
def src3_varying(spark, sf):
    """Chapters of reports: structs in some, plain numbers in others, a string where the analysis failed."""
    rows = readers.report_items(_reports(table(spark, sf, "conversations")), "doc", "$.chapters", "chapter", "item")
    item = F.col("item")
    size = F.coalesce(readers.report_field(item, "$.size", "int"), readers.report_field(item, "$", "int"))
    title = readers.report_field(F.col("doc"), "$.head.meta.title", "string", "(none)")
    return rows.select("conv_id", "turn", "chapter", size.alias("size"), readers.report_field(item, "$.first", "string", "?").alias("first"), title.alias("title"))


@query(
    "src4_json_lines_skip_bad",
    """
    WITH l AS (SELECT event_type, CASE WHEN value > 40 THEN left(props, length(props) - 1) ELSE props END AS line FROM events)
    SELECT event_type, count(*) AS n_lines, count(*) FILTER (WHERE json_valid(line)) AS n_good,
           CAST(sum(CASE WHEN json_valid(line) THEN CAST(json_extract(line, '$.k') AS BIGINT) END) AS BIGINT) AS sum_k
    FROM l GROUP BY event_type
    """,
)
def src4(spark, sf):
    # Records above 40 stand for lines cut off while they were written.
    line = F.when(F.col("value") > 40, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    df = table(spark, sf, "events").select("event_type", decoded(line, "k bigint").alias("rec"))
    return df.groupBy("event_type").agg(
        F.count("*").alias("n_lines"), F.count("rec").alias("n_good"), F.sum("rec.k").alias("sum_k")
    )


_WRAPPED = {
    "view": ("```json\n", "\n```"),
    "click": ("Here it is: ", " see [note] } {, Done。"),
    "purchase": ("", '{"k": 1000}'),
    "signup": ("no json ，", ""),
    "error": ("```", "```"),
}


@query(
    "src5_json_repair",
    """
    WITH w AS (
      SELECT event_id, event_type, CASE event_type
        WHEN 'view' THEN '```json' || chr(10) || props || chr(10) || '```'
        WHEN 'click' THEN 'Here it is: ' || props || ' see [note] } {, Done。'
        WHEN 'purchase' THEN props || '{"k": 1000}'
        WHEN 'signup' THEN 'no json ，' || substr(props, 2, length(props) - 2)
        ELSE '```' || props || '```' END AS reply FROM events)
    SELECT event_type, count(*) AS n,
      count(*) FILTER (WHERE event_type <> 'signup') AS n_ok,
      CAST(sum(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN CAST(json_extract(left(reply, length(reply) - 11), '$.k') AS BIGINT) + 1000
          ELSE CAST(regexp_extract(reply, '"k": ([0-9]+)', 1) AS BIGINT) END) AS BIGINT) AS sum_k,
      round(1 - count(*) FILTER (WHERE event_type <> 'signup') / count(*), 6) + 0.0 AS reject_rate
    FROM w GROUP BY event_type
    """,
)
def src5(spark, sf):
    reply = F.col("props")
    for kind, (before, after) in _WRAPPED.items():
        inner = F.expr("substr(props, 2, length(props) - 2)") if kind == "signup" else F.col("props")
        wrapped = F.concat(F.lit(before), inner, F.lit(after))
        reply = F.when(F.col("event_type") == kind, wrapped).otherwise(reply)
    fixed = repaired_json(reply)
    df = table(spark, sf, "events").select("event_type", fixed.alias("fixed"))
    single = F.from_json("fixed", "k bigint")["k"]
    many = F.aggregate(
        F.from_json("fixed", "array<struct<k: bigint>>"), F.lit(0).cast("bigint"), lambda a, e: a + e["k"]
    )
    k = F.when(F.startswith("fixed", F.lit("[")), many).otherwise(single)
    df = df.select("event_type", k.alias("k"))
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count("k").alias("n_ok"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("sum_k"),
        rnd(1 - F.count("k") / F.count("*")).alias("reject_rate"),
    )


@query(
    "src6_run_parameters",
    """
    WITH n AS (SELECT p_partkey,
      CASE WHEN p_size > 45 THEN 'broken_' || p_name
      ELSE replace(p_name, ' ', '') || '_' || lower(p_type) || 'rewrite_' ||
           (CASE WHEN p_retailprice > 1000 THEN 'nonlinear' ELSE 'linear' END) ||
           '_T' || CAST(p_size / 10 AS VARCHAR) || '_s' || replace(p_brand, 'Brand#', '') END AS run FROM part)
    SELECT p_partkey, nullif(regexp_extract(run, '^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$', 1), '') AS topic,
      nullif(regexp_extract(run, '^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$', 2), '') AS genre,
      nullif(regexp_extract(run, '^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$', 3), '') AS structure,
      round(TRY_CAST(nullif(regexp_extract(run, '^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$', 4), '') AS DOUBLE), 3) AS temperature,
      TRY_CAST(nullif(regexp_extract(run, '^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$', 5), '') AS INTEGER) AS seed
    FROM n
    """,
)
def src6(spark, sf):
    structure = F.when(F.col("p_retailprice") > 1000, "nonlinear").otherwise("linear")
    name = F.when(F.col("p_size") > 45, F.concat(F.lit("broken_"), "p_name")).otherwise(
        F.concat(
            F.replace("p_name", F.lit(" "), F.lit("")), F.lit("_"), F.lower("p_type"), F.lit("rewrite_"), structure,
            F.lit("_T"), (F.col("p_size") / 10).cast("string"), F.lit("_s"), F.replace("p_brand", F.lit("Brand#"), F.lit("")),
        )
    )
    named = table(spark, sf, "part").select("p_partkey", name.alias("run"))
    parsed = run_parameters(F.col("run"))
    return named.select("p_partkey", *[c.alias(n) for n, c in parsed.items()])


@query(
    "src7_tagged_union",
    """
    SELECT 'experiment' AS origin, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'baseline', s_name, s_nationkey, s_acctbal, NULL FROM supplier
    """,
)
def src7(spark, sf):
    experiment = table(spark, sf, "customer").selectExpr(
        "c_name as name", "c_nationkey as nation", "c_acctbal as balance", "c_mktsegment as segment"
    )
    baseline = table(spark, sf, "supplier").selectExpr("s_name as name", "s_nationkey as nation", "s_acctbal as balance")
    return tagged_union({"experiment": experiment, "baseline": baseline}, "origin")


@query(
    "src8_csv_lines",
    """
    SELECT conv_id, turn, concat_ws(',', '"' || conv_id || '"', '"' || replace('say "' || role || '", ', '"', '""') || '"', '"' || replace(text, '"', '""') || '"', '""') AS line
    FROM conversations
    """,
)
def src8(spark, sf):
    # Fields with commas, quotes, line breaks and NULL.
    said = F.concat(F.lit('say "'), "role", F.lit('", '))
    df = table(spark, sf, "conversations").withColumns({"said": said, "nothing": F.lit(None).cast("string")})
    return df.select("conv_id", "turn", csv_line(["conv_id", "said", "text", "nothing"]).alias("line"))


@query(
    "src9_markdown_report",
    """
    SELECT 0 AS part, '| event_type | n | mean |' AS line UNION ALL SELECT 1, '|---|---|---|'
    UNION ALL SELECT 2, '| ' || event_type || ' | ' || count(*) || ' | ' || CAST(round(avg(value), 3) AS VARCHAR) || ' |'
    FROM events GROUP BY event_type
    """,
)
def src9(spark, sf):
    report = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), rnd(F.avg("value"), 3).alias("mean")
    )
    return markdown_rows(report, ["event_type", "n", "mean"])


@query(
    "src10_ratings_long",
    """
    WITH u AS (UNPIVOT (SELECT l_suppkey AS rater, l_returnflag AS preference, l_quantity AS quantity,
        l_extendedprice AS price, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS discount, l_tax AS tax FROM lineitem)
      ON quantity, price, discount, tax INTO NAME dimension VALUE score)
    SELECT rater, dimension, count(*) AS n, round(sum(score), 2) AS total,
      count(*) FILTER (WHERE preference = 'R') AS n_preferred FROM u GROUP BY ALL
    """,
)
def src10(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("rater"),
        (F.col("l_returnflag") == "R").alias("preferred"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    rows = long_form(wide, ["rater", "preferred"], ["quantity", "price", "discount", "tax"], "dimension", "score")
    return rows.groupBy("rater", "dimension").agg(
        F.count("*").alias("n"), rnd(F.sum("score"), 2).alias("total"), F.count_if("preferred").alias("n_preferred")
    )


@query(
    "src11_keep_first",
    """
    SELECT doc_id, lang, source, n_chars FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
    """,
)
def src11(spark, sf):
    # The digest and the length stand for the text, so the shuffle stays narrow.
    df = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return keep_first(df, ["digest"], ["doc_id"]).drop("digest")


@query(
    "src12_standard_layout",
    """
    SELECT 'document' AS origin, CAST(doc_id AS VARCHAR) AS unit_id, length(text) AS n_content, md5(text) AS content_md5 FROM documents
    UNION ALL SELECT 'page', url, length(html), md5(html) FROM pages
    UNION ALL SELECT 'turn', conv_id || ':' || turn, length(text), md5(text) FROM conversations
    """,
)
def src12(spark, sf):
    stacked = tagged_union(
        {
            "document": table(spark, sf, "documents").selectExpr("doc_id as chapter_id", "text as plot"),
            "page": table(spark, sf, "pages").selectExpr("url as title", "html as content"),
            "turn": table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text"),
        },
        "origin",
    )
    default_id = F.concat_ws(":", "conv_id", "turn")
    flat = standard_layout(stacked, ["plot", "content", "text"], ["chapter_id", "title"], default_id)
    return flat.select("origin", "unit_id", F.length("content").cast("bigint").alias("n_content"), F.md5("content").alias("content_md5"))


@query(
    "src13_line_dedup",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    f AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL)
    SELECT doc_id, count(*) AS n_kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS kept_md5 FROM f GROUP BY doc_id
    """,
)
def src13(spark, sf):
    # Lines of one document sit in one row, so no shuffle is needed.
    kept = F.array_distinct(F.split("text", "\n"))
    df = table(spark, sf, "documents").select("doc_id", kept.alias("kept"))
    return df.select("doc_id", F.size("kept").cast("bigint").alias("n_kept"), F.md5(F.array_join("kept", "\n")).alias("kept_md5"))

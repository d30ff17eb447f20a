"""Streaming jobs drained over the event files, and the plug-in scorer."""

from pyspark.sql import functions as F

from corpusgauge import fixed
from corpusgauge.functions import text as tx
from corpusgauge.functions.common import rnd, sql_values
from corpusgauge.functions.plugin import lexicon_scorer, score_batches
from corpusgauge.operators import audit
from corpusgauge.operators import sequences as seq
from corpusgauge.queries.sequences import _DECIDE_SQL
from corpusgauge.registry import query
from corpusgauge.sources.tables import busy_table, table
from corpusgauge.streaming import jobs


@query(
    "stm1_cost_ledger",
    """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(sum(value), 2) AS cost FROM events GROUP BY ALL
    """,
)
def stm1(spark, sf):
    job = jobs.cost_ledger(jobs.file_stream(spark, sf, "events"), "1 day", "10 minutes")
    out = jobs.drain(job, "update", ["start", "end", "event_type"])
    return out.select("start", "event_type", "calls", "tokens", rnd("cost", 2).alias("cost"))


@query(
    "stm2_peak_tumbling",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, max(value) AS peak, count(*) AS samples FROM events GROUP BY 1",
)
def stm2(spark, sf):
    job = jobs.peak_values(jobs.file_stream(spark, sf, "events"), "1 hour", "1 hour", "10 minutes")
    return jobs.drain(job, "update", ["start", "end"]).drop("end")


@query(
    "stm2_peak_sliding",
    f"""WITH w AS (SELECT value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS start FROM events, (VALUES (0), (1)) AS x(i))
    SELECT start, max(value) AS peak, count(*) AS samples FROM w GROUP BY 1""",
)
def stm2_sliding(spark, sf):
    job = jobs.peak_values(jobs.file_stream(spark, sf, "events"), "1 hour", "30 minutes", "10 minutes")
    return jobs.drain(job, "update", ["start", "end"]).drop("end")


@query(
    "stm3_counters",
    f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'error') AS errors,
      round(count(*) FILTER (WHERE event_type = 'view') / count(*), 9) AS hit_rate FROM events GROUP BY 1""",
)
def stm3(spark, sf):
    out = jobs.drain(jobs.counters(jobs.file_stream(spark, sf, "events"), "6 hours", "10 minutes"), "update", ["start", "end"])
    return out.drop("end").withColumn("hit_rate", rnd("hit_rate", 9))


@query(
    "stm4_sessions",
    f"""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY user_id, sid""",
)
def stm4(spark, sf):
    return jobs.drain(jobs.sessions(jobs.file_stream(spark, sf, "events"), "4 hours", "10 minutes"), "complete")


@query(
    "stm5_monitor",
    """
    WITH l AS (SELECT user_id, arg_max({'s': event_type, 'v': value, 't': ts}, {'t': ts, 'i': event_id}) AS r, min(ts) AS since, max(value) AS peak FROM events GROUP BY 1)
    SELECT user_id, r.s AS stage, r.v AS value, CAST(floor(date_diff('microsecond', since, r.t) / 1000000) AS BIGINT) AS elapsed, peak FROM l
    """,
)
def stm5(spark, sf):
    return jobs.drain(jobs.monitor(jobs.file_stream(spark, sf, "events")), "complete")


@query("stm6_drop_repeats", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stm6(spark, sf):
    # Every record arrives twice.
    once, again = jobs.file_stream(spark, sf, "events"), jobs.file_stream(spark, sf, "events")
    out = jobs.drain(jobs.drop_repeats(once.unionByName(again), "1 hour"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


@query(
    "stm7_carried_decisions",
    f"""WITH RECURSIVE {_DECIDE_SQL}, a AS (SELECT *, CASE WHEN presence = 'DENIED' THEN 0 WHEN intensity = 'HIGH' THEN 1 WHEN votes >= 2 AND presence <> 'UNCERTAIN' THEN 1
            WHEN info = 'HIGH' AND intensity = 'LOW' AND pacing = 'ENCOURAGE' AND presence <> 'UNCERTAIN' THEN 1 ELSE 0 END AS fresh FROM f),
    s AS (SELECT conv_id, turn, pos, fresh AS decision FROM a WHERE pos = 1 UNION ALL SELECT a.conv_id, a.turn, a.pos, CASE WHEN s.decision = 1 AND presence <> 'DENIED' AND intensity <> 'HIGH' AND pacing <> 'ENCOURAGE' THEN 0 ELSE fresh END
          FROM s JOIN a ON a.conv_id = s.conv_id AND a.pos = s.pos + 1)
    SELECT conv_id, turn, decision FROM s""",
)
def stm7(spark, sf):
    turns = jobs.file_stream(spark, sf, "conversations")
    size = F.length("text")
    presence = F.when(F.col("role") == "system", "DENIED").when(size < 150, "UNCERTAIN").otherwise("AFFIRMED")
    intensity = F.when(size > 700, "HIGH").when(size > 250, "MED").otherwise("LOW")
    info = F.when(F.contains("text", F.lit("\n")), "HIGH").otherwise("LOW")
    pacing = F.when(F.contains("text", F.lit("the ")), "ENCOURAGE").otherwise("NEUTRAL")
    labels = turns.select("conv_id", "turn", presence.alias("presence"), intensity.alias("intensity"), info.alias("info"), pacing.alias("pacing"))
    rules = seq.cooldown_answers(*[F.col(c) for c in ("presence", "intensity", "info", "pacing")])
    rows = labels.select("conv_id", "turn", rules["if_off"].alias("if_off"), rules["if_on"].alias("if_on"))
    return jobs.drain(jobs.carried_decisions(rows, "conv_id", "turn", "if_off", "if_on"), "update", ["conv_id", "turn"])


@query(
    "stm8_latest_by_key",
    "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) AS writes FROM events GROUP BY 1",
)
def stm8(spark, sf):
    return jobs.drain(jobs.latest_by_key(jobs.file_stream(spark, sf, "events")), "update", ["user_id"])


@query(
    "stm8_snapshot_diff",
    """
    WITH a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE ts < '2024-01-15' GROUP BY 1), b AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1)
    SELECT user_id, a.v AS old_value, b.v AS new_value FROM b LEFT JOIN a USING (user_id) WHERE a.v IS DISTINCT FROM b.v
    """,
)
def stm8_diff(spark, sf):
    """Two as-of views of the audit table, only keys whose value changed."""
    events = table(spark, sf, "events")
    old = jobs.latest_by_key(events, F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", F.col("value").alias("old_value"))
    new = jobs.latest_by_key(events).select("user_id", F.col("value").alias("new_value"))
    both = new.join(old, "user_id", "left")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("user_id", "old_value", "new_value")


def _audit_log(events):
    """Events as an audit log: views and clicks set, purchases append, signups take snapshots, errors roll back."""
    k = F.from_json("props", "k bigint")["k"]
    op = F.when(F.col("event_type").isin("view", "click"), "set").when(F.col("event_type") == "purchase", "append")
    op = op.when((F.col("event_type") == "signup"), "snapshot").otherwise("rollback")
    key, tag = F.concat(F.lit("k"), (k % 7).cast("string")), F.concat(F.lit("t"), (k % 3).cast("string"))
    item = F.round(F.col("value") * 100).cast("long")
    return events.select("ts", F.col("user_id").alias("memory"), F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), item.alias("item"), tag.alias("tag"))


_AUDIT_SQL = """l AS (SELECT user_id AS memory, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'set' WHEN event_type = 'purchase' THEN 'append' WHEN event_type = 'signup' THEN 'snapshot' ELSE 'rollback' END AS op,
      'k' || (CAST(json_extract(props, '$.k') AS BIGINT) % 7) AS key, CAST(round(value * 100) AS BIGINT) AS item, 't' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) AS tag FROM events),
    back AS (SELECT b.memory, b.seq, max(s.seq) AS target FROM l b JOIN l s ON s.memory = b.memory AND s.tag = b.tag AND s.op = 'snapshot' AND s.seq < b.seq WHERE b.op = 'rollback' GROUP BY ALL),
    p AS (SELECT memory, tag, max(seq) AS hi FROM l WHERE op = 'snapshot' GROUP BY ALL UNION ALL SELECT DISTINCT memory, '(now)', 9223372036854775807 FROM l),
    c AS (SELECT memory, tag, hi, (SELECT max(seq) FROM back WHERE back.memory = p.memory AND back.seq < hi) AS lo FROM p
      UNION ALL SELECT c.memory, c.tag, b.target, (SELECT max(seq) FROM back x WHERE x.memory = c.memory AND x.seq < b.target) FROM c JOIN back b ON b.memory = c.memory AND b.seq = c.lo),
    v AS (SELECT c.memory, c.tag, l.key, l.seq, l.op, l.item, max(CASE WHEN op = 'set' THEN seq END) OVER (PARTITION BY c.memory, c.tag, l.key) AS base_seq
      FROM c JOIN l ON l.memory = c.memory AND l.op IN ('set', 'append') AND l.seq < c.hi AND l.seq > coalesce(c.lo, -1)),
    st AS (SELECT memory, tag, key, base_seq, count(*) AS n_items, CAST(sum(item) AS BIGINT) AS total, max(seq) AS last_seq, arg_max(item, seq) AS last_item FROM v WHERE base_seq IS NULL OR seq >= base_seq GROUP BY ALL)"""


@query("stm8_tagged_states", f"WITH RECURSIVE {_AUDIT_SQL} SELECT * FROM st")
def stm8_tags(spark, sf):
    """Every key's list under every tag and now, kept by the stream."""
    job = jobs.tagged_states(_audit_log(jobs.file_stream(spark, sf, "events")), "1 day")
    parts = jobs.drain(job, "update", ["memory", "part", "tag"])
    return parts.select("memory", "tag", F.inline("entries"))


@query("stm8_states_replay", f"WITH RECURSIVE {_AUDIT_SQL} SELECT * FROM st")
def stm8_replay(spark, sf):
    """The same from the whole log at once, by the intervals that rollbacks leave."""
    return audit.states(_audit_log(table(spark, sf, "events")))


@query(
    "stm8_tag_differences",
    f"""WITH RECURSIVE {_AUDIT_SQL}, a AS (SELECT * FROM st WHERE tag = 't0'), b AS (SELECT * FROM st WHERE tag = '(now)')
    SELECT coalesce(a.memory, b.memory) AS memory, coalesce(a.key, b.key) AS key, a.total AS old_total, a.n_items AS old_items, b.total AS new_total, b.n_items AS new_items
    FROM a FULL JOIN b ON a.memory = b.memory AND a.key = b.key WHERE a.last_seq IS DISTINCT FROM b.last_seq OR a.base_seq IS DISTINCT FROM b.base_seq OR a.n_items IS DISTINCT FROM b.n_items""",
)
def stm8_tag_diff(spark, sf):
    return audit.differences(audit.states(_audit_log(table(spark, sf, "events"))), "t0", audit.NOW)


@query(
    "udf5_plugin_scorer",
    f"""
    WITH l AS (SELECT * FROM {sql_values(fixed.LEXICON, 'word, h')}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents), s AS (SELECT doc_id, avg(h) AS m FROM t JOIN l USING (word) GROUP BY 1)
    SELECT documents.doc_id, round(m, 9) AS score FROM documents LEFT JOIN s ON documents.doc_id = s.doc_id
    """,
)
def udf5(spark, sf):
    docs = busy_table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("words"))
    scored = score_batches(docs, "words", lexicon_scorer(fixed.LEXICON), ["doc_id"])
    return scored.select("doc_id", F.when(~F.isnan("score"), rnd("score", 9)).alias("score"))

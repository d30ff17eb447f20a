"""Contradictions between dialogue and what is planned, settled and remembered.

Facts are phrases; a turn holds one if its lower-cased text contains it.  Per
dialogue four things are told apart: a future event that is spoken of without leave,
one that is allowed there, a settled fact that a turn denies, and a phrase that a
role of this dialogue must not know, whoever says it.

Cases: a phrase counts once a dialogue however often it is said; it must lie within
one turn; an empty phrase is in no turn; NULL texts hold nothing; rows with a NULL
key are ignored; a dialogue without any finding has zeros and empty lists; repeated
leaves and rules count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words before a phrase that deny it.
DENIALS = ("not ", "no ", "never ", "不是")


def dialogue_signals(
    turns: DataFrame,
    future: Sequence[str],
    settled: Sequence[str],
    unknown: Sequence[tuple[str, str]],
    leaves: DataFrame,
    key: str = "conv_id",
    denials: Sequence[str] = DENIALS,
) -> DataFrame:
    """Per dialogue: key, spoilers, allowed, contradicted, breaches (sorted lists), and ``n_`` counts of them.

    ``unknown`` are (role, phrase) rules, ``leaves`` the rows (key, phrase) of allowed
    future events.  The rule lists are a plan's own and small; texts are gone through
    in place and only findings move.
    """
    said = F.lower("text")
    rules = [("future", p, [p]) for p in future] + [("denied", p, [d + p for d in denials]) for p in settled]
    rules += [("unknown", p, [p]) for p in sorted({p for _, p in unknown})]
    found = []
    for kind, phrase, forms in rules:
        if phrase:
            held = F.lit(False)
            for form in forms:
                held = held | F.contains(said, F.lit(form.lower()))
            found.append(F.when(held, F.struct(F.lit(kind).alias("kind"), F.lit(phrase).alias("phrase"))))
    keyed = turns.where(F.col(key).isNotNull())
    nothing = F.lit([]).cast("array<struct<kind:string,phrase:string>>")
    hits = keyed.select(key, F.explode(F.array_compact(F.array(*found)) if found else nothing).alias("hit")).select(key, "hit.*").distinct()
    allowed = leaves.select(F.col(key), F.col("phrase"), F.lit("future").alias("kind")).distinct().withColumn("leave", F.lit(True))
    events = hits.where("kind <> 'unknown'").join(allowed, [key, "kind", "phrase"], "left")
    about = F.when(F.col("kind") == "denied", "contradicted").when(F.col("leave"), "allowed").otherwise("spoilers")
    told = events.select(key, about.alias("about"), "phrase")
    barred = turns.sparkSession.createDataFrame(list(dict.fromkeys(unknown)), "role string, phrase string")
    present = keyed.select(key, "role").distinct().join(F.broadcast(barred), "role")
    breaches = hits.where("kind = 'unknown'").join(present, [key, "phrase"])
    told = told.unionByName(breaches.select(key, F.lit("breaches").alias("about"), F.concat_ws(": ", "role", "phrase").alias("phrase")))
    names = ("spoilers", "allowed", "contradicted", "breaches")
    # At most one entry a rule, so the lists are as short as the rule table.
    lists = [F.array_sort(F.collect_set(F.when(F.col("about") == n, F.col("phrase")))).alias(n) for n in names]
    whole = keyed.select(key, F.lit(None).cast("string").alias("about"), F.lit(None).cast("string").alias("phrase")).distinct()
    out = told.unionByName(whole).groupBy(key).agg(*lists)
    return out.select(key, *names, *[F.size(n).alias(f"n_{n}") for n in names])

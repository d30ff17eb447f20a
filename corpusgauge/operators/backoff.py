"""Trigram model with discounted counts and backoff, learned and applied by joins.

Texts begin with two empty words, so every word has a context of two.  Counts of single
words and pairs are margins of the trigram counts: texts are tokenised once.  A context's
seen words give up ``discount`` each; that mass is shared among its unseen words in
proportion to the next lower order.  Single words are smoothed by one, with one more
place for all words the reference lacks, so the words of every context add up to 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import text as tx
from corpusgauge.functions.common import flat_structs
from corpusgauge.operators.ngrams import RUNS, _runs, hashed_words, word_shares
from corpusgauge.session import forget, shuffles_deleted, written

DISCOUNT = 0.75
#: Shares of the trigrams, by the middle word.
SLICES = 8


def padded_trigrams(docs: DataFrame, keep: Sequence[str], toks: str) -> DataFrame:
    """(keep..., item, c): each document counts its own trigrams in its row; ``item`` holds three words parted by blanks."""
    start = F.array(F.lit(""), F.lit(""))
    return flat_structs(docs, keep, tx.counted(tx.ngrams(F.concat(start, F.col(toks)), 3)), "item")


def _backed_off(rows: DataFrame, keys: Sequence[str], count: str, lower: str, discount: float, out: str) -> DataFrame:
    """Adds ``out``, the discounted probability in its context (``keys``) or the context's share of ``lower``."""
    seen = F.col(count) > 0
    contexts = rows.groupBy(*keys).agg(F.sum(count).alias("__n"), F.count_if(seen).alias("__t"), F.sum(F.when(seen, F.col(lower)).otherwise(0.0)).alias("__s"))
    spare = F.lit(discount) * F.col("__t") / F.col("__n") / (1 - F.col("__s"))
    value = F.when(F.col("__n") == 0, F.col(lower)).when(seen, (F.col(count) - discount) / F.col("__n")).otherwise(spare * F.col(lower))
    return rows.join(contexts, list(keys)).withColumn(out, value).drop("__n", "__t", "__s")


def trigram_model(counts: DataFrame, group: Sequence[str], in_reference: str, discount: float = DISCOUNT) -> DataFrame:
    """(group..., item, a, b, w, p): probability of every trigram of the counts under the reference's counts."""
    word = lambda n: F.split_part("item", F.lit(" "), F.lit(n))
    trained = F.sum(F.when(F.col(in_reference), F.col("c")).otherwise(0)).alias("k3")
    grams = written(counts.groupBy(*group, "item").agg(trained).withColumns({"a": word(1), "b": word(2), "w": word(3)}), "grams")
    single = grams.groupBy(*group, "w").agg(F.sum("k3").alias("k1"))
    totals = single.groupBy(*group).agg(F.sum("k1").alias("total"), F.count_if(F.col("k1") > 0).alias("vocabulary"))
    share: Column = (F.col("k1") + 1) / (F.col("total") + F.col("vocabulary") + 1)
    single = single.join(totals, list(group)).select(*group, "w", share.alias("p1"))
    pairs = grams.groupBy(*group, "b", "w").agg(F.sum("k3").alias("k2")).join(single, [*group, "w"])
    pairs = _backed_off(written(pairs, "pairs"), [*group, "b"], "k2", "p1", discount, "p2")
    known = grams.join(pairs.select(*group, "b", "w", "p2"), [*group, "b", "w"])
    return _backed_off(written(known, "trigrams"), [*group, "a", "b"], "k3", "p2", discount, "p").select(*group, "item", "a", "b", "w", "p")


def trigram_perplexity(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str, in_reference: str, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, n, ppl_trigram over all words of every document that has some.

    The model of ``trigram_model``, with hashes for words.  Only the shares of single
    words need more than the trigrams with one middle word, so shares of these are worked
    off one after the other, and what a step no longer needs leaves the disks.
    """
    rows = hashed_words(docs, doc_id, group, toks, in_reference)
    words = word_shares(rows).select(F.col("v").alias("last"), F.col("p").alias("p1"))
    found = []
    for share in range(SLICES):
        runs = rows.mapInArrow(_runs(3, share, SLICES, pad=2), RUNS)
        with shuffles_deleted(docs.sparkSession):
            grams = written(runs.groupBy("h", "g", "head", "tail", "middle", "last").agg(F.sum("r").alias("k3")), "grams")
        with shuffles_deleted(docs.sparkSession):
            pairs = grams.groupBy("tail", "middle", "last").agg(F.sum("k3").alias("k2")).join(words, "last")
            pairs = written(pairs.select("tail", "middle", "k2", "p1"), "pairs")
        with shuffles_deleted(docs.sparkSession):
            lower = _backed_off(pairs, ["middle"], "k2", "p1", discount, "p2").select("tail", "p2")
            known = grams.select("h", "g", "head", "tail", "k3").join(lower, "tail").select("h", "g", "head", "k3", "p2")
            known = written(known, "trigrams")
        forget(grams, pairs)
        with shuffles_deleted(docs.sparkSession):
            model = written(_backed_off(known, ["head"], "k3", "p2", discount, "p").select("h", "g", F.log("p").alias("lp")), "model")
        forget(known)
        with shuffles_deleted(docs.sparkSession):
            scored = runs.select("h", "g", "c", "doc").join(model, ["h", "g"])
            found.append(written(scored.groupBy("doc").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("lp")).alias("s")), "share"))
        forget(model)
    sums = reduce(DataFrame.unionAll, found).groupBy(F.col("doc").alias(doc_id)).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.select(doc_id, "n", F.exp(-F.col("s") / F.col("n")).alias("ppl_trigram"))

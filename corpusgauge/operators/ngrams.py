"""n-gram measures over document groups: self-BLEU, overlap, perplexity, copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions import text as tx
from corpusgauge.functions.common import attach, flat, flat_structs, ratio
from corpusgauge.plans.ordered import ordered
from corpusgauge.session import forget, shuffles_deleted, written

ORDERS = (1, 2, 3, 4)
#: Shares for each order of the grams, which are worked off one after the other, and words whose grams are worked out at once.
ORDER_SLICES, PASS_WORDS = 2, 200_000
#: Shares of the words and of the pairs of sets in ``first_copies``.
COPY_SLICES = 4
#: Shares of pairs of words for ``perplexity``; the hash of the empty word.
PAIR_SLICES, EMPTY_WORD = 4, np.uint64(0x51ED270B0A1F39C1)


def gram_counts(docs: DataFrame, keep: Sequence[str], toks: str, orders: Sequence[int] = ORDERS) -> DataFrame:
    """(keep..., order, item, c) rows; each document counts its own grams in its row."""
    per_order = [
        F.transform(tx.counted(tx.ngrams(F.col(toks), n)), _tag(n)) for n in orders
    ]
    return flat_structs(docs, keep, F.concat(*per_order), "item")


def _tag(order: int):
    return lambda x: F.struct(F.lit(order).alias("order"), x["item"].alias("item"), x["c"].alias("c"))


def _slices(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str, orders: Sequence[int], work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The documents with written tokens, and the rows of ``work`` over each share of their grams.

    Grams go to shares by their hash, so a share has all rows of its grams.  Shares are
    worked off one after the other and leave only their results on the disks.
    """
    keep = written(docs.select(doc_id, *group, F.col(toks).alias("__t")), "tokens")
    # A NULL leaves a hash as it is, so its place counts too.
    named = [c for name in group for c in (F.isnull(name), F.col(name))]
    rows = keep.select(F.col(doc_id).cast("long"), F.xxhash64(F.lit(0), *named), F.transform("__t", lambda w: F.xxhash64(w)))
    found, slices = [], ORDER_SLICES * len(orders)
    for share in range(slices):
        grams = rows.mapInArrow(_gram_rows(tuple(orders), share, slices), "h long, g int, c int, k int, doc long")
        with shuffles_deleted(docs.sparkSession):
            found.append(written(work(grams), "share"))
    return keep, reduce(DataFrame.unionAll, found)


def _passes(batch: pa.RecordBatch, pad: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]]:
    """Hashes of the words of about ``PASS_WORDS`` at a time, the row of each, and the batch's columns of hashes and flags by number."""
    lists = batch.column(2)
    # A NULL list has no words.
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sizes)

    def of(number: int) -> np.ndarray:
        values = batch.column(number).to_numpy(zero_copy_only=False)
        return values.view(np.uint64) if values.dtype == np.int64 else values.astype(np.int64)

    at = 0
    while at < len(ends):
        before = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, before + PASS_WORDS, "right")))
        part, held = words[before : int(ends[stop - 1])], np.arange(at, stop)
        if pad:
            starts = np.repeat(ends[at:stop] - sizes[at:stop] - before, pad)
            part = np.insert(part, starts, EMPTY_WORD)
        yield part, np.repeat(held, sizes[at:stop] + pad), of
        at = stop


def _gram_rows(orders: tuple[int, ...], share: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document and gram of the share: two hashes of gram, order and group, its count, its order and the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, owner, of in _passes(batch):
                yield _counted_grams(words, owner, of(1), batch.column(0), orders, share, slices)

    return run


def _counted_grams(words: np.ndarray, owner: np.ndarray, groups: np.ndarray, ids: pa.Array, orders: tuple[int, ...], share: int, slices: int) -> pa.RecordBatch:
    """The rows of ``_gram_rows`` for the words of some documents; ``owner`` is the place of each word's document."""
    parts, run = [], np.zeros(len(words), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(words) < n:
            break
        run = mixed(run[: len(words) - n + 1] + words[n - 1 :], n)
        if n not in orders:
            continue
        whose = owner[: len(run)]
        whole = np.flatnonzero(whose == owner[n - 1 :])
        h = mixed(run[whole] ^ groups[whose[whole]], 11)
        mine = np.flatnonzero((h >> np.uint64(40)) % np.uint64(slices) == share)
        h, whose = h[mine], whose[whole[mine]]
        order = np.lexsort((h, whose))
        h, whose, second = h[order], whose[order], mixed(run[whole[mine[order]]], 23).view(np.int64) >> 32
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])])) if len(h) else order
        counts = np.diff(np.concatenate([first, [len(h)]]))
        parts.append((h[first].view(np.int64), second[first].astype(np.int32), counts.astype(np.int32), np.full(len(first), n, np.int32), whose[first]))
    h, g, c, k, whose = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3, np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(c), pa.array(k), ids.take(pa.array(whose))], ["h", "g", "c", "k", "doc"])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_group(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Hash of a word in its group; the word may be the group's name, so both are not just combined."""
    return mixed(words + mixed(groups, 3), 7)


def self_bleu(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str) -> DataFrame:
    """BLEU-4 of each document against all others of its group, 0..1.

    A gram's clip limit is the largest count among the other documents.  It is
    below a document's own count only where that document alone holds the top
    count, so matches are totals minus (top - second) at those grams: one row
    per gram instead of one row per document pair.  Grams move as 96 bits of hash.
    """
    gram = Window.partitionBy("h", "g")

    def beyond(grams: DataFrame) -> DataFrame:
        by_count = grams.repartition("h").groupBy("h", "g", "k", "c").agg(F.count("*").alias("n_docs"), F.max("doc").alias("holder"))
        # A gram has as many rows here as it has different counts.
        down = gram.orderBy(F.desc("c"))
        top = by_count.withColumn("second", F.lead("c").over(down)).withColumn("place", F.row_number().over(down))
        alone = top.where("place = 1 and n_docs = 1")
        return alone.groupBy("holder").agg(
            *[F.sum(F.when(F.col("k") == n, F.col("c") - F.coalesce("second", F.lit(0))).otherwise(0)).alias(f"x{n}") for n in ORDERS]
        )

    keep, shares = _slices(docs, doc_id, group, toks, ORDERS, beyond)
    excess = shares.groupBy(F.col("holder").alias(doc_id)).agg(*[F.sum(f"x{n}").alias(f"x{n}") for n in ORDERS])
    sizes = keep.select(doc_id, *group, F.size("__t").alias("len"))
    near = ordered(sizes, group, "len", [doc_id], prev=["len"], nxt=["len"])
    back, ahead, size = F.col("prev.len"), F.col("nxt.len"), F.col("len")
    use_back = ahead.isNull() | (size - back <= ahead - size)
    rows = near.withColumn("ref_len", F.when(back.isNotNull() & use_back, back).otherwise(ahead)).join(excess, doc_id, "left")
    matched = {n: F.greatest(size - (n - 1), F.lit(0)) - F.coalesce(F.col(f"x{n}"), F.lit(0)) for n in ORDERS}
    rows = rows.withColumns({f"m{n}": c for n, c in matched.items()})
    return rows.select(doc_id, *group, "len", "ref_len", bleu({n: F.col(f"m{n}") for n in ORDERS}, size, F.col("ref_len")).alias("self_bleu"))


def bleu(matched: dict[int, Column], size: Column, ref_len: Column) -> Column:
    """Log-mean precision with halving for empty orders, effective order, brevity."""
    log_sum, used, zeros = F.lit(0.0), F.lit(0), F.lit(0)
    for n, m in matched.items():
        total = size - (n - 1)
        empty = (total > 0) & (m == 0)
        zeros = zeros + empty.cast("int")
        part = F.when(m > 0, F.log(m / total)).when(empty, -F.log(F.pow(F.lit(2.0), zeros) * total)).otherwise(0.0)
        log_sum = log_sum + F.when(total > 0, part).otherwise(0.0)
        used = used + (total > 0).cast("int")
    brevity = F.when(size < ref_len, F.exp(1 - ref_len / size)).otherwise(1.0)
    any_match = sum((m for m in matched.values()), F.lit(0)) > 0
    score = F.when(any_match, F.exp(log_sum / used) * brevity).otherwise(0.0)
    return F.when(ref_len.isNotNull(), score)


def overlap_bleu(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str) -> DataFrame:
    """Geometric mean of 1- and 2-gram set overlap, averaged over the other documents.

    A gram of one document meets (group frequency - 1) others.  Grams move as 96 bits of
    hash, a share at a time.
    """
    gram = Window.partitionBy("h", "g")

    def meetings(grams: DataFrame) -> DataFrame:
        shared = grams.repartition("h").select("doc", "k", (F.count(F.lit(1)).over(gram) - 1).alias("others")).where("others > 0")
        met = shared.groupBy("doc").agg(*[F.sum(F.when(F.col("k") == n, F.col("others")).otherwise(0)).alias(f"m{n}") for n in (1, 2)])
        return met.select("doc", F.array(*[F.struct(F.lit(n).alias("order"), F.col(f"m{n}").alias("met")) for n in (1, 2)]).alias("sums"))

    keep, shares = _slices(docs, doc_id, group, toks, (1, 2), meetings)
    sums = flat_structs(shares, [F.col("doc").alias(doc_id)], F.col("sums"), "order")
    met = sums.groupBy(doc_id).agg(*[F.sum(F.when(F.col("order") == n, F.col("met")).otherwise(0)).alias(f"m{n}") for n in (1, 2)])
    members = keep.groupBy(*group).agg((F.count("*") - 1).alias("refs"))
    sized = keep.select(doc_id, *group, F.size("__t").alias("len")).join(members, list(group)).join(met, doc_id, "left")
    p1 = ratio(F.col("m1"), F.col("len") * F.col("refs"))
    p2 = ratio(F.col("m2"), (F.col("len") - 1) * F.col("refs"))
    return sized.select(doc_id, *group, F.when((p1 > 0) & (p2 > 0), F.sqrt(p1 * p2)).otherwise(0.0).alias("overlap"))


def perplexity(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str, in_reference: str, mix: float = 0.7) -> DataFrame:
    """Perplexity of every document under word models of the reference rows.

    bigram: mix * c(ab)/c(a) + (1-mix) * (c(b)+1)/(N+V+1); unigram: the second
    part alone.  Every token after the first is scored once, whole texts.
    """
    rows = hashed_words(docs, doc_id, group, toks, in_reference)
    words = word_shares(rows)
    first = words.select(F.col("v").alias("head"), F.col("k").alias("k1"))
    second = words.select(F.col("v").alias("last"), F.col("p").alias("low"))
    whole = Window.partitionBy("h", "g")
    found = []
    for share in range(PAIR_SLICES):
        pairs = rows.mapInArrow(_runs(2, share, PAIR_SLICES), RUNS).select("doc", "c", "head", "last", "h", "g", "r")
        with shuffles_deleted(docs.sparkSession):
            counted = pairs.repartition("h").select("doc", "c", "head", "last", F.sum("r").over(whole).alias("k12"))
            joined = counted.join(second, "last").join(first, "head")
            high = F.when(F.col("k1") > 0, mix * F.col("k12") / F.col("k1") + (1 - mix) * F.col("low")).otherwise(F.col("low"))
            sums = joined.groupBy("doc").agg(
                F.sum("c").alias("n"), F.sum(F.col("c") * F.log(high)).alias("s2"), F.sum(F.col("c") * F.log("low")).alias("s1")
            )
            found.append(written(sums, "share"))
    scored = reduce(DataFrame.unionAll, found).groupBy(F.col("doc").alias(doc_id)).agg(*[F.sum(x).alias(x) for x in ("n", "s2", "s1")])
    return scored.select(doc_id, "n", F.exp(-F.col("s2") / F.col("n")).alias("ppl_bigram"), F.exp(-F.col("s1") / F.col("n")).alias("ppl_unigram"))


def hashed_words(docs: DataFrame, doc_id: str, group: Sequence[str], toks: str, in_reference: str) -> DataFrame:
    """Per document of a named group: its id, hashes of its group and its words, whether it belongs to the reference."""
    keep = written(docs.select(F.col(doc_id).cast("long").alias("doc"), *group, F.col(toks).alias("__t"), F.col(in_reference).alias("__r")), "tokens")
    for name in group:
        keep = keep.where(F.col(name).isNotNull())
    return keep.select("doc", F.xxhash64(*group), F.transform("__t", lambda w: F.xxhash64(w)), F.coalesce("__r", F.lit(False)))


def word_shares(rows: DataFrame) -> DataFrame:
    """(v, k, p): hash of group and word, its count in the reference, and its share there smoothed by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, owner, of in _passes(batch):
                group, trained = of(1)[owner], of(3)[owner]
                v, at, where = np.unique(in_group(words, group), return_index=True, return_inverse=True)
                kept = np.bincount(where, trained, len(v)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group[at].view(np.int64)), pa.array(v.view(np.int64)), pa.array(kept)], ["grp", "v", "r"])

    with shuffles_deleted(rows.sparkSession):
        counts = written(rows.mapInArrow(run, "grp long, v long, r long").groupBy("grp", "v").agg(F.sum("r").alias("k")), "words")
    totals = counts.groupBy("grp").agg(F.sum("k").alias("total"), F.count_if(F.col("k") > 0).alias("vocabulary"))
    share = (F.col("k") + 1) / (F.col("total") + F.col("vocabulary") + 1)
    with shuffles_deleted(rows.sparkSession):
        return written(counts.join(F.broadcast(totals), "grp").select("v", "k", share.alias("p")), "words")


#: Rows of ``_runs``: hashes of a run of words, of all but its last, all but its first, its last and the one before; its count, the count if trained, the document.
RUNS = "h long, g int, head long, tail long, last long, middle long, c int, r int, doc long"


def _runs(n: int, share: int, slices: int, pad: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document, its different runs of ``n`` words whose last but one belongs to the share; ``pad`` empty words stand before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, owner, of in _passes(batch, pad):
                v = in_group(words, of(1)[owner])
                chains = [v]
                for k in range(1, n):
                    chains.append(mixed(mixed(chains[-1][: len(v) - k], 1) + v[k:], 2))
                size = max(len(v) - n + 1, 0)
                middle = v[n - 2 : n - 2 + size]
                at = np.flatnonzero((owner[:size] == owner[n - 1 :]) & (mixed(middle, 5) % np.uint64(slices) == share))
                h, whose = chains[-1][at], owner[at]
                order = np.lexsort((h, whose))
                h, whose, at = h[order], whose[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])])) if len(h) else order
                c = np.diff(np.concatenate([first, [len(h)]])).astype(np.int32)
                at, whose = at[first], whose[first]
                hashes = [chains[-2][at], chains[-2][at + 1], v[at + n - 1], v[at + n - 2]]
                second = (mixed(h[first], 23) ^ mixed(v[at], 29) ^ mixed(v[at + n - 1], 31)).view(np.int64) >> 32
                columns = [pa.array(h[first].view(np.int64)), pa.array(second.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in hashes)]
                columns += [pa.array(c), pa.array((c * of(3)[whose]).astype(np.int32)), batch.column(0).take(pa.array(whose))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RUNS.split(", ")])

    return run


def sentence_continuity(docs: DataFrame, doc_id: str) -> DataFrame:
    """Mean, spread and extremes of the TF-IDF cosine of neighbouring sentences.

    A word meets itself in the sentence before through a window over its places
    in the document.
    """
    parts = flat(docs, [doc_id], tx.found(F.lower("text"), r"[^.!?\n]+"), "sentence", "raw")
    sents = parts.select(doc_id, "raw", tx.words(F.col("sentence")).alias("w"))
    first = F.transform(tx.counted(F.col("w")), lambda x, i: F.struct(x["item"].alias("item"), x["c"].alias("c"), (i == 0).cast("int").alias("first")))
    counted = flat_structs(sents, [doc_id, "raw"], first, "item")
    # Written, so that its size is known: rows need not be sorted by word to meet a small vocabulary.
    df = written(counted.groupBy("item").agg(F.count("*").alias("df"), F.sum("first").alias("firsts")), "df")
    # Every sentence that holds words has one first word.
    total = df.agg(F.sum("firsts").alias("n"))
    weighted = attach(counted.join(df, "item"), total, "t").select(doc_id, "raw", "item", (F.col("c") * F.log(1 + F.col("t.n") / F.col("df"))).alias("x"))
    # One shuffle brings a document's words together; all later steps stay there.
    local = weighted.repartition(F.col(doc_id))
    same_word = Window.partitionBy(doc_id, "item").orderBy("raw")
    met = F.when(F.lag("raw").over(same_word) == F.col("raw") - 1, F.col("x") * F.lag("x").over(same_word))
    per = local.withColumn("met", met).groupBy(doc_id, "raw").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.coalesce(F.sum("met"), F.lit(0.0)).alias("d"))
    by_place = Window.partitionBy(doc_id).orderBy("raw")
    before = per.withColumns({"raw0": F.lag("raw").over(by_place), "norm0": F.lag("norm").over(by_place)})
    sims = before.where(F.col("raw0") == F.col("raw") - 1).select(doc_id, (F.col("d") / (F.col("norm") * F.col("norm0"))).alias("s"))
    return sims.groupBy(doc_id).agg(
        F.count("*").alias("gaps"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.max("s").alias("high"), F.min("s").alias("low")
    )


def first_copies(docs: DataFrame, doc_id: str, toks: Column, floor: float = 0.6) -> DataFrame:
    """The first earlier document whose word-pair set has Jaccard >= ``floor``, per document: (doc_id, first_id, jaccard).

    Texts are tokenised once: distinct sets are written, with the smallest id that holds
    each.  Two sets at or above the floor share one of their rarest pairs of words
    (prefix filter, pairs as 64-bit hashes); pairs of words that one set alone holds take
    up places of the prefix but need no rows.  One table of prefixes meets itself, and
    the sets of the pairs found decide, as 64-bit hashes.  Words and pairs of sets are
    worked off in shares, whose shuffle files go before the next one starts.  A document's first match is the smallest one of
    its set, or else the smallest id of its own set.
    """
    spark = docs.sparkSession
    # Written before anything else reads it, or the filter would work the array out again.
    pairs = written(docs.select(doc_id, F.sort_array(F.array_distinct(tx.ngrams(toks, 2))).alias("s")), "pairs").where("size(s) > 0")
    sets = written(pairs.select(doc_id, F.sha2(F.array_join("s", " "), 256).alias("u")), "sets")
    hashed = F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))
    whole = pairs.select(doc_id, F.sha2(F.array_join("s", " "), 256).alias("u"), hashed.alias("h"))
    with shuffles_deleted(spark):
        units = written(whole.groupBy("u").agg(F.min(doc_id).alias("first"), F.min_by("h", doc_id).alias("h")), "units")
    forget(pairs)
    words = flat(units.select("first", "h"), ["first", F.size("h").alias("n")], F.col("h"), "w")
    ranked = []
    for share in range(COPY_SLICES):
        mine = words.where(F.pmod(F.shiftright("w", 40), F.lit(COPY_SLICES)) == share)
        with shuffles_deleted(spark):
            freq = mine.groupBy("w").agg(F.count("*").alias("f")).where("f > 1")
            ranked.append(written(mine.join(freq, "w"), "ranked"))
    shared = reduce(DataFrame.unionByName, ranked).groupBy("first", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("a"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(floor)) + 1 - (F.col("n") - F.size("a"))).cast("int")
    prefix = shared.where(keep > 0).select("first", "n", F.explode(F.slice("a", F.lit(1), keep)).alias("e")).select("first", "n", F.col("e.w").alias("w"))
    with shuffles_deleted(spark):
        prefix = written(prefix, "prefix")
    forget(*ranked)
    near = (F.col("a.n") >= F.col("b.n") * floor) & (F.col("b.n") >= F.col("a.n") * floor)
    met = prefix.alias("a").join(prefix.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.first") < F.col("b.first")) & near)
    with shuffles_deleted(spark):
        met = written(met.select(F.col("a.first").alias("x"), F.col("b.first").alias("y")).distinct(), "met")
    both = F.size(F.array_intersect("hx", "hy"))
    jaccard = (both / (F.size("hx") + F.size("hy") - both)).alias("j")
    checked = []
    # The sets of a share's pairs move, not those of all pairs at once.
    for share in range(COPY_SLICES):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(COPY_SLICES)) == share  # noqa: B023, E731
        left = units.where(mine("first")).select(F.col("first").alias("x"), F.col("h").alias("hx"))
        right = units.select(F.col("first").alias("y"), F.col("h").alias("hy"))
        with shuffles_deleted(spark):
            checked.append(written(met.where(mine("x")).join(left, "x").join(right, "y").select("x", "y", jaccard).where(F.col("j") >= floor), "checked"))
    verified = reduce(DataFrame.unionByName, checked)
    best = verified.where(F.col("j") >= floor).groupBy(F.col("y").alias("first")).agg(F.min_by(F.struct("x", "j"), "x").alias("m"))
    found = sets.select(doc_id, "u").join(units.select("u", "first"), "u").join(best, "first", "left")
    later = F.col(doc_id) != F.col("first")
    found = found.select(doc_id, F.coalesce("m.x", F.when(later, F.col("first"))).alias("first_id"), F.coalesce("m.j", F.when(later, F.lit(1.0))).alias("jaccard"))
    return found.where("first_id is not null")

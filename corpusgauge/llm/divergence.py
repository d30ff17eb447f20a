"""Source divergence audit with a translate-table tokenizer.

``bytes.translate`` lowers A-Z and blanks every other ASCII byte that is no letter in
one pass over a text, ``bytes.split`` gives its terms and a Counter per document their
frequencies.  A task adds documents up per (lang, source) in a bounded table and emits
sparse rows (lang, source, term, occurrences, documents); Spark sums them.

A language keeps the terms of at least ``MIN_DOCS`` of its documents.  A group is one
occurring (lang, source); its smoothed probability of a kept term, an integer in
billionths, is exact.  ``divergence`` gives two reports on the groups of a language: the
distance of every two groups over all kept terms, and the terms that a group uses more
than its language does.

Distances stay sparse: a term that a group lacks has the same probability ``floor_p``
for all such terms, so a pair costs ``V * |floor_p - floor_p|`` and a correction over
the terms that one of the groups holds.  Those are cut into blocks of about
``BLOCK_TERMS`` terms and the groups into chunks of about ``CHUNK_GROUPS``; a task sums
one block for two chunks in a matrix, and only (group, group) sums leave it.

Cases: NULL text, lang and source count as ''; a document without terms still makes its
group occur; a language without kept terms has distances 0 and no term rows; repeated
rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import stored

MIN_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block and groups of a chunk, on average: what one task compares.
BLOCK_TERMS, CHUNK_GROUPS = 1_024, 256
#: Rows that a task holds before it emits them; bytes of a text that are split at a time.
MOST_ROWS, STEP_BYTES = 400_000, 2**20


def _lowered(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    letter = 0x61 <= byte <= 0x7A or byte >= 0x80
    return byte if letter else 0x20


#: A-Z to a-z; a-z and the bytes of other than ASCII characters stay; the rest turns into a blank.
LETTERS = bytes(map(_lowered, range(256)))


def text_terms(text: str) -> Counter[bytes]:
    """Term frequencies of a whole text; a long one is split piece by piece."""
    data = text.encode().translate(LETTERS)
    if len(data) <= STEP_BYTES:
        return Counter(data.split())
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP_BYTES)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, n_docs): partial sums of the tasks; one cell may have several rows."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = 0, defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for where, written in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                own = text_terms(written.as_py())
                group = total[where]
                held -= len(group)
                for term, n in own.items():
                    group[term] += n
                seen[where].update(own.keys())
                held += len(group)
                if held > MOST_ROWS:
                    yield from cells(total, seen)
                    held = 0
        yield from cells(total, seen)

    def cells(total: dict[tuple[str, str], Counter], seen: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (a, b), group in total.items():
            terms = pa.array(list(group), pa.binary()).cast(pa.string())
            n_docs = seen[a, b]
            counts = [pa.array(list(group.values()), pa.int64()), pa.array([n_docs[t] for t in group], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(a, len(group)), pa.repeat(b, len(group)), terms, *counts], ["lang", "source", "term", "n", "n_docs"])
        total.clear()
        seen.clear()

    return named.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def kept_cells(partial: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): cells of the terms that enough documents of the language hold.

    ``lang_n`` counts the term in the whole language; ``lead`` is 1 in one row of each
    (lang, term).  All sums need one shuffle, on (lang, term): such a key has a row for
    each source at most.
    """
    cells = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    whole = Window.partitionBy("lang", "term")
    cells = cells.withColumn("lang_docs", F.sum("n_docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole))
    lead = (F.row_number().over(whole.orderBy("source")) == 1).cast("long")
    return cells.withColumn("lead", lead).where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "lead")


def smoothed(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)) of the named columns, exact; 0 where there are no terms."""
    up = f"cast({SCALE} as decimal(12,0)) * cast({n} + {SMOOTHING} as decimal(20,0))"
    down = f"cast({total} + {SMOOTHING} * {terms} as decimal(20,0))"
    return F.expr(f"case when {terms} > 0 then 1 + ({up}) div {down} else 0L end")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's text."""
    occurring = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    kept = stored(kept_cells(term_counts(docs, lang, source, text), min_docs), "cells")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("n").alias("lang_total"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("floor_p", smoothed("0L", "total", "terms")), "groups")
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", smoothed("n", "total", "terms"))
    return _ranked(_pairs(cells, groups), "pair", None).unionByName(_ranked(_own_terms(cells), "term", top))


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    """Per group and by value, the larger first; ties by the item's bytes."""
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", place)
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _own_terms(cells: DataFrame) -> DataFrame:
    q = smoothed("lang_n", "lang_total", "terms")
    return cells.where(F.col("p") > q).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value"))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two groups of a language, in both directions."""
    dealt = groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK_GROUPS).cast("int").alias("chunks"), F.ceil(F.max("terms") / BLOCK_TERMS).cast("int").alias("blocks"))
    dealt = stored(dealt.withColumn("blocks", F.greatest("blocks", F.lit(1))), "dealt")
    chunk = F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    # Every group stands in every block with the probability of the terms that it lacks.
    lacking = groups.join(dealt, "lang").select("lang", "source", "chunks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.col("floor_p").alias("p"))
    holding = cells.join(dealt, "lang").select("lang", "source", "chunks", block.alias("block"), "term", "p")
    rows = holding.unionByName(lacking).withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "source", "term", "p")
    sums = rows.groupBy("lang", "block", "i", "j").applyInArrow(block_distances, "lang string, a string, b string, apart long, gap long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.max("gap").alias("gap"))
    sums = sums.join(groups.groupBy("lang").agg(F.max("terms").alias("terms")), "lang")
    value = F.col("apart") + F.col("terms") * F.col("gap")
    sums = sums.select("lang", "a", "b", value.alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both, "value")


def block_distances(rows: pa.Table) -> pa.Table:
    """Per pair of groups: the sum over the block's terms of |p - q| less ``gap`` (|p - q| of a term that both lack)."""
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    source = np.array(rows["source"].to_pylist(), object)
    at, terms = pd.factorize(np.array(rows["term"].to_pylist(), object))  # -1: the group's row for terms that it lacks
    shares, own = rows["p"].to_numpy(), rows["own"].to_numpy()
    names = np.unique(source[at < 0])
    place = np.searchsorted(names, source)
    floors, chunk = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    floors[place[at < 0]], chunk[place[at < 0]] = shares[at < 0], own[at < 0]
    p = np.repeat(floors[:, None], len(terms), axis=1)
    p[place[at >= 0], at[at >= 0]] = shares[at >= 0]
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    a, b, apart, gaps = [], [], [], []
    for n, one in enumerate(left):
        others = right[n + 1 :] if i == j else right
        gap = np.abs(floors[others] - floors[one])
        a += [names[one]] * len(others)
        b += names[others].tolist()
        gaps.append(gap)
        apart.append(np.abs(p[others] - p[one]).sum(axis=1) - gap * len(terms))
    sums = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (apart, gaps)]
    lang = pa.array([rows["lang"][0].as_py()] * len(a), pa.string())
    return pa.table([lang, pa.array(a, pa.string()), pa.array(b, pa.string()), *sums], ["lang", "a", "b", "apart", "gap"])

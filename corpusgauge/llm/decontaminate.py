"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments in the shared folder: a row holds the documents of
one Arrow batch, their word counts, and for every test term the sorted places where
it stands.  A test window is looked up in a segment from its rarest term (by corpus
frequency, summed over all segments): each posting proposes a place, and the lists
of the other terms, rarest next, are intersected at their offsets.  All windows of
a segment go through these steps together.

Terms that no test item holds can be part of no phrase, so they get no postings.
The test items are taken in blocks whose vocabulary has a fixed bound, because it
goes to every task; a larger test set takes more blocks, with equal results.

Cases: NULL and empty texts have no words and no hits; items without words match
nothing; an item below the window length is one window; repeated rows, repeated ids
and NULL ids give one result row per input row; an item id that several test rows
hold is listed once, a NULL item id as NULL; an empty test table leaves every
document clean; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import passes, stored

#: Words of a window; places a term may be off in a near match.
WINDOW, SLACK = 10, 2
#: Test words whose vocabulary goes to every task at once.
BLOCK_WORDS = 200_000
#: Characters of the documents of one segment; a longer document is alone.
SEGMENT_CHARS = 4_000_000

# Lower-cases A-Z; every other ASCII character but digits and a-z parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SEGMENT = (
    "keys array<long>, word_counts array<int>, terms array<int>, sizes array<int>, places array<int>"
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The test items in blocks of bounded vocabulary, streamed in id order."""
    block, size = [], 0
    for row in items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(row.t)
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    if block:
        yield block


def index_segments(docs: DataFrame, key: str, text: str, terms: dict[bytes, int]) -> DataFrame:
    """Positional index of the documents, one row per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            texts = texts.to_pylist()
            for a, b in passes(texts, SEGMENT_CHARS):
                yield pa.RecordBatch.from_pandas(_segment(keys[a:b], texts[a:b], terms), schema=_ARROW, preserve_index=False)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, SEGMENT)


_ARROW = pa.schema(
    [("keys", pa.list_(pa.int64())), ("word_counts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))]
)


def _segment(keys: list, texts: list, terms: dict[bytes, int]) -> pd.DataFrame:
    counts, found, get = [], [], terms.get
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        # A place without a term after each document keeps phrases inside it.
        found.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
        found.append(np.array([-1], np.int32))
    flat = np.concatenate(found)
    at = np.flatnonzero(flat >= 0)
    order = np.argsort(flat[at], kind="stable")
    named, sizes = np.unique(flat[at], return_counts=True)
    row = {"keys": keys, "word_counts": counts, "terms": named.tolist(), "sizes": sizes.tolist(), "places": at[order].astype(np.int32)}
    return pd.DataFrame([row])


def _windows(block: list[tuple[int, list[bytes]]], terms: dict[bytes, int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item number, length and term numbers (-1 beyond the length) of every window."""
    item, length, rows = [], [], []
    for n, (_, words) in enumerate(block):
        ids = [terms[w] for w in words]
        width = min(window, len(ids))
        for i in range(len(ids) - width + 1):
            item.append(n)
            length.append(width)
            rows.append(ids[i : i + width] + [-1] * (window - width))
    return np.array(item), np.array(length), np.array(rows, np.int64)


def _find(segment: dict[str, np.ndarray], windows: tuple, frequency: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and places of all matches; with ``slack`` every term may be off by that much."""
    _, length, rows = windows
    terms, sizes, places = segment["terms"], segment["sizes"], segment["places"]
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum(sizes) - sizes
    # Offsets of each window from its rarest term on; those beyond its length last.
    weight = np.where(rows >= 0, frequency[rows], np.iinfo(np.int64).max)
    rare = np.argsort(weight, axis=1, kind="stable")
    first = rows[np.arange(len(rows)), rare[:, 0]]
    slot = np.minimum(np.searchsorted(terms, first), len(terms) - 1)
    live = np.flatnonzero(terms[slot] == first)
    per = sizes[slot[live]].astype(np.int64)
    window = np.repeat(live, per)
    within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    at = places[np.repeat(begins[slot[live]], per) + within].astype(np.int64) - rare[window, 0]
    # One sorted list of (term, place) holds all postings.
    span = int(np.sum(segment["word_counts"]) + len(segment["word_counts"])) + 4 * rows.shape[1] + 4 * slack + 4
    base = 2 * rows.shape[1] + 2 * slack
    listed = np.repeat(terms.astype(np.int64), sizes) * span + places + base
    for k in range(1, rows.shape[1]):
        offset = rare[window, k]
        term = rows[window, offset]
        wanted = term * span + at + offset + base
        hit = np.searchsorted(listed, wanted - slack)
        near = listed[np.minimum(hit, len(listed) - 1)]
        ok = (k >= length[window]) | ((hit < len(listed)) & (near <= wanted + slack))
        window, at = window[ok], at[ok]
    return window, at


def _answer(segment: dict[str, np.ndarray], windows: tuple, frequency: np.ndarray, slack: int) -> tuple:
    """Hit flag of every place, and the items with exact and near matches by document."""
    counts = segment["word_counts"].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    window, at = _find(segment, windows, frequency, 0)
    change = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows[1][window], -1)
    hit = np.cumsum(change)[:-1] > 0
    exact = np.unique(np.stack([np.searchsorted(bounds, at, "right") - 1, windows[0][window]], axis=1), axis=0)
    near_window, near_at = _find(segment, windows, frequency, slack)
    near_doc = np.searchsorted(bounds, np.clip(near_at, 0, bounds[-1] - 1), "right") - 1
    near = np.unique(np.stack([near_doc, windows[0][near_window]], axis=1), axis=0)
    return hit, bounds, exact, near


def matches(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Per document row: key, n_words, n_hit, items (exact), near_items, hit_spans.

    A span is [first, last] in word places, inclusive; ``near_items`` are the items
    with a window whose terms all lie within ``slack`` places of their own.
    """
    blocks = item_blocks(tests, item, item_text)
    head = [b for b in (next(blocks, None), next(blocks, None)) if b]
    if len(head) < 2:
        found = _block_matches(docs, key, text, head[0] if head else [(None, [b""])], window, slack)
        found = found.withColumnRenamed("key", key)
        found = found.withColumns({c: F.array_distinct(c) for c in ("items", "near_items")})
    else:
        # Several blocks meet again by a row number, which a written table keeps.
        rows = stored(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).withColumn("row", F.monotonically_increasing_id()), "rows")
        found = None
        for block in chain(head, blocks):
            part = _block_matches(rows, "row", "t", block, window, slack)
            found = part if found is None else found.union(part)
        lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit_spans", "items", "near_items")]
        found = found.groupBy("key").agg(F.first("n_words").alias("n_words"), *lists)
        found = rows.select("row", key).join(found, F.col("row") == found.key).drop("row", "key")
    # Spans of several blocks may overlap: every place counts once.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    covered = F.aggregate(
        F.array_sort("hit_spans"),
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], s["end"] + 1) + 1)).alias("n"),
            F.greatest(s["end"], x["last"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return found.select(key, "n_words", covered.alias("n_hit"), "items", "near_items", "hit_spans")


def _block_matches(docs: DataFrame, key: str, text: str, block: list, window: int, slack: int) -> DataFrame:
    terms = {w: n for n, w in enumerate(sorted({w for _, words in block for w in words}))}
    index = stored(index_segments(docs, key, text, terms), "index")
    sums = index.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("n"))
    frequency = np.zeros(len(terms), np.int64)
    for row in sums.toLocalIterator():  # one row per test term of the block
        frequency[row.terms] = row.n
    windows = _windows(block, terms, window)
    ids = [i for i, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = {n: np.array(row[n], np.int32) for n in ("word_counts", "terms", "sizes", "places")}
                hit, bounds, exact, near = _answer(segment, windows, frequency, slack)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                docs_of = np.searchsorted(bounds, first, "right") - 1
                n = len(row["keys"])
                spans: list[list] = [[] for _ in range(n)]
                for d, a, b in zip(docs_of.tolist(), first.tolist(), last.tolist()):
                    spans[d].append({"first": int(a - bounds[d]), "last": int(b - bounds[d])})
                listed: list[list[list[int]]] = [[[] for _ in range(n)], [[] for _ in range(n)]]
                for kind, found in enumerate((exact, near)):
                    for d, i in found.tolist():
                        listed[kind][d].append(ids[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(row["word_counts"], pa.int64()), pa.array(spans, _SPANS),
                     pa.array(listed[0], pa.list_(pa.int64())), pa.array(listed[1], pa.list_(pa.int64()))],
                    ["key", "n_words", "hit_spans", "items", "near_items"],
                )

    schema = "key long, n_words long, hit_spans array<struct<first:int,last:int>>, items array<long>, near_items array<long>"
    return index.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

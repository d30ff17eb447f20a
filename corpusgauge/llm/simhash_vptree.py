"""SimHash near-duplicates: exact Hamming links through a vantage-point tree.

Every document becomes a 64-bit fingerprint.  The distinct fingerprints are dealt
into the shards of a vantage-point tree: a node holds a vantage fingerprint and a
distance; what is nearer goes in, the rest goes out.  By the triangle inequality a
pair within ``radius`` can only straddle a node if its outer end lies within
``radius`` of the border, so those outer fingerprints also go into the inner shard.
Every pair within the radius therefore meets in a shard.  The tree comes from a
bounded sample (it only steers the work; links are exact for any tree), and shards
that stay large are compared chunk against chunk.  A shard gives a spanning forest
of its links, never all pairs; components are joined by ``components``.

``near_duplicates`` links whole-text fingerprints.  ``near_copies`` finds texts with a
stated Jaccard similarity of word shingles, which whole-text fingerprints of like
texts often miss by many bits: it fingerprints ``TABLES`` samples of each text (the
``SAMPLE`` shingles that come first in a pseudo-random order, so like texts mostly
share a sample), links the samples through the same tree, and verifies the exact
Jaccard inside every linked class: first of each member with two head texts, which
settles most classes, then of all pairs of the classes that are still in parts,
chunk against chunk.

Cases: NULL and empty texts have no words and the fingerprint zero, linked like any
other; texts under three words are one shingle; repeated rows and ties share a
fingerprint; NULL ids keep a fingerprint and count for no component's smallest id;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import bitmap_has, hash_sample, key_bitmap, mix, small_batches, stored
from corpusgauge.llm.components import components
from corpusgauge.llm.paragraph_dedup import _edges, jaccard_forest

#: Fingerprints that steer the tree, at most.
TREE_SAMPLE = 32_768
#: Fingerprints that a shard should hold, and that a chunk of a large shard may hold.
SHARD, CHUNK = 1_500, 3_000
SEED = 42
#: At Jaccard 0.8 a sample is shared with probability 0.64, one of six with 0.998.
TABLES, SAMPLE, SHINGLE, SIMILARITY = 6, 2, 5, 0.8
#: Texts and shingles that a chunk of a class in parts should hold.
CLASS_TEXTS, CLASS_SHINGLES = 500, 200_000


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 values of the 3-word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(3, len(words))
    shingles = map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(values, -(-len(values) // 100_000)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["key", "fp"])

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, "key long, fp long").select(F.col("key").alias(key), "fp")


def fingerprint_hex(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


class Tree:
    """Vantage-point tree over fingerprints; leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, leaf: float, radius: int):
        self.radius, self.leaves = radius, 0
        self.root = self._grow(sample, leaf, np.random.default_rng(SEED))

    def _grow(self, points: np.ndarray, leaf: float, rng: np.random.Generator) -> tuple:
        best = None
        if len(points) > max(leaf, 1):
            for vantage in points[rng.integers(0, len(points), 12)]:
                far = np.bitwise_count(points ^ vantage).astype(int)
                histogram = np.cumsum(np.bincount(far, minlength=65)) / len(points)
                for border in range(64):
                    inner, copied = histogram[border], histogram[min(64, border + self.radius)] - histogram[border]
                    if 0.2 <= inner <= 0.8:
                        # Share of pairs left to compare on both sides.
                        cost = (inner + copied) ** 2 + (1 - inner) ** 2
                        if cost < 0.85 and (best is None or cost < best[0]):
                            best = (cost, vantage, border, far)
        if best is None:
            self.leaves += 1
            return (self.leaves - 1,)
        _, vantage, border, far = best
        inner = self._grow(points[far <= border + self.radius], leaf, rng)
        return (vantage, border, inner, self._grow(points[far > border], leaf, rng))

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the shards that they go to."""
        rows, shards, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if len(node) == 1:
                rows.append(at)
                shards.append(np.full(len(at), node[0]))
                continue
            vantage, border, inner, outer = node
            far = np.bitwise_count(points[at] ^ vantage)
            todo.append((inner, at[far <= border + self.radius]))
            todo.append((outer, at[far > border]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(rows), np.concatenate(shards)


def forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``radius``; a visited point is never compared again."""
    edges, left = [], np.unique(points)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            point = queue.pop()
            hit = np.bitwise_count(left ^ point) <= radius
            if hit.any():
                found = left[hit]
                edges += [(int(point), int(f)) for f in found]
                queue.extend(found)
                left = left[~hit]
    return edges


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``radius``; ``distinct`` holds column ``fp`` without repeats."""
    total = distinct.count()
    rows = hash_sample(distinct.select("fp"), ["fp"], TREE_SAMPLE).collect()
    sample = np.sort(np.array([r.fp for r in rows], np.int64)).view(np.uint64)
    tree = Tree(sample, SHARD * len(sample) / max(total, 1), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            at, shards = tree.route(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(values[at])], ["shard", "fp"])

    dealt = stored(distinct.select("fp").mapInArrow(route, "shard int, fp long"), "shards")
    # One row per leaf, and the tree has at most as many leaves as its sample has rows.
    sizes = F.broadcast(dealt.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = dealt.join(sizes, "shard").select("shard", "fp", chunk.alias("own"), other.alias("other"))
    pairs = pairs.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        found = forest(part["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return pairs.groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(key, fp, component_id) per row; component_id is the smallest key that links reach."""
    marked = stored(fingerprints(df, key, text), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    roots = components(links(classes, radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(firsts, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's shingles of five words; a shorter text is one shingle, none has the empty one."""
    words = text.encode().lower().split() if text else []
    joined = b" ".join(words)
    width = max(1, min(SHINGLE, len(words)))
    ends = np.cumsum([len(w) + 1 for w in words] or [1]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def sample_fingerprints(hashes: np.ndarray) -> list[int]:
    """Per table, the fingerprint of the shingles that come first in the table's order."""
    out = []
    for table in range(TABLES):
        order = mix(hashes, 100 + table)
        first = order if len(order) <= SAMPLE else np.partition(order, SAMPLE - 1)[:SAMPLE]
        # Bits set in over half of the (re-mixed) shingles, as for whole texts.
        bits = np.unpackbits(np.sort(mix(first, 3)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        out.append(int(np.packbits(2 * bits > len(first), bitorder="little").view(np.int64)[0]))
    return out


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, least: float = SIMILARITY) -> DataFrame:
    """(key, mark, component_id) per row: the smallest key among the texts that verified links reach.

    ``mark`` is the hash of the text.  Equal texts are one class whatever their
    number; all pairs of the different texts of a linked class are covered.
    """
    source = small_batches(df).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("mark", F.xxhash64("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps = [], []
            for t in batch.column(1):
                own = shingle_hashes(t.as_py())
                sizes.append(len(own))
                fps.append(sample_fingerprints(own))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "n", "fps"])

    rows = stored(source.mapInArrow(sample, "key long, mark long, n long, fps array<long>"), "samples")
    texts = rows.groupBy("mark").agg(F.min("key").alias("first"), F.any_value("n").alias("n"), F.any_value("fps").alias("fps"))
    texts = stored(texts, "texts")
    samples = stored(texts.select("mark", "n", F.explode("fps").alias("fp")).distinct(), "samples")
    roots = components(links(stored(samples.select("fp").distinct(), "fps"), radius))
    classes = samples.join(roots, samples.fp == roots.node, "left").select("mark", "n", F.coalesce("root", "fp").alias("class"))
    classes = stored(classes, "classes")
    # Each class has two heads in an order of its own, so a text meets other heads in other tables.
    place = F.struct(F.xxhash64("mark", "class").alias("place"), "mark", "n")
    heads = classes.groupBy("class").agg(F.array(F.min(place), F.max(place)).alias("heads"), F.count("*").alias("m")).where("m > 1")
    pairs = classes.join(heads, "class").withColumn("head", F.explode("heads")).select(F.col("head.mark").alias("a"), F.col("mark").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"))
    # Sets whose sizes differ by more cannot be that similar.
    pairs = stored(pairs.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct(), "pairs")
    # Up to three texts, the heads leave no pair out.
    large = classes.join(heads.where("m > 3").select("class"), "class", "left_semi").select("mark")
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("mark")).union(large).distinct(), "ends")
    sent = df.sparkSession.sparkContext.broadcast(key_bitmap(ends, "mark"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(bitmap_has(bitmap, marks))
            for hit in np.array_split(wanted, len(wanted) // 256 + 1):
                hashes = [shingle_hashes(batch.column(1)[int(i)].as_py()).view(np.int64) for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(marks[hit]), pa.array(hashes, pa.list_(pa.int64()))], ["mark", "hashes"])

    found = source.select("mark", "text").mapInArrow(sets_of, "mark long, hashes array<long>").join(ends, "mark")
    sets = stored(found.groupBy("mark").agg(F.any_value("hashes").alias("hashes")), "sets")
    left = sets.select(F.col("mark").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("mark").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    alike = both >= least * (F.size("ha") + F.size("hb") - both)
    starred = stored(pairs.join(left, "a").join(right, "b").where(alike).select("a", "b"), "starred")
    verified = components(starred)
    parted = classes.join(verified, classes.mark == verified.node, "left").select("mark", "n", "class", F.coalesce("root", "mark").alias("root"))
    rest = stored(class_links(parted, sets, least), "rest")
    if not rest.isEmpty():
        verified = components(starred.union(rest))
    named = texts.join(verified, texts.mark == verified.node, "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    named = stored(named, "named")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(firsts, "root").select("mark", "component_id"), "named")
    return rows.select(F.col("key").alias(key), "mark").join(named, "mark").select(key, "mark", "component_id")


def class_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) links between the parts (``root``) of every class of over three texts, whose components are those of all its pairs."""
    sums = members.groupBy("class").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    chunks = F.greatest(F.ceil(F.col("m") / CLASS_TEXTS), F.ceil(F.col("total") / CLASS_SHINGLES), F.lit(1)).cast("int").alias("chunks")
    open_ = stored(sums.where("m > 3 and r0 < r1").select("class", chunks), "parted")
    dealt = members.join(open_, "class").withColumn("own", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # With several chunks, pairs inside a chunk meet wherever the chunk meets another.
    dealt = dealt.where("chunks = 1 or own <> other")
    dealt = dealt.select("class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "mark", "root").join(sets, "mark")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, marks, roots, own = None, [], [], []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            names = zip(*(batch.column(n).to_pylist() for n in ("class", "i", "j")))
            for row, at in enumerate(names):
                if at != key:
                    edges += jaccard_forest(marks, own, least, roots)
                    key, marks, roots, own = at, [], [], []
                marks.append(batch.column("mark")[row].as_py())
                roots.append(batch.column("root")[row].as_py())
                own.append(set(batch.column("hashes")[row].as_py()))
            yield _edges(edges)
        yield _edges(jaccard_forest(marks, own, least, roots))

    ordered = dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")
    return ordered.mapInArrow(compare, "a long, b long")


def first_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of their group of copies; all columns stay.

    Rows with a NULL id stay only where no row with an id is a copy; repeated rows
    leave one.
    """
    names = df.columns
    keep = near_copies(df, key, text).where(F.col(key).eqNullSafe(F.col("component_id")))
    keep = stored(keep.select(F.col(key).alias("__key"), F.col("mark").alias("__mark")).distinct(), "keep")
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (mark == F.col("__mark"))
    return df.join(keep, same, "left_semi").dropDuplicates([key, text]).select(*names)

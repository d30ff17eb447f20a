"""Nearest vectors by multi-index hashing over learned rotated binary codes.

Inner products are first turned into angles: every vector gets one more component
that brings it to the length of the longest, queries get a zero there.  Several
rotations, learned on a bounded sample by alternating signs and an orthogonal fit,
give each vector a code of ``ROTATIONS`` x (dimension + 1) bits, cut into substrings
of ``SUBSTRING`` bits or a little more.  A shard of vectors holds an inverted list per
substring.

A query probes, in steps, all values within 0, 1, ... bits of its own in every
substring.  By the pigeonhole principle step r has met every code within
(r + 1) x substrings - 1 bits.  When ``k`` codes are complete, their best inner
products bound the k-th best from below; the radius at which a vector with such a
product can lie (learned on the sample, with a margin of ``MARGIN`` deviations)
decides how far probing goes, and all codes within it are reranked with the original
vectors in double precision.  Beyond ``PROBED`` bits a substring has more values than
lists are worth; where the radius lies there, the query's code is compared with all
codes of the shard, which meets the same ones.  Vectors without any cluster are such a
case: their nearest codes differ in two fifths of the bits.

Every row is indexed, once: rows come to their shard, an index is built, and the
queries stream by.  Each shard returns its best ``k`` per query, so a query's answers
never gather in one task.

Cases: vectors that are NULL, zero, empty or hold NULL or non-finite components take
no part, nor do those whose id is NULL; every dimension is indexed and searched by
itself; repeated ids are candidates each, but never for a query of
their own id, and a repeated query id is asked once (smallest vector); equal scores
go by the smaller id; with fewer than ``k`` candidates all are returned; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import hash_sample, stored

NEIGHBOURS, ROTATIONS, MARGIN = 20, 4, 2.0
#: Bits of a substring, and bits within which its values are probed.
SUBSTRING, PROBED = 16, 1
#: Vectors that codes and radius are learned on; rows of a shard.
SAMPLE, SHARD_ROWS = 2_048, 8_192
#: Alternations of the rotation fit.
FIT_ROUNDS = 8


@dataclass
class Codes:
    """Learned rotations and the radius for an inner product."""

    longest: float
    mean: np.ndarray
    rotations: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of equal length: the added component takes up what is missing."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(axis=1)))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def aim(self, queries: np.ndarray) -> np.ndarray:
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)

    def bits(self, lifted: np.ndarray) -> np.ndarray:
        return np.concatenate([(lifted - self.mean) @ r > 0 for r in self.rotations], axis=1)

    def encode(self, lifted: np.ndarray) -> np.ndarray:
        """Codes as whole 64-bit words; the bits that fill the last one are zero in all."""
        return words(self.bits(lifted))

    def radius(self, products: np.ndarray) -> np.ndarray:
        """Bits within which a lifted vector with such a product lies, but for rare ones."""
        return np.ceil(self.offset + self.slope * products)


def words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of one code to many."""
    return np.bitwise_count(code ^ codes).sum(axis=-1, dtype=np.int16)


def learn(sample: np.ndarray, longest: float) -> Codes:
    rng = np.random.default_rng(11)
    codes = Codes(longest, np.zeros(sample.shape[1] + 1), np.zeros((0, 0, 0)))
    lifted = codes.lift(sample)
    codes.mean = lifted.mean(axis=0)
    centred = lifted - codes.mean
    rotations = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((centred.shape[1], centred.shape[1])))[0]
        for _ in range(FIT_ROUNDS):
            signs = np.sign(centred @ r)
            u, _, v = np.linalg.svd(centred.T @ signs)
            r = u @ v
        rotations.append(r)
    codes.rotations = np.array(rotations)
    # Distance in bits as a line over the product, from each sample query's best pairs.
    asked = sample[: min(len(sample), 512)]
    products = codes.aim(asked) @ lifted.T
    near = np.argsort(-products, axis=1)[:, 1 : 1 + NEIGHBOURS]
    if near.size > 2:
        x = np.take_along_axis(products, near, axis=1).ravel()
        own, all_codes = codes.encode(codes.aim(asked)), codes.encode(lifted)
        y = np.array([hamming(own[i], all_codes[near[i]]) for i in range(len(asked))]).ravel()
        spread = ((x - x.mean()) ** 2).sum()
        slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 1e-12 else 0.0
        slope = min(0.0, slope)
        rest = y - y.mean() - slope * (x - x.mean())
        codes.slope, codes.offset = slope, y.mean() - slope * x.mean() + MARGIN * max(1.0, rest.std())
    else:
        codes.offset = float(codes.bits(lifted).shape[1])
    return codes


class Shard:
    """Multi-index over one shard's vectors: a sorted list of values and rows per substring."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors = codes, ids, vectors
        self.lifted = codes.lift(vectors)
        bits = codes.bits(self.lifted)
        self.n_bits, self.codewords = bits.shape[1], words(bits)
        edges = np.linspace(0, self.n_bits, max(1, self.n_bits // SUBSTRING) + 1).astype(int)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.lists = []
        for values in substrings(bits, self.spans):
            order = np.argsort(values, kind="stable")
            self.lists.append((values[order], order))

    def complete(self, step: int) -> int:
        """Every code within so many bits has been met after the step."""
        return (step + 1) * len(self.spans) - 1

    def probe(self, values: list[int], step: int) -> np.ndarray:
        """Rows that differ from the query by ``step`` bits in some substring."""
        found = []
        for value, (a, b), (keys, order) in zip(values, self.spans, self.lists):
            wanted = value ^ flips(b - a, step)
            starts, stops = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
            found += [order[i:j] for i, j in zip(starts.tolist(), stops.tolist()) if i < j]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of the best ``k`` rows of the shard for each query."""
        aimed = self.codes.aim(queries)
        bits = self.codes.bits(aimed)
        own, parts = words(bits), np.stack(substrings(bits, self.spans), axis=1).tolist()
        for q in range(len(queries)):
            rows = self.candidates(own[q], parts[q], aimed[q], query_ids[q], k)
            rows = rows[self.ids[rows] != query_ids[q]]
            score = (self.vectors[rows] * queries[q]).sum(axis=1)
            order = np.lexsort((self.ids[rows], -score))[:k]
            yield q, self.ids[rows][order], score[order]

    def candidates(self, own: np.ndarray, parts: list[int], aimed: np.ndarray, query_id: int, k: int) -> np.ndarray:
        """All rows whose codes lie within the radius that the query's nearest codes call for."""
        met, far = np.zeros(0, np.int64), np.zeros(0, np.int16)
        for step in range(PROBED + 2):
            complete = self.complete(step)
            if step <= PROBED:
                fresh = np.setdiff1d(self.probe(parts, step), met, assume_unique=True)
                met, far = np.append(met, fresh), np.append(far, hamming(own, self.codewords[fresh]))
            else:
                met, far, complete = np.arange(len(self.ids)), hamming(own, self.codewords), self.n_bits
            others = self.ids[met] != query_id
            near = np.flatnonzero((far <= complete) & others)
            if len(near) >= k:
                close = met[near[np.argpartition(far[near], k - 1)[: 4 * k]]]
                products = self.lifted[close] @ aimed
                bound = np.partition(products, len(close) - k)[len(close) - k]
                reach = min(self.n_bits, max(0, int(self.codes.radius(bound))))
                if reach <= complete:
                    return met[far <= reach]
        return met


def substrings(bits: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in spans]


@lru_cache
def flips(width: int, step: int) -> np.ndarray:
    """Every value with ``step`` bits of ``width``."""
    return np.array([sum(1 << i for i in chosen) for chosen in combinations(range(width), step)], np.int64)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null").where(ok)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank (from 1), key, score: for rows whose id ``every`` divides, their ``k`` rows of largest inner product."""
    rows = stored(usable(df, key, vector), "vectors")
    schema = f"query_id long, rank int, {key} long, score double"
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    best = None
    for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # one row per dimension
        part = _candidates(rows.where(F.size("v") == r.d), asked.where(F.size("v") == r.d), r["count"], every, k)
        best = part if best is None else best.union(part)
    if best is None:
        return df.sparkSession.createDataFrame([], schema)
    # At most k rows of each shard meet per query.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _candidates(rows: DataFrame, asked: DataFrame, total: int, every: int, k: int) -> DataFrame:
    """(query_id, id, score): each shard's best ``k`` rows per query, for vectors of one dimension."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm)).first()[0]
    # The codes are learned on SAMPLE rows at most; all rows are indexed.
    sample = np.array(sorted(list(r.v) for r in hash_sample(rows, ["id"], SAMPLE).collect()))
    sample = sample[np.random.default_rng(5).permutation(len(sample))] if len(sample) else sample
    codes = learn(sample, float(longest))
    shards = -(-total // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    both = rows.select(shard.alias("shard"), F.lit(0).alias("kind"), "id", "v").unionByName(asked.select(every_shard.alias("shard"), F.lit(1).alias("kind"), "id", "v"))
    ordered = both.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows come first and make the index, then its queries are answered batch by batch."""
        at, ids, vectors, index = None, [], [], None
        for batch in batches:
            width = len(batch.column(3).flatten()) // len(batch) if len(batch) else 0
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = batch.column(2).to_numpy()
            v = batch.column(3).flatten().to_numpy().reshape(-1, width)
            cuts = np.flatnonzero(np.diff(keys * 2 + kinds)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if b == a:
                    continue
                if keys[a] != at:
                    at, ids, vectors, index = keys[a], [], [], None
                if kinds[a] == 0:
                    ids.append(own[a:b])
                    vectors.append(v[a:b])
                elif ids:
                    index = index or Shard(codes, np.concatenate(ids), np.concatenate(vectors))
                    found = list(index.search(own[a:b], v[a:b], k))
                    columns = [np.repeat(own[a:b], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["query_id", "id", "score"])

    return ordered.mapInArrow(run, "query_id long, id long, score double")

"""URL filter by a Bloom filter cascade.

The rules' keys are (host, path prefix) strings.  Level 0 of the cascade is a Bloom
filter of the listed keys; level 1 holds the keys of the corpus that level 0 lets
through although they are not listed; level 2 the listed keys that level 1 lets
through, and so on until nothing is left.  The corpus's own keys (every host suffix
with every path prefix of a rule's length) are the complete universe, so membership
of each of them is exact, and a row is judged without a join.

The filters go to every task, so their size is checked against ``MAX_BYTES``; a
longer list is matched by a join of the distinct (host, path) pairs, with equal
results.

Cases: NULL urls and urls without ``://`` have empty host and path and fit no rule;
of several rules that fit, the longest string wins, then the longer host; a key that
is listed as both is blocked; repeated rows are judged each; an empty table or an
empty list works; NULL rules are ignored; other columns are carried along (``host``,
``path``, ``rule`` and ``verdict`` are replaced if present).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import stored

#: Bits per key and hash functions of a level; the first bits of a small level.
BITS_PER_KEY, HASHES, LEAST_BITS = 8, 5, 64
#: All levels of both cascades may take so many bytes in a task.
MAX_BYTES = 256 * 2**20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """All keys of a url that a rule could have, longest first, then longer host first."""
    found = [(len(h) + n, len(h), h + path[:n]) for h in suffixes(host) for n in lengths if len(path) >= n]
    return [key for _, _, key in sorted(found, key=lambda x: (-x[0], -x[1]))]


def _places(key: str, level: int, bits: int) -> list[int]:
    """Bits of a key in a level; each level hashes anew, so equal hashes part at the next."""
    h = xxhash.xxh64_intdigest(key.encode(), level)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def bloom(keys: DataFrame, level: int) -> np.ndarray:
    """Bits of the keys (column ``key``), set in the tasks; only the bits that are set reach the driver."""
    bits = max(LEAST_BITS, BITS_PER_KEY * keys.count())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sorted({p for k in batch.column(0).to_pylist() for p in _places(k, level, bits)})
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["bit"])

    out = np.zeros(-(-bits // 8) * 8, np.uint8)
    for row in keys.select("key").mapInArrow(mark, "bit long").distinct().toLocalIterator():
        out[row.bit] = 1
    # The exact number of bits is kept as a trailer of the array's length.
    return np.append(np.packbits(out, bitorder="little"), np.frombuffer(np.int64(bits).tobytes(), np.uint8))


def _holds(level_bits: np.ndarray, key: str, level: int) -> bool:
    bits = int(level_bits[-8:].view(np.int64)[0])
    return all(level_bits[p >> 3] >> (p & 7) & 1 for p in _places(key, level, bits))


def is_listed(levels: list[np.ndarray], key: str) -> bool:
    """Exact for every listed key and every key of the universe that the cascade was built over."""
    for i, level in enumerate(levels):
        if not _holds(level, key, i):
            return i % 2 == 1
    return len(levels) % 2 == 1


def _through(keys: DataFrame, level_bits: np.ndarray, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in batch.column(0).to_pylist() if _holds(level_bits, k, level)], pa.string())], ["key"])

    return keys.select("key").mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[np.ndarray]:
    """Levels over the listed keys and the universe's keys (columns ``key``)."""
    inside = stored(listed.select("key").where("key is not null").distinct(), "listed")
    levels = [bloom(inside, 0)]
    outside = stored(_through(universe, levels[0], 0).distinct().join(inside, "key", "left_anti"), "false-hits")
    here, there = outside, inside
    while not here.isEmpty():
        levels.append(bloom(here, len(levels)))
        here, there = stored(_through(there, levels[-1], len(levels) - 1), "false-hits"), here
    return levels


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict; ``rules`` has host, path and verdict (block or allow).

    A url that no rule fits is not listed, and the cascade's verdict is allow.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [f for f in pages.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    parsed = pages.select(*names, host_of(url).alias("host"), path_of(url).alias("path"))
    known = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    known = known.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "host", "verdict")
    # The number of different lengths of rule paths; each adds a key per host suffix.
    lengths = sorted(r.n for r in known.select("n").distinct().collect())
    if known.count() * BITS_PER_KEY / 8 * 4 > MAX_BYTES:
        return _by_join(parsed, known, lengths, names)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted({k for h, p in pairs for k in keys_of(h, p, lengths)}), pa.string())], ["key"])

    universe = stored(parsed.select("host", "path").mapInArrow(explode, "key string").distinct(), "universe")
    block = build_cascade(known.where("verdict = 'block'"), universe)
    allow = build_cascade(known.where("verdict = 'allow'"), universe)
    if sum(map(len, block + allow)) > MAX_BYTES:
        return _by_join(parsed, known, lengths, names)
    sent = pages.sparkSession.sparkContext.broadcast((block, allow))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, allow = sent.value
        for batch in batches:
            rule, verdict = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                for key in keys_of(h, p, lengths):
                    if is_listed(block, key) or is_listed(allow, key):
                        rule.append(key)
                        verdict.append("block" if is_listed(block, key) else "allow")
                        break
                else:
                    rule.append(None)
                    verdict.append("allow")
            columns = [batch.column(n) for n in (*names, "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, *added])

    return parsed.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.StringType()) for n in added)]))


def _by_join(parsed: DataFrame, known: DataFrame, lengths: list[int], names: list[str]) -> DataFrame:
    """The same verdicts by a join of the distinct (host, path) pairs, for lists beyond the filters' bound."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, k, -i) for h, p in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for i, k in enumerate(keys_of(h, p, lengths))]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "key", "place"])

    verdicts = known.groupBy("key").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    pairs = parsed.select("host", "path").distinct().mapInArrow(explode, "host string, path string, key string, place int")
    best = pairs.join(verdicts, "key").groupBy("host", "path").agg(F.max(F.struct("place", "key", "verdict")).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(*names, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


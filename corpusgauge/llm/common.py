"""Shared helpers: tables in the shared folder, bounded batches, group identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.session import shared_folder, shuffles_deleted

#: Characters handed to one numpy pass; a longer text is a pass of its own.
PASS_CHARS = 1_500_000
#: Bytes of rows in a batch that Spark hands to a Python worker; both hold it, and Spark's 64 MB are much for small executors.
BATCH_BYTES = 4 * 2**20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of a bitmap of keys: about sixteen per key, within these bounds.
LEAST_BITS, MOST_BITS = 2**22, 2**30


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python workers batches of about ``BATCH_BYTES`` (one row at least).

    A limit that the session names in other units than bytes stays.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if now.isdecimal() and int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write go with it; later steps read the table only.
    """
    path = fresh_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def hash_sample(df: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """About 0.9 ``most`` rows by the hash of their keys, all of them if there are no more; never over ``most``.

    The tasks filter, so only the sample moves; an ordered limit would send ``most``
    rows of every task to the driver.
    """
    total = df.count()
    if total > most:
        share = F.pmod(F.xxhash64(*by, F.lit(77)), F.lit(2**31)) / 2**31
        df = df.where(share < 0.9 * most / total)
    return df.limit(most)


def passes(texts: Sequence[str | bytes | None], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters; every text is in exactly one."""
    yield from ranges([len(text) if text else 0 for text in texts], limit)


def ranges(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum up to about ``limit``; every index is in exactly one."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def text_passes(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list]]:
    """Index ranges of about ``limit`` bytes with their texts; only one range's texts are Python objects at a time."""
    for a, b in ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; NULL keys count as text ''."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus).cast("int")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64), 7) & np.uint64(bits - 1)).astype(np.int64)


def key_bitmap(df: DataFrame, *columns: str, key: Callable[..., np.ndarray] | None = None) -> bytes:
    """Bitmap of long keys to broadcast; a test of it has false hits but misses none.

    The key is the one column, or what ``key`` makes of several.

    Its size is bounded by ``MOST_BITS``: with more keys it lets more through, so a
    join with the keys themselves must follow.
    """
    count, bits = df.count(), LEAST_BITS
    while bits < min(MOST_BITS, 16 * count):
        bits *= 2
    piece = min(bits, 2**19)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            at = _bits(key(*values) if key else values[0], bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // piece).astype(np.int32)), pa.array((at % piece).astype(np.int32))], ["piece", "bit"])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(piece, np.uint8)
        on[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"piece": [int(part["piece"].iloc[0])], "data": [np.packbits(on, bitorder="little").tobytes()]})

    # Distinct bits first, so a piece is a bounded group whatever the number of keys.
    rows = df.select(*columns).mapInArrow(mark, "piece int, bit int").distinct().groupBy("piece").applyInPandas(fill, "piece int, data binary")
    out = bytearray(bits // 8)
    for row in rows.toLocalIterator():
        out[row.piece * piece // 8 : (row.piece + 1) * piece // 8] = row.data
    return bytes(out)


def bitmap_has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

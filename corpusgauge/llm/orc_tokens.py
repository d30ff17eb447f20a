"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are range-partitioned by id, encoded, and written as one ORC file per
range, in ascending id order inside each.  ORC's integer columns are run-length
encoded; the writer adds row indexes (minimum and maximum per stride) and Bloom
filters on the document id, so a look-up by id skips files, stripes and strides from
metadata, and a scan reads stripes in parallel.

Cases: NULL and empty texts hold the end id only; rows of one id stand next to each
other in the order of their texts' hashes; NULL ids come first; repeated rows are
written each; an empty table gives an empty data set; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.llm.common import small_batches, stored, text_passes

#: Rows per index entry, bytes per stripe, false hits of a Bloom filter.
STRIDE, STRIPE_BYTES, FALSE_HITS = 1_000, 8 * 2**20, 0.01
#: Words whose ids a Python worker keeps; then the cache starts anew.
CACHE_WORDS = 800_000
#: Bytes of text that are encoded at a time; a longer text by itself.
CODED_BYTES = 200_000
#: What words may end in and be cut before; an apostrophe may belong to letters.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands for a text's end; never a word.
END = b"\n"
#: Words that tell whether a tokenizer works word by word.
PROBES = ("it's", "Abc,d", "12.5%", "straße", "日本", "é\u0301x", "'s", "#", "naïve")


#: New words that are encoded in one call; encoders by file, which reused Python workers keep from task to task.
CHUNK_WORDS = 2_000
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file, with the words that it has met so far."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Ids of texts by a tokenizer file; words between ASCII white space are encoded once.

    Only for tokenizers whose pieces never span white space and ignore it; others are
    refused when the file is loaded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._refuse_others(path)
        self._clear()

    def _refuse_others(self, path: str) -> None:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        apart = [i for word in PROBES for i in ids(word)]
        if any(ids(gap.join(PROBES)) != apart for gap in (" ", "  ", "\n", "\t \r\n")) or ids(f" {PROBES[0]} ") != ids(PROBES[0]):
            raise ValueError(f"{path}: its pieces depend on white space, so words cannot be encoded by themselves")
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lowers = all(ids(word) == ids(word.lower()) for word in (*letters, letters, "The", "McX's", "ÄOß"))
        self.model = self.tokenizer.model
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        lowered = lambda word: word.lower() if self.lowers else word
        plain = [lowered(w) for w in (*letters, *(a + b for a in letters for b in letters), letters, "Hyperparameterization", "Straightforwardly")]
        self.plain = not any(own.isalpha() for own in self.added) and all(ids(word) == [t.id for t in self.model.tokenize(word)] for word in plain)
        stems = [lowered(w) for w in ("a", "S", "the", "Hyperparameterization", "it's", "ÄOß", "éa", "1st", "Abc,d", "x've", "e\u0301x")]
        marks = [chr(c) for c in PUNCTUATION]
        tails = [*marks, *(a + b for a in marks for b in ".,!$"), "...", "$$$", ".%%%"]
        self.splits = all(ids(stem + tail) == ids(stem) + ids(tail) for stem in stems for tail in tails)

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.cuts = array("I"), array("q", [0])

    def _learn(self, words: list[bytes]) -> None:
        """Words that end in punctuation are put together from the word before it and the punctuation."""
        cut = []
        if self.splits:
            ends = [(word, stem) for word in words if not word.isalpha() and (stem := word.rstrip(PUNCTUATION))[-1:].isalpha() and stem != word]
            cut = [(word, stem) for word, stem in ends if not any(own in word for own in self.added)]
            whole = set(words)
            whole.difference_update(word for word, _ in cut)
            whole.update(stem for _, stem in cut)
            whole.update(word[len(stem) :] for word, stem in cut)
            words = [word for word in whole if word not in self.place]
        if self.plain:
            self._learn_plain([word for word in words if word.isalpha()])
            words = [word for word in words if not word.isalpha()]
        if words:
            self._learn_joined(words)
        if cut:
            parts = np.array([(self.place[stem], self.place[word[len(stem) :]]) for word, stem in cut]).reshape(-1)
            ids, sizes = self._ids(parts)
            self.cuts.frombytes((len(self.pool) + np.cumsum(sizes)[1::2]).tobytes())
            self.pool.frombytes(ids.tobytes())
            self.place.update(zip((word for word, _ in cut), range(len(self.place), len(self.place) + len(cut))))

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words of ASCII letters go to the tokenizer's model by themselves; nothing else changes them."""
        tokenize, size = self.model.tokenize, len(self.pool)
        for word in words:
            own = [t.id for t in tokenize(word.decode())]
            self.pool.extend(own)
            size += len(own)
            self.cuts.append(size)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and how many each has."""
        pool, cuts = np.frombuffer(self.pool, np.uint32), np.frombuffer(self.cuts, np.int64)
        sizes = (cuts[1:] - cuts[:-1])[at]
        first = np.cumsum(sizes) - sizes
        return pool[np.repeat(cuts[at] - first, sizes) + np.arange(int(sizes.sum()))], sizes

    def _learn_joined(self, words: list[bytes]) -> None:
        """Encodes words joined by blanks, many a call; a piece belongs to the word that it begins in."""
        texts = [word.decode() for word in words]
        chunks = [texts[a : a + CHUNK_WORDS] for a in range(0, len(texts), CHUNK_WORDS)]
        for chunk, coded in zip(chunks, self.tokenizer.encode_batch([" ".join(c) for c in chunks], add_special_tokens=False)):
            sizes = np.fromiter(map(len, chunk), np.int64, len(chunk)) + 1
            firsts = np.fromiter(map(itemgetter(0), coded.offsets), np.int64, len(coded.ids))
            self.cuts.frombytes((len(self.pool) + np.searchsorted(firsts, np.cumsum(sizes))).tobytes())
            self.pool.extend(coded.ids)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))

    def _add(self, word: bytes, ids: list[int]) -> None:
        self.place[word] = len(self.place)
        self.pool.extend(ids)
        self.cuts.append(len(self.pool))

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each text has."""
        if len(self.place) > CACHE_WORDS:
            self._clear()
        if not self.place:
            self._add(END, [end_id])
        words: list[bytes] = []
        per = []
        for text in texts:
            data = text.encode() if text else b""
            # A tokenizer that lowers letters meets fewer words if A-Z are lowered before.
            own = (data.lower() if self.lowers else data).split()
            words += own
            words.append(END)
            per.append(len(own) + 1)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            self._learn(list({words[i] for i in missed}))
            at[missed] = [self.place[words[i]] for i in missed]
        ids, sizes = self._ids(at)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(edges)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write (key, tie, ids) as ORC in ascending order of key; ``tie`` orders rows of one key."""
    source = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.col(text).alias("text"))
    ordered = small_batches(source).repartitionByRange(key, "tie").sortWithinPartitions(key, "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for a, b, texts in text_passes(batch.column(2), CODED_BYTES):
                ids, per = own.encode(texts, end_id)
                part = batch.slice(a, b - a)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], [key, "tie", "ids"])

    coded = ordered.mapInArrow(run, f"{key} long, tie long, ids array<int>")
    options = {
        "orc.create.index": "true",
        "orc.row.index.stride": str(STRIDE),
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.bloom.filter.columns": key,
        "orc.bloom.filter.fpp": str(FALSE_HITS),
        "compression": "zstd",
    }
    coded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    return spark.read.schema(f"{key} long, tie long, ids array<int>").orc(path)


def layout(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """From the files, per row: key, start (ids before it in the whole data set), n_tokens, ids_crc32.

    Sums per file come first; offsets inside a file need only the file's own rows.
    """
    rows = read_tokens(spark, path, key).select(key, "tie", F.input_file_name().alias("file"), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]) if len(lists) else [0]
            sums = [zlib.crc32(flat[a:b].data) for a, b in zip(cuts, cuts[1:])]
            columns = [batch.column(i) for i in range(3)]
            sizes = pa.array(np.diff(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, sizes, pa.array(sums, pa.int64())], [key, "tie", "file", "n_tokens", "ids_crc32"])

    marked = stored(rows.mapInArrow(digest, f"{key} long, tie long, file string, n_tokens long, ids_crc32 long"), "digests")
    # One row per file.
    files = marked.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct(key, "tie")).alias("first"))
    before = F.sum("total").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")
    files = files.select("file", before.alias("base"))
    own = Window.partitionBy("file").orderBy(key, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marked.withColumn("inside", F.sum("n_tokens").over(own) - F.col("n_tokens"))
    return inside.join(files, "file").select(key, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

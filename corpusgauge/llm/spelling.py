"""Spelling variants grouped by PartEnum signatures over letter multisets.

Words are maximal runs of letters, A-Z lowered.  Two words are near if one inserted,
deleted or replaced code point turns one into the other.  A word's letters, as a binary
vector over (letter, how manieth of its kind), then differ in at most two places: one
for an insertion or deletion, two for a replacement.

PartEnum finds such vectors by equality alone.  The places are dealt into parts; d
differences touch d parts at most, so the vectors agree on all but d parts.  Each choice
of that many parts gives a signature, the hash of the word's length and of its places in
them.  Words of one length differ in two places: ``REPLACED`` parts, two left out.
Words whose lengths differ by one differ in one place: ``INSERTED`` parts, one left out,
the longer word signed as if it were one shorter.  Equi-joins on signatures yield the
candidates; inside the join a 64-bit parity of the vectors and then the edit distance
verify each, and only verified pairs are moved.

``variants`` links each word to its most frequent near word, if that one is ``RATIO``
times as frequent, and follows such links to a root.  Frequencies grow along them, so
there are no cycles, and pointer doubling ends after few rounds.

Cases: NULL and empty texts have no words; a NULL key counts as text '' where runs are
damaged; repeated rows count each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import mix, stored

MIN_LETTERS, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: Parts of the vector for a replaced letter (two places) and for an inserted or deleted one (one place).
REPLACED, INSERTED = 7, 4
#: Distinct words that a task counts before it emits them; bytes of a text that are split at a time.
MOST_WORDS, STEP_BYTES = 600_000, 2**20
#: Words counted in one pass; longer words than so many bytes have their checksums worked out one by one.
PASS_WORDS, WORD_BYTES = 200_000, 64


def _kept(code: int) -> int:
    if ord("A") <= code <= ord("Z"):
        return code + 32
    return code if ord("a") <= code <= ord("z") or code >= 0xC0 else ord(" ")


#: Over Latin-1 codes: A-Z to a-z, other letters of runs stay, the rest parts runs.
RUN_LETTERS = bytes(map(_kept, range(256)))


def runs(text: str) -> Iterator[list[bytes]]:
    """All maximal letter runs of the whole text in bounded lists, as Latin-1; code points beyond Latin-1 part runs."""
    data = text.encode("latin-1", "replace").translate(RUN_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def damaged(word: bytes, start: int, one_in: int) -> bytes:
    """The run, or without one code point if ``one_in`` divides its checksum (as UTF-8); ``start`` is the crc32 of the prefix."""
    check = zlib.crc32(_utf8(word), start)
    if check % one_in:
        return word
    at = check % len(word)
    return word[:at] + word[at + 1 :]


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def after_zeros(checks: np.ndarray, most: int) -> np.ndarray:
    """Checksums moved on by 0 to ``most`` zero bytes: crc32(a + b) = moved(crc32(a), len(b)) ^ crc32(b)."""
    moved = [checks]
    for _ in range(most):
        moved.append(_STEP[moved[-1] & 0xFF] ^ (moved[-1] >> np.uint32(8)))
    return np.stack(moved, axis=1)


def _step() -> np.ndarray:
    """What a checksum's low byte turns into over one zero byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_STEP = _step()


class Words:
    """Counts of words, each occurrence with its document's damage; checksums are put together from the document's and the word's."""

    def __init__(self, one_in: int | None):
        self.one_in, self.extra = one_in, Counter()
        self.place: dict[bytes, int] = {}
        self.checks, self.sizes, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        for word in words:
            self.place[word] = len(self.place)
        written = [_utf8(word) for word in words]
        self.checks = np.append(self.checks, np.array([zlib.crc32(w) for w in written], np.uint32))
        self.sizes = np.append(self.sizes, np.array([len(w) for w in written], np.int64))
        self.n = np.append(self.n, np.zeros(len(words), np.int64))

    def count(self, words: list[bytes], starts: list[int], per: list[int]) -> None:
        """``per`` words of each document in turn; ``starts`` are the crc32 of the documents' prefixes."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            self._learn(list({words[i] for i in missed}))
            at[missed] = [self.place[words[i]] for i in missed]
        if self.one_in:
            doc = np.repeat(np.arange(len(per)), per)
            moved = after_zeros(np.array(starts, np.uint32), WORD_BYTES)
            check = moved[doc, np.minimum(self.sizes[at], WORD_BYTES)] ^ self.checks[at]
            apart = (check % np.uint32(self.one_in) == 0) | (self.sizes[at] > WORD_BYTES)
            for i in np.flatnonzero(apart).tolist():
                self.extra[damaged(words[i], starts[doc[i]], self.one_in)] += 1
            at = at[~apart]
        self.n += np.bincount(at, minlength=len(self.n))

    def totals(self) -> Iterator[tuple[bytes, int]]:
        counts = self.n.tolist()
        yield from ((w, n) for w, i in self.place.items() if (n := counts[i] + self.extra.pop(w, 0)))
        yield from self.extra.items()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = DAMAGE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): partial sums of the tasks; ``damage`` as in ``damaged``, None leaves words as they are."""
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text")).where("text is not null")

    def emit(held: Words) -> pa.RecordBatch:
        found = [(word.decode("latin-1"), n) for word, n in held.totals() if len(word) >= min_letters]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words(damage)
        words, starts, per = [], [], []
        for batch in batches:
            for doc, written in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{doc}:".encode())
                for found in runs(written.as_py()):
                    words += found
                    starts.append(start)
                    per.append(len(found))
                    if len(words) >= PASS_WORDS:
                        held.count(words, starts, per)
                        words, starts, per = [], [], []
                        if len(held.place) > MOST_WORDS:
                            yield emit(held)
                            held = Words(damage)
        held.count(words, starts, per)
        yield emit(held)

    return source.mapInArrow(count, "word string, n long")


def frequent_words(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = DAMAGE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    counted = word_counts(docs, key, text, damage, min_letters).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the letters of all words: word number, hash of the vector's place, spread (tells parts); per word: parity of its places in 64 bits, length."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    letters = letters[np.lexsort((letters, owner))]
    # The how manieth of its kind: the distance from the kind's first place.
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(letters))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    place = mix((letters * 2**32 + nth).view(np.uint64), 21)
    # A letter's repeats follow each other through the parts.
    spread = (mix(letters.view(np.uint64), 22) >> np.uint64(8)) + nth.astype(np.uint64)
    parity = np.zeros(len(words), np.uint64)
    np.bitwise_xor.at(parity, owner, np.uint64(1) << (place >> np.uint64(58)))
    return owner, place, spread, parity, sizes


def signatures(words: list[str], parts: int, left_out: int, shorter: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(words x signatures of each, parity): vectors that differ in ``left_out`` places share a signature, if their lengths less ``shorter`` are equal."""
    owner, place, spread, parity, sizes = places(words)
    hashes = np.zeros((len(words), parts), np.uint64)
    np.bitwise_xor.at(hashes, (owner, (spread % np.uint64(parts)).astype(np.int64)), place)
    size = mix((sizes - shorter).astype(np.uint64), 23)
    chosen = combinations(range(parts), parts - left_out)
    return np.stack([mix(np.bitwise_xor.reduce(hashes[:, c], axis=1) ^ size, 30 + n) for n, c in enumerate(chosen)], axis=1), parity


def signed(words: DataFrame, parts: int, left_out: int, shorter: int = 0) -> DataFrame:
    """(sig, word, parity): a row for each signature of each word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sigs, parity = signatures(batch.column(0).to_pylist(), parts, left_out, shorter)
                ends = np.arange(0, sigs.size + 1, sigs.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sigs.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parity.view(np.int64)), lists], ["word", "parity", "sigs"])

    rows = words.select("word").mapInArrow(sign, "word string, parity long, sigs array<long>")
    return rows.select(F.explode("sigs").alias("sig"), "word", "parity")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), once: all pairs of words that one inserted, deleted or replaced code point parts."""
    equal = signed(words, REPLACED, 2)
    replaced = _met(equal, equal, 2, F.col("l.word") < F.col("r.word"))
    inserted = _met(signed(words, INSERTED, 1), signed(words, INSERTED, 1, shorter=1), 1, F.lit(True))
    return replaced.unionByName(inserted).distinct()


def _met(left: DataFrame, right: DataFrame, apart: int, wanted: Column) -> DataFrame:
    """(a, b) of one signature that are near; the edit distance is only worked out where the parities leave room for ``apart`` places at most."""
    left, right = left.alias("l"), right.alias("r").hint("merge")  # the planner does not see how many rows the signatures make
    maybe = wanted & (F.bit_count(F.col("l.parity").bitwiseXOR(F.col("r.parity"))) <= apart)
    near = F.when(maybe, F.levenshtein("l.word", "r.word", 1) == 1).otherwise(False)
    return left.join(right, (F.col("l.sig") == F.col("r.sig")) & near).select(F.col("l.word").alias("a"), F.col("r.word").alias("b"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) of distinct words."""
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words), "pairs")
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    sized = pairs.select(both).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    linked = -F.col("best.less") >= ratio * F.col("n")
    forms = joined.select(
        "word",
        F.when(linked, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(linked, -F.col("best.less")).alias("form_n"),
    )
    forms = stored(forms, "forms")
    roots = _roots(forms.where("form is not null").select("word", "form"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer doubling."""
    roots = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return roots

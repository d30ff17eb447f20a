"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points.  A table maps every code point
to a class; class and next class select a transition function over a few scanner
states.  Functions compose associatively, so the states at all places come from
a blocked prefix scan of compositions (a table look-up per place), and the piece
boundaries from (state, symbol).  No regular expression runs.  The pieces go
through a cache of merged pieces; misses of about one length are merged by rank side
by side, one merge of each a step, and few or long ones by themselves.

Cases: NULL and empty texts give no ids and decode to an empty text; repeated rows
are encoded each; a text of any length is one pass of its own; columns of the input
other than the text are carried as they are (``token_ids`` and ``token_ends`` are
replaced if present).
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusgauge.llm.common import ranges, small_batches, text_passes

# White_Space of the Unicode standard, as \s has it.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The suffixes that the split pattern names.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

#: Merged pieces that a Python worker keeps; then the cache starts anew.
CACHE_PIECES = 200_000

# Code point classes.
SEP, LETTER, NUMBER, OTHER, APOSTROPHE, BLANK, SPACE = range(7)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point; the place after the last one separates texts."""
    table = np.full(0x110001, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    table[ord("'")] = APOSTROPHE
    table[0x110000] = SEP
    return table


# Symbols: what a place shows together with the place after it.
(Y_SEP, Y_LETTER, Y_NUMBER, Y_OTHER, Y_SUFFIX1, Y_SUFFIX2, Y_BLANK_IN, Y_BLANK_LAST, Y_SPACE_IN, Y_SPACE_LAST) = range(10)
# Scanner states: what the place before was.
(S_START, S_LETTER, S_NUMBER, S_OTHER, S_LEAD, S_WHITE, S_SHORT, S_LONG1, S_LONG2) = range(9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this place."""
    if symbol == Y_SEP:
        return S_START, True
    if symbol in (Y_BLANK_IN, Y_SPACE_IN):
        return S_WHITE, state not in (S_WHITE, S_LEAD)
    if symbol == Y_BLANK_LAST:
        return S_LEAD, True
    if symbol == Y_SPACE_LAST:
        return S_START, True
    if state == S_SHORT:  # the one letter of a short suffix
        return S_START, False
    if state == S_LONG1:  # the first of two
        return S_LONG2, False
    if state == S_LONG2:
        return S_START, False
    free = state in (S_START, S_LETTER, S_NUMBER, S_WHITE)
    if symbol == Y_SUFFIX1:
        return (S_SHORT, True) if free else (S_OTHER, False)
    if symbol == Y_SUFFIX2:
        return (S_LONG1, True) if free else (S_OTHER, False)
    run = {Y_LETTER: S_LETTER, Y_NUMBER: S_NUMBER, Y_OTHER: S_OTHER}[symbol]
    return run, state not in (run, S_LEAD)


@lru_cache(1)
def scanner() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State table, boundary table, composition table and the functions themselves.

    The functions are all compositions of the symbols' transition functions: the
    closure is finite because they map the same few states.
    """
    states, symbols = 9, 10
    move = np.array([[_step(s, y)[0] for y in range(symbols)] for s in range(states)], np.uint8)
    begin = np.array([[_step(s, y)[1] for y in range(symbols)] for s in range(states)], bool)
    known: dict[tuple[int, ...], int] = {}
    functions = [tuple(int(x) for x in move[:, y]) for y in range(symbols)] + [tuple(range(states))]
    for f in functions:
        known.setdefault(f, len(known))
    todo = list(known)
    generators = [functions[y] for y in range(symbols)]
    while todo:
        f = todo.pop()
        for g in generators:
            fg = tuple(g[x] for x in f)
            if fg not in known:
                known[fg] = len(known)
                todo.append(fg)
    by_id = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in by_id] for f in by_id], np.uint16)
    symbol_id = np.array([known[g] for g in generators], np.uint16)
    return move, begin, compose, np.array(by_id, np.uint8), symbol_id


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """Scanner state before every place, by a blocked scan of composed functions."""
    move, _, compose, functions, symbol_id = scanner()
    n = len(symbols)
    width = max(1, int(np.sqrt(n) // 4))
    blocks = -(-n // width)
    padded = np.full(blocks * width, Y_SEP, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    # Up: one function per block.
    whole = symbol_id[grid[0]]
    for column in grid[1:]:
        whole = compose[whole, symbol_id[column]]
    # Across: inclusive scan over the blocks by doubling.
    shift = 1
    while shift < blocks:
        whole[shift:] = compose[whole[:-shift].copy(), whole[shift:]]
        shift *= 2
    # Down: states inside every block, from the state that enters it.
    state = np.empty(blocks, np.uint8)
    state[0] = S_START
    state[1:] = functions[whole[:-1], S_START]
    out = np.empty_like(grid)
    for j, column in enumerate(grid):
        out[j] = state
        state = move[state, column]
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece (or a separator) begins."""
    classes = class_table()[points]
    after = np.empty_like(classes)
    after[:-1], after[-1] = classes[1:], SEP
    symbols = np.array([Y_SEP, Y_LETTER, Y_NUMBER, Y_OTHER, Y_OTHER, Y_BLANK_IN, Y_SPACE_IN], np.uint8)[classes]
    solid = (after != SEP) & (after < BLANK)
    symbols[(classes == BLANK) & solid] = Y_BLANK_LAST
    symbols[(classes == SPACE) & solid] = Y_SPACE_LAST
    quote = np.flatnonzero(classes == APOSTROPHE)
    if len(quote):
        last = len(points) - 1
        one, two = points[np.minimum(quote + 1, last)], points[np.minimum(quote + 2, last)]
        for suffix in SUFFIXES:
            hit = one == ord(suffix[0])
            if len(suffix) == 2:
                hit &= two == ord(suffix[1])
            symbols[quote[hit]] = Y_SUFFIX1 if len(suffix) == 1 else Y_SUFFIX2
    return scanner()[1][scan_states(symbols), symbols]


#: Bytes of text that are encoded at a time, and ids that are decoded at a time; a longer text by itself.
ENCODED_BYTES, DECODED_IDS = 400_000, 200_000
#: Bytes beyond which a piece is merged with a heap; below it a list is faster.
LONG_PIECE = 256
#: Fewer new pieces of about one length are merged one by one.
FEW_PIECES = 32
#: Stands for the rank of a pair that is no token; above all ranks.
NO_PAIR = 2**31 - 1


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pairs:
    """Ranks of joined tokens by the ranks of the two, for whole arrays: a table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        get, found = ranks.get, []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None:
                    found.append((left << 32 | right, rank))
        keys, values = np.array(found, np.int64).reshape(-1, 2).T
        self.bits = max(4 * len(keys), 16).bit_length()
        self.keys, self.values = np.full(2**self.bits, -1, np.int64), np.full(2**self.bits, NO_PAIR, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at = slot[todo]
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[todo[first]], values[todo[first]]
            todo = np.delete(todo, first)
            slot[todo] = slot[todo] + 1 & 2**self.bits - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``NO_PAIR`` where it is no token."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(NO_PAIR))
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & 2**self.bits - 1
            held = self.keys[slot[more]]
            hit = more[held == keys[more]]
            out[hit] = self.values[slot[hit]]
            more = more[(held != keys[more]) & (held >= 0)]
        return out


@lru_cache(4)
def load_pairs(path: str) -> Pairs | None:
    """None if ranks do not tell tokens apart or a byte has none; pieces are merged one by one then."""
    ranks = load_ranks(path)
    fit = all(bytes([b]) in ranks for b in range(256)) and len(set(ranks.values())) == len(ranks) and 0 <= min(ranks.values()) and max(ranks.values()) < NO_PAIR
    return Pairs(ranks) if fit else None


def merge_many(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces, the byte places where they end in their piece, and ids per piece; as ``merge`` of each.

    A column is a piece, a row the place of a part in it.  A step merges in every column
    the leftmost pair of lowest rank and moves what follows up by a row.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data, first = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
    width = int(sizes.max())
    row = np.arange(width, dtype=np.int32)[:, None]
    ids = pairs.bytes[data[np.minimum(first + row, len(data) - 1)]]
    ends = np.repeat(row + 1, len(pieces), axis=1)
    rank = pairs.ranks(ids[:-1].reshape(-1), ids[1:].reshape(-1)).reshape(width - 1, -1)
    rank[row[1:] >= sizes] = NO_PAIR
    done_ids, done_ends, done_sizes, own = ids, ends, sizes, None
    while True:
        best = rank.min(axis=0) if len(rank) else np.full(rank.shape[1], NO_PAIR, np.int32)
        on = np.flatnonzero(best < NO_PAIR)
        if 2 * len(on) <= len(best):
            # The finished pieces are put away.
            if own is not None:
                k = len(ids)
                done_ids[:k, own], done_ends[:k, own], done_sizes[own] = ids, ends, sizes
            own = on if own is None else own[on]
            if not len(on):
                break
            k = int(sizes[on].max())
            ids, ends, rank, sizes, best = ids[:k, on], ends[:k, on], rank[: k - 1, on], sizes[on], best[on]
            on = np.arange(len(on))
        k = len(ids)
        at = np.where(rank == best, row[: k - 1], k).min(axis=0)
        at[best == NO_PAIR] = k
        after = row[: k - 1] > at
        ends[:-1] = np.where(row[: k - 1] >= at, ends[1:], ends[:-1])
        ids[:-1] = np.where(after, ids[1:], ids[:-1])
        rank[:-1] = np.where(after[:-1], rank[1:], rank[:-1])
        rank[-1] = NO_PAIR
        at = at[on]
        ids[at, on] = best[on]
        sizes[on] -= 1
        near = at > 0
        rank[at[near] - 1, on[near]] = pairs.ranks(ids[at[near] - 1, on[near]], best[on[near]])
        near = at + 1 < sizes[on]
        rank[at[near], on[near]] = pairs.ranks(best[on[near]], ids[at[near] + 1, on[near]])
        rank[at[~near], on[~near]] = NO_PAIR
    held = (row < done_sizes).T
    return done_ids.T[held], done_ends.T[held], done_sizes


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Ids of a piece and the byte places where they end; lowest rank merges first, ties leftmost."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,), (len(piece),)
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    get, none = ranks.get, NO_PAIR
    cuts = list(range(len(piece) + 1))
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        best = min(pair)
        if best == none:
            break
        at = pair.index(best)
        del cuts[at + 1], pair[at]
        if at:
            pair[at - 1] = get(piece[cuts[at - 1] : cuts[at + 1]], none)
        if at < len(pair):
            pair[at] = get(piece[cuts[at] : cuts[at + 2]], none)
    return tuple(ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])), tuple(cuts[1:])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The same for a long piece: linked parts and a heap of pairs, so a merge costs the logarithm of the length."""
    n, get = len(piece), ranks.get
    after = list(range(1, n + 1))  # end of the part that begins here
    before = list(range(-1, n))  # start of the part that ends here
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue  # one of its parts has grown meanwhile
        after[i], after[middle], before[end] = end, -1, i
        if i and (rank := get(piece[before[i] : end])) is not None:
            heappush(heap, (rank, before[i], end))
        if end < n and (rank := get(piece[i : after[end]])) is not None:
            heappush(heap, (rank, i, after[end]))
    starts = [i for i in range(n) if after[i] > 0]
    return tuple(ranks[piece[i : after[i]]] for i in starts), tuple(after[i] for i in starts)


class Encoder:
    """Encodes lists of texts; keeps a bounded cache of merged pieces.

    The cache maps a piece to its place in flat pools of ids and end bytes, so that
    a batch is put together by array gathers.
    """

    def __init__(self, path: str):
        self.ranks, self.pairs = load_ranks(path), load_pairs(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool_ids, self.pool_ends, self.pool_cuts = array("i"), array("i"), array("q", [0])

    def _learn(self, pieces: set[bytes]) -> None:
        groups: dict[int, list[bytes]] = {}
        for piece in pieces:
            size = len(piece)
            alone = self.pairs is None or size > LONG_PIECE or piece in self.ranks
            groups.setdefault(0 if alone else (size - 1).bit_length(), []).append(piece)
        for kind, own in groups.items():
            if kind and len(own) >= FEW_PIECES:
                ids, ends, counts = merge_many(own, self.pairs)
                self.pool_ids.frombytes(ids.astype(np.int32).tobytes())
                self.pool_ends.frombytes(ends.astype(np.int32).tobytes())
                self.pool_cuts.frombytes((self.pool_cuts[-1] + np.cumsum(counts)).tobytes())
            else:
                for piece in own:
                    ids, ends = merge(piece, self.ranks)
                    self.pool_ids.extend(ids)
                    self.pool_ends.extend(ends)
                    self.pool_cuts.append(len(self.pool_ids))
            self.place.update(zip(own, range(len(self.place), len(self.place) + len(own))))

    def pieces(self, texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Joined bytes, byte places of all piece starts and the end, pieces per text."""
        joined = "".join(t or "" for t in texts)
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        points = np.full(len(joined) + len(texts), 0x110000, np.uint32)
        seps = np.cumsum(sizes + 1) - 1
        text_place = np.ones(len(points), bool)
        text_place[seps] = False
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        points[text_place] = raw
        starts = piece_starts(points)
        starts[seps] = False
        per_text = np.diff(np.concatenate([[0], np.cumsum(starts)[seps]]))
        wide = 1 + (raw > 0x7F).astype(np.int64) + (raw > 0x7FF) + (raw > 0xFFFF)
        ends = np.cumsum(wide)
        places = (ends - wide)[starts[text_place]]
        return joined.encode(), np.append(places, ends[-1] if len(ends) else 0), per_text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their end bytes inside their text, and ids per text."""
        data, places, per_text = self.pieces(texts)
        if len(self.place) > CACHE_PIECES:
            self._clear()
        at = places.tolist()
        words = list(map(data.__getitem__, map(slice, at, at[1:])))
        found = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            self._learn({words[i] for i in missed})
            found[missed] = [self.place[words[i]] for i in missed]
        # Views of the pools; all that leaves this function is gathered from them.
        cuts, pool_ids, pool_ends = map(np.asarray, (self.pool_cuts, self.pool_ids, self.pool_ends))
        counts = cuts[found + 1] - cuts[found]
        first = np.cumsum(counts) - counts
        source = np.repeat(cuts[found] - first, counts) + np.arange(int(counts.sum()))
        ids, inner = pool_ids[source], pool_ends[source]
        cumulative = np.concatenate([[0], np.cumsum(counts)])
        piece_cut = np.concatenate([[0], np.cumsum(per_text)])
        per_ids = np.diff(cumulative[piece_cut])
        byte_start = np.concatenate([[0], np.cumsum([len(t.encode()) if t else 0 for t in texts])])[:-1]
        ends = inner + np.repeat(places[:-1], counts) - np.repeat(byte_start, per_ids)
        return ids, ends, per_ids


def _list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode_documents(df: DataFrame, ranks_path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``token_ids`` (array<int>) and ``token_ends`` (byte place where each id ends); the text itself goes unless kept.

    Row-local: a map over Arrow batches without a shuffle.
    """
    drop = {"token_ids", "token_ends"} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(
        kept + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("token_ends", T.ArrayType(T.IntegerType(), False))]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path)
        for batch in batches:
            for a, b, texts in text_passes(batch.column(text), ENCODED_BYTES):
                ids, ends, per = encoder.encode(texts)
                part = batch.slice(a, b - a)
                columns = [part.column(n) for n in names]
                columns += [_list_array(ids, per, pa.int32()), _list_array(ends.astype(np.int32), per, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", "token_ends"])

    source = small_batches(df).select(*dict.fromkeys([*names, text]))
    return source.mapInArrow(run, schema)


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in the order of their ranks, and where those of each rank begin (and the last end)."""
    ranks = load_ranks(path)
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _decoded(lists: pa.ListArray, pool: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of every list of ids, gathered for ``DECODED_IDS`` ids at a time."""
    flat = lists.flatten().to_numpy()
    pieces, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for k in range(0, len(flat), DECODED_IDS):
        own = flat[k : k + DECODED_IDS]
        size = cuts[own + 1] - cuts[own]
        first = np.cumsum(size) - size
        pieces.append(pool[np.repeat(cuts[own] - first, size) + np.arange(int(size.sum()))])
        sizes.append(size)
    before = np.cumsum(np.concatenate(sizes))
    per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = before[np.concatenate([[0], np.cumsum(per)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(pieces))])


def decode_documents(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary column ``out``); the ids stay."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, cuts = token_bytes(ranks_path)
        for batch in batches:
            for a, b in ranges(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_pylist(), DECODED_IDS):
                part = batch.slice(a, b - a)
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, _decoded(part.column(ids), pool, cuts)], [*names, out])

    return small_batches(df).select(*names).mapInArrow(run, schema)

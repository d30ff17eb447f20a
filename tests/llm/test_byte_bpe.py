import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from corpusgauge.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("abstremvld'''''   \n\n\t\r\x0b\x85\xa0　\x1c!.,-ÉéßΣ漢字1२٣½\U0001f600́Ǆ") + ["'s", "'re", "'ve", "'ll", "'d", " '"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_ids_and_offsets_equal_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None, "   ", "'", "''s", "x" * 5000]
    ids, ends, per = byte_bpe.Encoder(PATH).encode(texts)
    at = 0
    for text, n in zip(texts, per):
        own = ids[at : at + n].tolist()
        assert own == library.encode_ordinary(text or "")
        cuts = [0, *ends[at : at + n].tolist()]
        data = (text or "").encode()
        assert [data[a:b] for a, b in zip(cuts, cuts[1:])] == [library.decode_single_token_bytes(i) for i in own]
        at += n
    assert at == len(ids)


def test_long_pieces_merge_as_short_ones_do(library, monkeypatch):
    rng = random.Random(7)
    ranks = byte_bpe.load_ranks(PATH)
    pieces = ["".join(rng.choices(a, k=rng.randint(2, 400))).encode() for a in ("ab", "theandion", "aé漢x", "x") for _ in range(60)]
    plain = [byte_bpe.merge(p, ranks) for p in pieces]
    monkeypatch.setattr(byte_bpe, "LONG_PIECE", 1)
    assert [byte_bpe.merge(p, ranks) for p in pieces] == plain
    monkeypatch.setattr(byte_bpe, "LONG_PIECE", 10_000)
    assert [byte_bpe.merge(p, ranks) for p in pieces] == plain


def test_a_megabyte_without_blanks(library):
    text = "".join(random.Random(8).choices("ABCDEFGHabcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.process_time()
    ids, ends, _ = byte_bpe.Encoder(PATH).encode([text])
    # A merge over the whole rest each time would take hours.
    assert time.process_time() - start < 60
    data, at = text.encode(), 0
    for i, end in zip(ids.tolist(), ends.tolist()):
        assert data[at:end] == library.decode_single_token_bytes(i)
        at = end
    assert at == len(data)
    assert byte_bpe.Encoder(PATH).encode([text[:20_000]])[0].tolist() == library.encode_ordinary(text[:20_000])


def test_round_trip_of_odd_rows(odd, odd_rows, library):
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, PATH), PATH).collect()
    got = sorted((str(r.doc_id), bytes(r.decoded).decode(), list(r.token_ids)) for r in rows)
    assert got == sorted((str(i), t or "", library.encode_ordinary(t or "")) for i, t, _ in odd_rows)


def test_empty_table(nothing):
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(nothing, PATH), PATH).count() == 0


def test_merging_many_pieces_is_merging_each():
    rng = random.Random(11)
    tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(300)}
    order = sorted(tokens)
    rng.shuffle(order)
    ranks = {token: 3 * i for i, token in enumerate(order)}  # in no order of length, with gaps
    pairs = byte_bpe.Pairs(ranks)
    pieces = [bytes(rng.choices(b"abcd", k=rng.randint(1, 40))) for _ in range(500)]
    ids, ends, counts = byte_bpe.merge_many(pieces, pairs)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    found = [(tuple(ids[a:b].tolist()), tuple(ends[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]
    assert found == [byte_bpe.merge(p, ranks) for p in pieces]


def test_new_pieces_are_not_merged_one_by_one(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=9)) for _ in range(2_000))]
    whole = [x.tolist() for x in byte_bpe.Encoder(PATH).encode(texts)]
    calls = []
    monkeypatch.setattr(byte_bpe, "merge", lambda piece, ranks, own=byte_bpe.merge: calls.append(piece) or own(piece, ranks))
    assert [x.tolist() for x in byte_bpe.Encoder(PATH).encode(texts)] == whole
    assert len(calls) < 200
    monkeypatch.setattr(byte_bpe, "FEW_PIECES", 10**9)
    assert [x.tolist() for x in byte_bpe.Encoder(PATH).encode(texts)] == whole


def test_decoding_gathers_lists_of_any_kind():
    pool, cuts = byte_bpe.token_bytes(PATH)
    ids = pa.array([[1], None, [1, 2], [], [3, 4, 5], None, [6]], pa.list_(pa.int32())).slice(1, 5)
    tokens = {rank: token for token, rank in byte_bpe.load_ranks(PATH).items()}
    assert byte_bpe._decoded(ids, pool, cuts).to_pylist() == [b"".join(tokens[i] for i in own or ()) for own in ids.to_pylist()]

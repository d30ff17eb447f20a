import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
from tokenizers import Tokenizer

from corpusgauge.llm import orc_tokens as O
from corpusgauge.llm.common import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_the_library_s_ids_in_order(spark, odd_rows):
    library = Tokenizer.from_file(PATH)
    strange = "a\x1cb \x85x　y É́ <|endoftext|>foo it's 12345 \n\t"
    rows = [(i, t) for i, t, _ in odd_rows] + [(20 + i, f"{strange} {i} Hello, wörld") for i in range(60)]
    path = fresh_path(spark, "orc")
    O.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, PATH, 2)
    want = {}
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start, last = 0, -1
    for r in O.layout(spark, path).orderBy("start").collect():
        assert r.start == start and (r.doc_id or -1) >= last
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start, last = start + r.n_tokens, r.doc_id or -1
    assert not any(want.values())
    assert O.read_tokens(spark, path).where("doc_id = 33").count() == 1
    files = glob.glob(f"{path.removeprefix('file://')}/*.orc")
    assert sum(pyarrow.orc.ORCFile(f).nrows for f in files) == len(rows)


def test_empty_table(spark, nothing):
    path = fresh_path(spark, "orc")
    O.write_tokens(nothing, path, PATH, 2)
    assert O.layout(spark, path).count() == 0


def test_words_cut_before_punctuation_equal_the_tokenizer():
    rng = random.Random(5)
    path = PATH
    marks = ["", ".", ",", "!!", "$$$", ".%%%", "'", "'.", "-x.", "…", "é", "́", "́.", "|>", "9.", "<|endoftext|>", "<|endoftext|>."]
    texts = [" ".join("".join(rng.choices("abTHÉé'", k=rng.randint(0, 6))) + rng.choice(marks) for _ in range(300)) for _ in range(12)] + [None, ""]
    own = O.WordEncoder(path)
    assert own.plain and own.splits
    ids, per = own.encode(texts, 2)
    plain = [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for p in plain for i in p] and per.tolist() == [len(p) for p in plain]


def test_few_words_are_encoded_joined(monkeypatch):
    rng = random.Random(6)
    joined = []
    monkeypatch.setattr(O.WordEncoder, "_learn_joined", lambda self, words, own=O.WordEncoder._learn_joined: joined.extend(words) or own(self, words))
    encoder = O.WordEncoder(PATH)
    encoder.encode([" ".join("".join(rng.choices("abcdefgh", k=7)) + rng.choice(["", ".", ",", "!!"]) for _ in range(2_000))], 2)
    assert len(joined) < 10

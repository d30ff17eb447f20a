"""Toxicity score: bidirectional GRU with attention pooling over word and character inputs.

A text is cut into overlapping windows of words.  A word enters as its own vector
(if the training windows hold it often enough) and the mean vector of its character
grams, so unseen spellings still carry their characters.  A forward and a backward
gated recurrent layer read the window, attention pools their states, and a logistic
output gives the window's logit.  A text scores the largest logit of all its
windows, put on a probability scale that is fitted on whole training texts.

Training uses numpy on the driver over a bounded sample of labelled rows:
``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` documents by hash order of their ids and
``SAMPLE_WINDOWS`` windows of each, drawn over the whole text.  Scoring is a map
over Arrow batches; the model is the only thing sent to the tasks and has a fixed
size bound (``MAX_WORDS``, ``MAX_GRAMS``).

Cases: NULL and empty texts are one window without words and still get a score;
short texts are one window; repeated rows score alike; ids repeated in the labels
count as toxic if one row says so; labels that are NULL are not used; without any
usable label of one kind the score is the share of toxic labels (0.5 without
labels); other columns of the documents are carried along.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.common import crc_remainder, hash_sample, small_batches, text_passes

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1_000, 2_000, 5
MAX_WORDS, MAX_GRAMS = 20_000, 20_000
WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, GRAM_DIM = 8, 10, 10
THRESHOLD = 0.3
#: Share of inputs left out in training; weight decay per unit of learning rate.
DROP, DECAY = 0.25, 0.1
#: Windows of one training step, and steps of a round at least.
BATCH, ROUND_STEPS = 256, 20
#: Words whose inputs a Python worker keeps; then only those of the texts at hand stay.
CACHE_WORDS = 100_000
#: Windows in one pass of the recurrent layers, in training and over whole texts.
PASS_WINDOWS, TEXT_WINDOWS = 4_096, 1_024
#: Bytes of text that a task scores at a time; a longer text by itself.
SCORED_BYTES = 400_000

# Everything but letters, digits and characters beyond ASCII parts words.
_PART = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_PART).split() if text else []


def grams_of(word: bytes) -> list[str]:
    marked = f"^{word.decode(errors='replace')}$"
    return [marked[i : i + k] for k in (3, 4) for i in range(max(1, len(marked) - k + 1))]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover all ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    if starts[-1] + WINDOW < n:
        starts.append(n - WINDOW)
    return starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    words: dict[bytes, int]
    grams: dict[str, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    def gram_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Known grams of all words, one after the other, and where each word's begin."""
        get, flat, cuts = self.grams.get, array("i"), array("q", [0])
        for word in words:
            flat.extend(g for g in map(get, grams_of(word)) if g is not None)
            cuts.append(len(flat))
        return np.array(flat, np.int64), np.array(cuts)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Word vector and mean gram vector of each word, side by side."""
        flat, cuts = self.gram_ids(words)
        own = self.p["word"][[self.words.get(w, 0) for w in words]]
        return np.concatenate([own, _means(self.p["gram"], flat, cuts)], axis=1)


def _means(table: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Mean of the table's rows in every cut of ``flat``; zero where a cut is empty."""
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), table.shape[1]), np.float32)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(table[flat], cuts[:-1][full], axis=0) / sizes[full][:, None]
    return out


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of equal rows, column by column."""
    return np.stack([np.bincount(rows, v, size) for v in values.T], axis=1).astype(np.float32)


def gru(p: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over projected inputs (T, B, 3H); masked places keep the state."""
    steps, rows, h3 = x.shape
    hid = h3 // 3
    u, state, out, tape = p["u" + side], np.zeros((rows, hid), np.float32), np.empty((steps, rows, hid), np.float32), []
    whole = bool(mask.all())
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        inner = state @ u
        gates = _sigmoid(x[t, :, : 2 * hid] + inner[:, : 2 * hid])
        z, r = gates[:, :hid], gates[:, hid:]
        n = np.tanh(x[t, :, 2 * hid :] + r * inner[:, 2 * hid :])
        new = n + z * (state - n)
        if not whole:
            new = np.where(mask[t, :, None], new, state)
        if keep:
            tape.append((t, state, z, r, n, inner[:, 2 * hid :]))
        state = out[t] = new
    return out, tape


def pool(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights (T, B), pooled states and logits."""
    energy = np.where(mask, states @ p["att"], -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight *= mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return weight, pooled, pooled @ p["out"] + p["bias"][0]


def _gru_back(p: dict, g: dict, side: str, tape: list, d_states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    hid = d_states.shape[2]
    d_x = np.zeros((*d_states.shape[:2], 3 * hid), np.float32)
    carry = np.zeros(d_states.shape[1:], np.float32)
    for t, before, z, r, n, inner_n in reversed(tape):
        total = carry + d_states[t]
        live = mask[t, :, None]
        d_new = np.where(live, total, 0)
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (before - n) * z * (1 - z)
        d_r = d_n * inner_n * r * (1 - r)
        d_inner = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        g["u" + side] += before.T @ d_inner
        carry = np.where(live, d_new * z, total) + d_inner @ p["u" + side].T
    return d_x


def _train(model: Model, windows: list[list[bytes]], target: np.ndarray, rate: float, rng: np.random.Generator, adam: dict) -> None:
    """One round of Adam on the logistic loss over windows; ``adam`` keeps its moments between calls.

    Word and character inputs are left out at random, so neither is learnt by heart.
    """
    distinct = sorted({w for words in windows for w in words})
    number = {w: i for i, w in enumerate(distinct)}
    word_id = np.array([model.words.get(w, 0) for w in distinct])
    flat, cuts = model.gram_ids(distinct)
    rows = np.full((len(windows), WINDOW), -1, np.int64)
    for i, words in enumerate(windows):
        rows[i, : len(words)] = [number[w] for w in words]
    p, size = model.p, BATCH
    # A small sample is gone through more than once, so a round has ROUND_STEPS steps at least.
    turns = -(-ROUND_STEPS // -(-len(windows) // size))
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(turns)])
    for at in range(0, len(order), size):
        pick = order[at : at + size]
        ids, mask = rows[pick].T, (rows[pick] >= 0).T
        used, inverse = np.unique(np.where(mask, ids, 0), return_inverse=True)
        inverse = inverse.reshape(ids.shape)
        gram_n = cuts[used + 1] - cuts[used]
        own_cuts = np.concatenate([[0], np.cumsum(gram_n)])
        owner = np.repeat(np.arange(len(used)), gram_n)
        grams = flat[np.arange(own_cuts[-1]) - own_cuts[owner] + cuts[used][owner]]
        x = np.concatenate([p["word"][word_id[used]], _means(p["gram"], grams, own_cuts)], axis=1)
        drop = rng.random((len(used), 2)) > DROP
        kept = np.repeat(drop, (WORD_DIM, GRAM_DIM), axis=1).astype(np.float32)
        x *= kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        states, tapes, proj = [], [], {}
        for side in "fb":
            proj[side] = x @ p["w" + side] + p["c" + side]
            out, tape = gru(p, side, proj[side][inverse], mask, True)
            states.append(out)
            tapes.append(tape)
        both = np.concatenate(states, axis=2)
        weight, pooled, logit = pool(p, both, mask)
        d_logit = ((_sigmoid(logit) - target[pick]) / len(pick)).astype(np.float32)
        g["out"] += pooled.T @ d_logit
        g["bias"][0] += d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] += np.einsum("tb,tbh->h", d_energy, both)
        d_both = weight[:, :, None] * d_pooled[None] + d_energy[:, :, None] * p["att"]
        d_word = np.zeros_like(x)
        for side, tape, d in zip("fb", tapes, np.split(d_both, 2, axis=2)):
            d_x = _gru_back(p, g, side, tape, d, mask)
            summed = _sums(inverse[mask], d_x[mask], len(used))
            g["w" + side] += x.T @ summed
            g["c" + side] += summed.sum(axis=0)
            d_word += summed @ p["w" + side].T
        d_word *= kept
        g["word"] = _sums(word_id[used], d_word[:, :WORD_DIM], len(p["word"]))
        g["gram"] = _sums(grams, (d_word[:, WORD_DIM:] / np.maximum(gram_n, 1)[:, None])[owner], len(p["gram"]))
        g["word"][0] = 0  # words without a vector of their own
        adam["n"] = n = adam.get("n", 0) + 1
        for k, grad in g.items():
            m, v = adam.setdefault(k, (np.zeros_like(grad), np.zeros_like(grad)))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] *= 1 - DECAY * rate
            p[k] -= (rate / (1 - 0.9**n)) * m / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)


def train(windows: list[tuple[int, int, list[bytes]]]) -> Model:
    """Model from (document, label, words) windows.

    The first rounds take every window of a toxic text as toxic; then windows of
    toxic texts that the model finds clean, other than the text's worst, count as
    clean for the last rounds.
    """
    rng = np.random.default_rng(0)
    counts = Counter(w for _, _, words in windows for w in words)
    top = sorted((w for w, n in counts.items() if n >= 4), key=lambda w: (-counts[w], w))[: MAX_WORDS - 1]
    grams = Counter(g for w in counts for g in set(grams_of(w)))
    kept = sorted((g for g, n in grams.items() if n >= 4), key=lambda g: (-grams[g], g))[:MAX_GRAMS]
    dim, hid = WORD_DIM + GRAM_DIM, HIDDEN
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"word": 0.1 * rng.standard_normal((len(top) + 1, WORD_DIM)), "gram": 0.3 * rng.standard_normal((max(1, len(kept)), GRAM_DIM))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["word"][0] = 0
    for side in "fb":
        p |= {"w" + side: normal(dim, 3 * hid), "u" + side: normal(hid, 3 * hid), "c" + side: np.zeros(3 * hid, np.float32)}
    p |= {"att": normal(2 * hid), "out": normal(2 * hid), "bias": np.zeros(1, np.float32)}
    model = Model({w: i + 1 for i, w in enumerate(top)}, {g: i for i, g in enumerate(kept)}, p)
    docs = np.array([d for d, _, _ in windows])
    label = np.array([y for _, y, _ in windows], np.float32)
    words = [w for _, _, w in windows]
    adam: dict = {}
    for rate in (0.016, 0.016):
        _train(model, words, label, rate, rng, adam)
    for rate in (0.012, 0.008, 0.003):
        logit = Scorer(model).logits(words)
        worst: dict[int, float] = {}
        for d, x in zip(docs.tolist(), logit.tolist()):
            worst[d] = max(worst.get(d, -np.inf), x)
        is_worst = np.array([worst[d] for d in docs.tolist()]) == logit
        target = np.where((label > 0) & ((logit > 0) | is_worst), 1, 0).astype(np.float32)
        _train(model, words, target, rate, rng, adam)
    return model


class Scorer:
    """Logits of windows and texts; keeps a bounded cache of projected words."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[bytes, int] = {}
        self.rows = {side: np.zeros((1024, 3 * HIDDEN), np.float32) for side in "fb"}

    def _keep(self, words: set[bytes]) -> None:
        """Only these words stay in the cache."""
        kept = [w for w in self.place if w in words]
        at = np.array([self.place[w] for w in kept], np.int64)
        self.rows = {side: rows[at] for side, rows in self.rows.items()}
        self.place = dict(zip(kept, range(len(kept))))

    def _ids(self, words: list[bytes]) -> np.ndarray:
        distinct = set(words)
        if len(self.place) > CACHE_WORDS:
            self._keep(distinct)
        place, model = self.place, self.model
        new = list(distinct.difference(place))
        if new:
            have, need = len(place), len(place) + len(new)
            x = model.inputs(new)
            for side in "fb":
                if need > len(self.rows[side]):
                    grown = np.zeros((2 * need, 3 * HIDDEN), np.float32)
                    grown[:have] = self.rows[side][:have]
                    self.rows[side] = grown
                self.rows[side][have:need] = x @ model.p["w" + side] + model.p["c" + side]
            place.update(zip(new, range(have, need)))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def _passes(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
        out = np.empty(len(starts), np.float32)
        # Windows of like size share a pass, so short texts cost few steps.
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), most):
            pick = order[at : at + most]
            steps = max(1, int(sizes[pick].max()))
            place = np.arange(steps)[:, None]
            mask = place < sizes[pick]
            rows = ids[np.where(mask, place + starts[pick], 0)] if len(ids) else np.zeros(mask.shape, np.int64)
            p = self.model.p
            both = np.concatenate([gru(p, side, self.rows[side][rows], mask, False)[0] for side in "fb"], axis=2)
            out[pick] = pool(p, both, mask)[2]
        return out

    def logits(self, windows: list[list[bytes]]) -> np.ndarray:
        sizes = np.array([len(w) for w in windows], np.int64)
        ids = self._ids([w for words in windows for w in words])
        return self._passes(ids, np.cumsum(sizes) - sizes, sizes, PASS_WINDOWS)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of all windows of each text."""
        words = [words_of(t) for t in texts]
        sizes = [len(w) for w in words]
        ids = self._ids([w for ws in words for w in ws])
        starts, lengths, owner, base = [], [], [], 0
        for i, n in enumerate(sizes):
            own = window_starts(n)
            starts += [base + s for s in own]
            lengths += [min(WINDOW, n)] * len(own)
            owner.append(len(starts) - len(own))
            base += n
        found = self._passes(ids, np.array(starts), np.array(lengths), TEXT_WINDOWS)
        return np.maximum.reduceat(found, owner) if len(owner) else found


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None) -> Model | float:
    """Train on a bounded sample of the labelled rows for which ``usable`` holds (a column over the key)."""
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    if usable is not None:
        known = known.withColumn(key, F.col("k")).where(usable).drop(key)
    known = known.groupBy("k").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    kinds = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return float(next(iter(kinds), 0.5))
    picked = None
    for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = hash_sample(known.where(F.col("y") == kind), ["k"], most)
        picked = part if picked is None else picked.union(part)
    spark = docs.sparkSession
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows.
    chosen = spark.createDataFrame([tuple(r) for r in picked.collect()], "k long, y int")
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels_, windows = [], [], []
            for k, t, y in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "y"))):
                words = words_of(t)
                starts = window_starts(len(words))
                step = max(1, len(starts) // SAMPLE_WINDOWS)
                for s in starts[(k % step) :: step][:SAMPLE_WINDOWS]:
                    keys.append(k)
                    labels_.append(y)
                    windows.append(b" ".join(words[s : s + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels_, pa.int32()), pa.array(windows, pa.binary())], ["k", "y", "w"])

    rows = sample.mapInArrow(cut, "k long, y int, w binary").collect()
    rows = sorted((r.k, r.y, bytes(r.w).split()) for r in rows)
    if len({y for _, y, _ in rows}) < 2:
        return kinds[1] / sum(kinds.values())
    model = train(rows)
    # Scale of whole texts, weighted to the shares among all usable labels.
    whole = score(sample, model, "t", raw=True).select("y", "score").collect()
    z, y = np.array([r.score for r in whole]), np.array([r.y for r in whole])
    weight = np.where(y == 1, kinds[1] / max(1, y.sum()), kinds[0] / max(1, (1 - y).sum()))
    model.scale = _logistic(z, y, weight / weight.sum())
    return model


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by damped Newton steps; a small penalty keeps it finite."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        q = _sigmoid(np.clip(a * z + b, -30, 30))
        grad = x.T @ (weight * (q - y)) + np.array([1e-3 * a, 0])
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a), float(b)


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score", raw: bool = False, carry: bool = False) -> DataFrame:
    """Add the score of every whole text (or the raw largest logit); the text itself goes unless carried."""
    kept = [f for f in docs.schema.fields if f.name != out and (carry or f.name != text)]
    names = [f.name for f in kept]
    if not isinstance(model, Model):
        return docs.select(*names, F.lit(float(model)).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        slope, offset = scorer.model.scale
        for batch in batches:
            for a, b, texts in text_passes(batch.column(text), SCORED_BYTES):
                z = scorer.texts(texts).astype(float)
                if not raw:
                    z = _sigmoid(slope * z + offset)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(z, pa.float64())], [*names, out])

    return small_batches(docs).select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def learnable(key: str = "doc_id") -> Column:
    """Rows that a model may learn from: crc32 of the id modulo 4 is not 2."""
    return crc_remainder(key, 4) != 2

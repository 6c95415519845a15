"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

The inputs at each word are a hashed word embedding and the mean of hashed
embeddings of the word's character n-grams. Both directions run over windows of
``WINDOW`` words; attention pools the states of a window to one logit. Every
whole text is cut into overlapping windows, all of which are scored; the text's
score is calibrated from its highest window.

Training sees labels of whole texts only. Positives are first the windows of
toxic texts with the words or n-grams of the highest log odds between labels,
then those that the network itself holds likely, and the likeliest of each text. Gradients are worked out by hand;
steps are Adam's. The sample is bounded by ``TRAIN_ROWS`` per label and
``TRAIN_WINDOWS`` windows a round; scoring has no bound. The curve from logits to
scores is fitted on the same texts (keeping every fifth out for it found fewer
toxic texts: see the README).

Null texts and texts without a word get the score of an empty window. Equal
texts give equal scores; label, language, source and id are never inputs. A
doc_id that is repeated among the labels counts once, as toxic if any row says
so, and with the least of its texts. Texts are read whole, whatever their
length. Other columns may have any name; an empty table gives an empty result,
and without labels all texts get one score.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, crc_part, struct
from quoin.llm._subwords import gram_buckets

WINDOW, STRIDE = 24, 16
#: Bounds of the training sample: rows of each label, and windows of toxic texts in one round of the descent.
TRAIN_ROWS, TRAIN_WINDOWS = 1500, 6000
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN = 1 << 13, 1 << 14, 10, 10
#: Lengths of the character n-grams, word borders included.
SIZES = (3, 4, 5)
PREDICT_AT = 0.7
_WORD = re.compile(r"[^\W_]{1,32}")
_CACHE = 100_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; runs of over 32 are parted."""
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> range:
    """Starts of the overlapping windows over n words; the last window holds the last word."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class ToxicityModel:
    words: np.ndarray  # the last row of both embeddings is zero, for padding
    chars: np.ndarray
    inputs: list[np.ndarray]  # of each direction: (2 DIM, 3 HIDDEN), the gates z, r and n side by side
    biases: list[np.ndarray]
    states: list[np.ndarray]  # (HIDDEN, 3 HIDDEN)
    attention: np.ndarray  # (2 HIDDEN,)
    output: np.ndarray  # (2 HIDDEN,)
    shift: np.ndarray  # (1,)
    scale: tuple[float, float] = (1.0, 0.0)

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.chars, *self.inputs, *self.biases, *self.states, self.attention, self.output, self.shift]


def fresh_model(seed: int = 3) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    embed = lambda n: np.concatenate([rng.normal(0, 0.3, (n, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    zeros = np.zeros(3 * HIDDEN, np.float32)
    return ToxicityModel(embed(WORD_BUCKETS), embed(CHAR_BUCKETS), [draw(2 * DIM, 3 * HIDDEN), draw(2 * DIM, 3 * HIDDEN)], [zeros, zeros.copy()], [draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)], draw(2 * HIDDEN), draw(2 * HIDDEN), np.zeros(1, np.float32))


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, character buckets and the first of these, of each word."""
    ids, starts = gram_buckets(words, SIZES, CHAR_BUCKETS)
    whole = ids[starts, -1] % WORD_BUCKETS
    grams = ids[:, :-1]
    # A word shorter than the n-grams still has one: its whole, borders included.
    grams[starts, 0] = np.where(grams[starts, 0] < 0, ids[starts, -1], grams[starts, 0])
    held = grams >= 0
    counts = np.add.reduceat(held.sum(axis=1), starts)
    return whole, grams[held], np.concatenate([[0], np.cumsum(counts)[:-1]])


def _forward(model: ToxicityModel, gates: list[np.ndarray], mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows. gates: of each direction (windows, WINDOW, 3 HIDDEN); mask: which words are there."""
    n, h = len(mask), HIDDEN
    states = np.zeros((n, WINDOW, 2 * h), np.float32)
    for d in (0, 1):
        s = np.zeros((n, h), np.float32)
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            x, m = gates[d][:, t], mask[:, t, None]
            back = s @ model.states[d]
            zr = _sigmoid(x[:, : 2 * h] + back[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * back[:, 2 * h :])
            if keep is not None:
                keep.append((d, t, s, z, r, new, back[:, 2 * h :]))
            s = s + m * (1 - z) * (new - s)
            states[:, t, d * h : (d + 1) * h] = s
    e = np.where(mask > 0, states @ model.attention, -30)
    a = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    a /= a.sum(axis=1, keepdims=True) + 1e-9
    pooled = np.einsum("nt,nth->nh", a, states)
    if keep is not None:
        keep.append((states, a, pooled))
    return pooled @ model.output + model.shift[0]


def _gradients(model: ToxicityModel, gates: list[np.ndarray], mask: np.ndarray, wrong: Callable) -> tuple[list[np.ndarray], dict]:
    """Gradients of the inputs of both directions and of the dense parameters; wrong(logits) is the loss's gradient."""
    keep: list = []
    logits = _forward(model, gates, mask, keep)
    states, a, pooled = keep.pop()
    g, h = wrong(logits).astype(np.float32), HIDDEN
    grads = {"output": g @ pooled, "shift": g.sum(keepdims=True), "states": [np.zeros_like(u) for u in model.states]}
    dp = g[:, None] * model.output
    da = np.einsum("nth,nh->nt", states, dp)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    grads["attention"] = np.einsum("nt,nth->h", de, states)
    ds = a[:, :, None] * dp[:, None] + de[:, :, None] * model.attention
    dx = [np.zeros_like(x) for x in gates]
    carry = np.zeros((len(mask), h), np.float32)
    before = 1
    for d, t, s, z, r, new, cand in reversed(keep):
        if d != before:
            carry, before = np.zeros_like(carry), d
        total, m = carry + ds[:, t, d * h : (d + 1) * h], mask[:, t, None]
        step = total * m
        dn = step * (1 - z) * (1 - new * new)
        dz = step * (s - new) * z * (1 - z)
        dr = dn * cand * r * (1 - r)
        dx[d][:, t] = np.concatenate([dz, dr, dn], axis=1)
        back = np.concatenate([dz, dr, dn * r], axis=1)
        grads["states"][d] += s.T @ back
        carry = total * (1 - m * (1 - z)) + back @ model.states[d].T
    return dx, grads


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.steps, self.held = rate, 0, {}

    def __call__(self, key: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.held.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(v[at] / (1 - 0.99**self.steps)) + 1e-6)


class _Texts:
    """Texts as windows over a table of their distinct words."""

    def __init__(self, texts: list[str | None]):
        split = [words_of(t) for t in texts]
        names = sorted(set().union(*split)) if split else []
        at = {w: i for i, w in enumerate(names)}
        self.whole, grams, first = word_rows(names) if names else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.grams = np.split(grams, first[1:]) if names else []
        rows, owners = [], []
        for i, words in enumerate(split):
            ids = np.array([at[w] for w in words], dtype=np.int64)
            for s in window_starts(len(ids)):
                part = ids[s : s + WINDOW]
                rows.append(np.pad(part, (0, WINDOW - len(part)), constant_values=-1))
                owners.append(i)
        self.windows, self.owners = np.array(rows).reshape(-1, WINDOW), np.array(owners, dtype=np.int64)

    def batch(self, model: ToxicityModel, pick: np.ndarray):
        """Inputs of windows, with what their gradients need."""
        ids = self.windows[pick]
        used, place = np.unique(ids, return_inverse=True)
        place = place.reshape(ids.shape)
        words = [w for w in used.tolist() if w >= 0]
        shift = int(used[0] == -1) if len(used) else 0
        grams = np.concatenate([self.grams[w] for w in words]) if words else np.zeros(0, np.int64)
        sizes = np.array([len(self.grams[w]) for w in words], dtype=np.int64)
        x = np.zeros((len(used), 2 * DIM), np.float32)
        if words:
            x[shift:, :DIM] = model.words[self.whole[words]]
            x[shift:, DIM:] = np.add.reduceat(model.chars[grams], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
        return x, place, (ids >= 0).astype(np.float32), words, grams, sizes, shift


def _logits(model: ToxicityModel, texts: _Texts, pick: np.ndarray, size: int = 1024) -> np.ndarray:
    out = []
    for i in range(0, len(pick), size):
        x, place, mask, *_ = texts.batch(model, pick[i : i + size])
        out.append(_forward(model, [(x @ w + b)[place] for w, b in zip(model.inputs, model.biases, strict=True)], mask))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _epoch(model: ToxicityModel, adam: _Adam, texts: _Texts, pick: np.ndarray, labels: np.ndarray, rng, size: int = 128) -> None:
    order = rng.permutation(len(pick))
    for i in range(0, len(order), size):
        part = order[i : i + size]
        y = labels[part]
        x, place, mask, words, grams, sizes, shift = texts.batch(model, pick[part])
        gates = [(x @ w + b)[place] for w, b in zip(model.inputs, model.biases, strict=True)]
        dx, grads = _gradients(model, gates, mask, lambda z, y=y: (_sigmoid(z) - y) / len(y))
        adam.steps += 1
        dwords = np.zeros_like(x)
        for d in (0, 1):
            dg = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(dg, place.ravel(), dx[d].reshape(-1, 3 * HIDDEN))
            dwords += dg @ model.inputs[d].T
            adam(f"in{d}", model.inputs[d], x.T @ dg)
            adam(f"bias{d}", model.biases[d], dg.sum(axis=0))
            adam(f"state{d}", model.states[d], grads["states"][d])
        for name in ("attention", "output", "shift"):
            adam(name, getattr(model, name), grads[name])
        if words:
            rows, back = np.unique(texts.whole[words], return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, back, dwords[shift:, :DIM])
            adam("words", model.words, g, rows)
            rows, back = np.unique(grams, return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, back, np.repeat(dwords[shift:, DIM:] / sizes[:, None], sizes, axis=0))
            adam("chars", model.chars, g, rows)


def _seeds(held: _Texts, labels: np.ndarray) -> np.ndarray:
    """First guess of each window's toxicity: the largest log odds of a word or n-gram between toxic and clean texts."""
    n_words = len(held.whole)
    grams, sizes = np.concatenate(held.grams), np.array([len(x) for x in held.grams])
    texts_with = np.zeros((2, WORD_BUCKETS + CHAR_BUCKETS))
    for i, label in enumerate(labels):
        here = np.unique(held.windows[held.owners == i])
        here = here[here >= 0]
        if len(here):
            ids = np.concatenate([held.whole[here], *[held.grams[w] + WORD_BUCKETS for w in here]])
            texts_with[int(label)][np.unique(ids)] += 1
    totals = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((texts_with[1] + 0.5) / (totals[1] + 1)) - np.log((texts_with[0] + 0.5) / (totals[0] + 1))
    odds[texts_with[1] < 2] = -9
    owner = np.repeat(np.arange(n_words), sizes)
    best = odds[held.whole].copy()
    np.maximum.at(best, owner, odds[grams + WORD_BUCKETS])
    return np.append(best, -9)[held.windows].max(axis=1)  # padding is the last


def train(texts: list[str], labels: list[int], seed: int = 5, rounds: int = 5, least_steps: int = 400) -> ToxicityModel:
    """Learn from labelled whole texts; without both labels the score stays at the share of label 1."""
    model, rng = fresh_model(seed), np.random.default_rng(seed)
    labels_at = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        model.output[:] = 0
        model.scale = (0.0, 8.0 if labels and labels[0] else -8.0)
        return model
    held = _Texts(texts)
    toxic = labels_at[held.owners] == 1
    bad, good = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    adam = _Adam(0.02)
    for round_ in range(rounds):
        z = _logits(model, held, bad) if round_ else _seeds(held, labels_at)[bad] - 3
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, held.owners[bad], z)
        # Windows that look toxic, and the likeliest of each toxic text.
        chosen = rng.permutation(bad[(z > 0) | (z >= best[held.owners[bad]])])[:TRAIN_WINDOWS]
        # A small sample is gone through more often, each time with other clean windows.
        size = max(500, 2 * len(chosen))
        for _ in range(max(1, least_steps // rounds // ((len(chosen) + size) // 128 + 1))):
            clean = rng.permutation(good)[:size]
            _epoch(model, adam, held, np.concatenate([chosen, clean]), np.concatenate([np.ones(len(chosen)), np.zeros(len(clean))]), rng)
        adam.rate *= 0.2 ** (1 / rounds)
    z = _logits(model, held, np.arange(len(held.windows)))
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, held.owners, z)
    model.scale = _calibrated(top, labels_at)
    return model


def _calibrated(top: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the highest window logits, by gradient steps."""
    slope, shift = 1.0, 0.0
    x = (top - top.mean()) / (top.std() + 1e-6)
    for _ in range(500):
        g = _sigmoid(slope * x + shift) - labels
        slope -= 0.5 * float((g * x).mean() + 1e-3 * slope)
        shift -= 0.5 * float(g.mean())
    return slope / (top.std() + 1e-6), shift - slope * top.mean() / (top.std() + 1e-6)


class Scorer:
    """Scores whole texts; keeps the gate inputs of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.rows = model, {}
        self.weights = [(w, b) for w, b in zip(model.inputs, model.biases, strict=True)]
        self.gates = [np.zeros((1 << 12, 3 * HIDDEN), np.float32) for _ in (0, 1)]
        for g, (_, b) in zip(self.gates, self.weights, strict=True):
            g[0] = b  # row 0 is padding

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        whole, grams, first = word_rows(words)
        sizes = np.diff(np.append(first, len(grams)))
        x = np.concatenate([self.model.words[whole], np.add.reduceat(self.model.chars[grams], first) / sizes[:, None]], axis=1)
        begin, end = len(self.rows) + 1, len(self.rows) + 1 + len(words)
        for d, (w, b) in enumerate(self.weights):
            while end > len(self.gates[d]):
                self.gates[d] = np.concatenate([self.gates[d], np.zeros_like(self.gates[d])])
            self.gates[d][begin:end] = x @ w + b
        self.rows.update(zip(words, range(begin, end), strict=True))

    def __call__(self, texts: list[str | None], size: int = 1024) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.rows) > _CACHE:
            self.rows.clear()
        self._learn(list(set().union(*split).difference(self.rows)))
        rows, owners = [], []
        for i, words in enumerate(split):
            starts = window_starts(len(words))
            ids = np.zeros((len(starts) - 1) * STRIDE + WINDOW, dtype=np.int32)
            ids[: len(words)] = list(map(self.rows.__getitem__, words))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE])
            owners.append(np.full(len(starts), i))
        windows, owner = np.concatenate(rows), np.concatenate(owners)
        top = np.full(len(texts), -np.inf)
        for i in range(0, len(windows), size):
            part = windows[i : i + size]
            z = _forward(self.model, [g[part] for g in self.gates], (part > 0).astype(np.float32))
            np.maximum.at(top, owner[i : i + size], z)
        slope, shift = self.model.scale
        return _sigmoid(slope * top + shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out: tuple[int, int] | None = None) -> ToxicityModel:
    """Train on at most ``rows`` labelled rows of each label, chosen by a hash of doc_id."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        usable = usable.filter(crc_part("doc_id", held_out[0]) != held_out[1])
    order = [F.xxhash64("doc_id", F.lit(29)), F.col("doc_id")]
    chosen = [r for kind in (0, 1) for r in usable.filter(F.col("toxic") == kind).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(*order).limit(rows).collect()]
    if not chosen:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic int")
    got = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").filter(F.col("text").isNotNull()).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in got], [r["toxic"] for r in got])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    schema = struct(("doc_id", T.LongType()), ("score", T.DoubleType()), ("predicted", T.IntegerType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB of weights, whatever the input

    def make():
        score = Scorer(shared.value)

        def step(cols):
            got = score(cols["text"]).tolist()
            return {"doc_id": cols["doc_id"], "score": got, "predicted": [int(s >= PREDICT_AT) for s in got]}

        return step

    return arrow_map(docs, ["doc_id", "text"], make, schema)

"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of its words; a word is the mean of the embeddings of its
hashed character n-grams (with word borders) and of itself. A linear softmax on
the mean gives the languages. Embeddings and weights are learnt together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; one
temperature, fitted on rows kept out of the descent, calibrates the scores.

Scores of a word are linear in its embedding, so each distinct word is scored
once while it stays in a worker's cache. Null texts and texts without a letter
get ``und`` with score 0. A text is rejected when it is ``und`` or when its
calibrated score is below ``reject_below``. Equally likely languages go to the
first by name. Texts are scored whole, whatever their length; repeated rows give
repeated results; an empty table gives an empty one; other columns may have any
name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, crc_part, release, sample_ids, slices, struct
from quoin.llm._subwords import gram_lists, gram_means

UNDETERMINED = "und"
#: Bounds of the training sample: rows, and words of the two snippets that each row gives.
TRAIN_ROWS, SNIPPETS = 4000, (40, 4)
BUCKETS, DIM = 1 << 15, 12
#: Lengths of the character n-grams, word borders included.
SIZES = (2, 3, 4)
#: Calibrated scores below this are rejected: no language is likelier than all others together.
REJECT_BELOW = 0.4
_LETTERS = re.compile(r"[^\W\d_]{1,40}")
_WORD_CACHE = 100_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; runs of over 40 are parted."""
    return _LETTERS.findall(text.lower()) if text else []


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # language scores of each bucket: embeddings times weights
    bias: np.ndarray
    temperature: float
    reject_below: float = REJECT_BELOW


class Scorer:
    """Applies a model, keeping the scores of words."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows, self.scores = model, {}, np.zeros((1 << 12, len(model.languages)), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        model, rows = self.model, self.rows
        if len(rows) > _WORD_CACHE:
            rows.clear()
        out, split = [], [words_of(t) for t in texts]
        new = list(set().union(*split).difference(rows))
        while len(rows) + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[len(rows) : len(rows) + len(new)] = gram_means(new, SIZES, model.table)
        rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
        for words in split:
            if not any(c.isalpha() for w in words for c in w):
                out.append((UNDETERMINED, 0.0, True))
                continue
            at = np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
            logits = (self.scores[at].mean(axis=0, dtype=np.float64) + model.bias) / model.temperature
            shares = np.exp(logits - logits.max())
            shares /= shares.sum()
            best = int(shares.argmax())
            out.append((model.languages[best], float(shares[best]), bool(shares[best] < model.reject_below)))
        return out


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 3, rate: float = 0.6) -> LanguageModel:
    """Learn from labelled texts: every text gives snippets of 4 to 40 words, so that short texts are learnt too."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    samples, wanted = [], []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        for size in SNIPPETS if words else ():
            start = int(rng.integers(0, max(1, len(words) - size + 1)))
            samples.append(words[start : start + size])
            wanted.append(languages.index(label))
    known = gram_lists(sorted(set().union(*samples)), SIZES, BUCKETS)
    n = len(languages)
    wanted_at = np.array(wanted, dtype=np.int64)
    weight = len(wanted_at) / (n * np.maximum(1, np.bincount(wanted_at, minlength=n))) if len(wanted_at) else np.ones(n)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    kept_out = np.arange(len(samples)) % 5 == 4
    order, size = np.flatnonzero(~kept_out), 64
    flat = [np.concatenate([known[w] for w in s]) for s in samples]
    share = [np.concatenate([np.full(len(known[w]), 1 / len(known[w]) / len(s)) for w in s]) for s in samples]

    def logits(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, parts = np.concatenate([flat[i] for i in pick]), np.concatenate([share[i] for i in pick])
        owner = np.repeat(np.arange(len(pick)), [len(flat[i]) for i in pick])
        mean = np.add.reduceat(embed[ids] * parts[:, None], np.cumsum([0] + [len(flat[i]) for i in pick[:-1]]))
        return ids, parts, owner, mean

    def probabilities(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            ids, parts, owner, mean = logits(pick)
            grad = probabilities(mean @ soft + bias)
            grad[np.arange(len(pick)), wanted_at[pick]] -= 1
            grad *= (weight[wanted_at[pick]] / len(pick))[:, None]
            back = grad @ soft.T
            soft -= step * mean.T @ grad
            bias -= step * grad.sum(axis=0)
            # The mean spreads a gradient thinly over its n-grams; embeddings take a longer step.
            np.subtract.at(embed, ids, (step * 60) * parts[:, None] * back[owner])
    temperature = 1.0
    held = np.flatnonzero(kept_out)
    if len(held):
        z = np.concatenate([logits(held[i : i + 256])[3] for i in range(0, len(held), 256)]) @ soft + bias
        losses = {t: -np.log(np.maximum(probabilities(z / t)[np.arange(len(held)), wanted_at[held]], 1e-12)).mean() for t in np.geomspace(0.25, 4, 33)}
        temperature = float(min(losses, key=losses.get))
    return LanguageModel(languages, (embed @ soft).astype(np.float32), bias, temperature)


def fit_language_model(docs: DataFrame, rows: int = TRAIN_ROWS, held_out: tuple[int, int] | None = None) -> LanguageModel:
    """Train on at most ``rows`` rows with text and lang, chosen by a hash of doc_id.

    ``held_out`` = (parts, part) leaves out rows whose crc32(doc_id as text) has that
    remainder. The sample's ids are found first, so that only its texts leave the scan.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out:
        labelled = labelled.filter(crc_part("doc_id", held_out[0]) != held_out[1])
    ids = [r[0] for r in sample_ids(labelled, "doc_id", rows, 101).collect()]
    if not ids:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    got = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "lang").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


PREDICTED = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every whole text.

    Without a trained language everything is ``und``. Equal texts give equal rows.
    """
    schema = struct(("doc_id", T.LongType()), *PREDICTED)

    def make():
        score = Scorer(model)

        def step(cols):
            if model.languages:
                got = score(cols["text"])
            else:
                got = [(UNDETERMINED, 0.0, True)] * len(cols["text"])
            return {"doc_id": cols["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return step

    return arrow_map(docs, ["doc_id", "text"], make, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all their columns as they were."""
    kind = docs.schema

    def run(batches):
        import pyarrow as pa

        score = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                got = score(texts) if model.languages else [(UNDETERMINED, 0.0, True)] * len(texts)
                yield part.filter(pa.array([not g[2] for g in got]))
        del score
        release()

    return docs.mapInArrow(run, kind)


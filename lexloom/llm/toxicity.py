"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams, so a misspelling shares most vectors with the word it hides.
A passage (WINDOW words) is the average of its subwords' embeddings; a softmax over (clean, toxic) reads it, and a
document scores as its most toxic passage. Embeddings and softmax are learnt together by Adam: first on whole
documents, then on passages, where a toxic document stands for its worst passage and a clean one for all that
looked worst so far (multiple-instance learning, since a few words make a long document toxic).

Nothing but the text is read for a score. A null or empty text has one empty passage and scores as the bias says.
Repeated rows and rows with repeated ids each get their own equal score; other columns are left alone, whatever their
names. Very long texts are read whole, passage by passage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import as_text, labelled_sample, slices

#: Bound on the labelled texts of each class that the model is fitted on.
PER_CLASS = 1000
BUCKETS, DIM, WINDOW, NGRAMS = 1 << 18, 6, 2, (3, 4, 5, 6)
STEPS, RATE, DECAY, SEED = (8, 25, 25, 25, 25), 0.08, 1e-4, 7
#: Subwords of fewer texts of the sample have no embedding: names and numbers of single texts would else be learnt by heart.
LEAST_TEXTS = 3
#: Subwords that a passage counts as having at least, so that a few words don't weigh more alone than among others.
FULL = 20 * WINDOW
THRESHOLD = 0.7

_SPACE = np.full(256, 0, np.uint8)
_SPACE[[b for b in range(128) if not chr(b).isalnum()]] = 1
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of every character n-gram (UTF-8, lower case) that no word boundary cuts, the word it is in, and the
    number of words. A boundary may be the first or the last character of an n-gram."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    gap = _SPACE[raw]
    chars = raw.astype(np.uint32)
    chars[gap == 1] = 32
    starts = (gap[:-1] == 1) & (gap[1:] == 0)
    n_words = int(starts.sum())
    if not n_words:
        return np.empty(0, np.int32), np.empty(0, np.int32), 0
    word = np.cumsum(np.r_[starts, False], dtype=np.int32)  # an n-gram belongs to the word that its first boundary or character opens
    h = (chars ^ np.uint32(0x811C9DC5)) * _MIX[0]
    whole = np.ones(len(chars), bool)  # no boundary between the first and the last character
    buckets, owners = [], []
    for n in range(2, max(NGRAMS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ chars[n - 1 :]) * _MIX[n - 1]
        h ^= h >> np.uint32(15)
        if n > 2:
            whole = whole[:m] & (gap[n - 2 : n - 2 + m] == 0)
        if n in NGRAMS:
            at = np.flatnonzero(whole[:m])
            buckets.append((h[at] % np.uint32(BUCKETS)).astype(np.int32))
            owners.append(word[at])
    kind = np.uint16 if n_words <= 0xFFFF else np.int32
    return np.concatenate(buckets), np.maximum(np.concatenate(owners) - 1, 0).astype(kind), n_words


def passage_starts(n_words: int) -> np.ndarray:
    """Passages of WINDOW words, half overlapping."""
    return np.arange(0, max(1, n_words - WINDOW + 1), max(1, WINDOW // 2))


class Toxicity:
    """The fitted model: ``emb`` (DIM x BUCKETS), ``out`` (DIM x 2), ``bias`` (2)."""

    def __init__(self, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.emb, self.out, self.bias = emb, out, bias
        #: The averaged bag and the softmax are linear, so a bucket's part in the logit is one number.
        self.part = ((out[:, 1] - out[:, 0]) @ emb).astype(np.float32)
        self.offset = float(bias[1] - bias[0])

    def passages(self, buckets: np.ndarray, owners: np.ndarray, n_words: int) -> np.ndarray:
        """The toxic-against-clean logit of each passage."""
        if not n_words:
            return np.array([self.offset])
        sums = np.r_[0, np.cumsum(np.bincount(owners, self.part[buckets], n_words))]
        counts = np.r_[0, np.cumsum(np.bincount(owners, minlength=n_words))]
        start = passage_starts(n_words)
        end = np.minimum(start + WINDOW, n_words)
        return (sums[end] - sums[start]) / np.maximum(counts[end] - counts[start], FULL) + self.offset

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.passages(*subwords(text)).max(), -40, 40))))


def fit(sample: list[tuple[tuple, int]]) -> Toxicity:
    """Train on (subwords of a text, label) pairs; without both classes the model says clean for all."""
    rng = np.random.default_rng(SEED)
    labels = np.array([y for _, y in sample], np.int64)
    emb, out, bias = rng.normal(0, 0.1, (DIM, BUCKETS)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    if len(set(labels.tolist())) < 2:
        return Toxicity(np.zeros_like(emb), out, np.array([3.0, -3.0], np.float32))
    # subwords of few texts say nothing that another text could share; their embeddings stay zero
    seen = np.zeros(BUCKETS, np.int32)
    for (b, _, _), _ in sample:
        seen[np.unique(b)] += 1
    live = (seen >= LEAST_TEXTS).astype(np.float32)
    emb *= live
    state = [np.zeros_like(x) for x in (emb, out, bias) for _ in range(2)]
    t = 0
    for stage, steps in enumerate(STEPS):
        bags, ys = [], []
        model = Toxicity(emb, out, bias)
        for (b, o, n), label in sample:
            if stage == 0 or not n:
                picks = [(0, n)]
            else:
                start = passage_starts(n)
                order = np.argsort(-model.passages(b, o, n), kind="stable")
                chosen = order[:1] if label else np.r_[order[:6], rng.integers(0, len(start), 2)]
                picks = [(start[i], start[i] + WINDOW) for i in chosen]
            for lo, hi in picks:
                inside = b[(o >= lo) & (o < hi)]
                u, c = np.unique(inside[live[inside] > 0], return_counts=True)
                bags.append((u, c.astype(np.float32) / max(len(inside), FULL)))
                ys.append(label)
        y = np.array(ys)
        row = np.repeat(np.arange(len(bags)), [len(u) for u, _ in bags])
        col, value = np.concatenate([u for u, _ in bags]), np.concatenate([v for _, v in bags])
        del bags
        used, local = np.unique(col, return_inverse=True)
        weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)[:, None] / len(y)
        for _ in range(steps):
            t += 1
            mean = np.stack([np.bincount(row, e[used][local] * value, len(y)) for e in emb], 1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p * weight
            back = g @ out.T
            down = np.zeros_like(emb)
            for d in range(DIM):
                down[d, used] = np.bincount(local, back[row, d] * value, len(used))
            for k, (x, dx) in enumerate(zip((emb, out, bias), (down + DECAY * emb / BUCKETS, mean.T @ g, g.sum(0)), strict=True)):
                m, v = state[2 * k], state[2 * k + 1]
                m *= 0.9
                m += 0.1 * dx
                v *= 0.99
                v += 0.01 * dx * dx
                x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            emb *= live
    return Toxicity(emb, out, bias)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Toxicity:
    return fit(labelled_sample(docs, labels, "toxic", per_class, subwords))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score; one row per row of docs. The model's size doesn't depend on docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.emb, model.out, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Toxicity(*shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(x) for x in as_text(batch.column(1))], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def predicted(score: F.Column, threshold: float = THRESHOLD) -> F.Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")

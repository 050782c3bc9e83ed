"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text becomes a tf-idf vector over hashed features of its tokens: the whole word, its first STEM letters, the
punctuation around it, and the shape of the case; a token that only repeats the one before it counts as such instead.
Of a token over LONG characters (a blob, or prose without spaces) every GRAM characters in a row count as a token, so
that all of it is read. A truncated singular value decomposition of the labelled sample gives the latent axes. The
labelled vectors, unit length, are broadcast (at most 2 * PER_CLASS rows of RANK numbers). Every document is projected
and compared with all of them by exact blocked matrix products; the K nearest vote with their similarity, and each
class's votes are weighted by its share of the sample, so that the score doesn't lean to the larger class.

Nothing but the text is read for a score. Null or empty texts, and texts far from every labelled one, get the score
PRIOR. Without labels of both classes all documents get PRIOR. Repeated rows get equal scores. Very long texts are read in
parts, with the same counts. Other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import as_text, fresh, labelled_sample, slices

#: Bound on the labelled texts of each class that are broadcast.
PER_CLASS = 2000
RANK, K, SHARPNESS, PRIOR, SEED = 48, 15, 8.0, 0.5, 5
#: Hashed features: letters of tokens, then punctuation and case, which words can't collide with.
WORDS, MARKS = 3072, 1024
FEATURES = WORDS + MARKS
#: The place of a feature that a token doesn't have; it isn't counted.
NONE = FEATURES
#: Features of a token that is the same as the one before.
REPEAT = (FEATURES - 3, NONE, FEATURES - 2, FEATURES - 1)
STEM, LONG, GRAM = 5, 80, 3
THRESHOLD, BLOCK, KEPT_TOKENS = 0.5, 64, 200_000

_TOKEN = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def _hash(text: str, salt: int) -> int:
    h = 2166136261 ^ salt
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h ^ (h >> 15)


def pieces(text: str) -> Iterator[str]:
    """The tokens of a text, or all character n-grams of those that are long."""
    for token in text.split():
        if len(token) <= LONG:
            yield token
        else:
            for i in range(len(token) - GRAM + 1):
                yield token[i : i + GRAM]


def token_features(token: str) -> tuple[int, int, int, int]:
    """First letters; the whole word where it is longer; punctuation before and after; shape of the case with digits."""
    before, core, after = _TOKEN.match(token).groups()
    word = core.lower()
    shape = "0" if any(c.isdigit() for c in core) else "U" if len(core) > 1 and core.isupper() else "T" if core[:1].isupper() else "l" if core.islower() else "x"
    return _hash(word[:STEM], 1) % WORDS, _hash(word, 3) % WORDS if len(word) > STEM else NONE, WORDS + _hash(before + "\0" + after, 2) % (MARKS - 8), FEATURES - 8 + "0UTlx".index(shape)


class Tokens:
    """Features of tokens by number; starts anew when KEPT_TOKENS are known."""

    def __init__(self):
        self._known: dict[str, int] = {}
        self._table = np.zeros((KEPT_TOKENS, 4), np.int32)

    def counts(self, texts: list[str]) -> np.ndarray:
        """len(texts) x FEATURES."""
        out = np.zeros((len(texts), FEATURES), np.float32)
        for row, text in zip(out, texts, strict=True):
            tokens, before = pieces(text), None
            while part := list(islice(tokens, 20_000)):
                if len(self._known) + len(part) > KEPT_TOKENS:
                    self._known.clear()
                numbers = np.array([self._number(t) for t in part], np.int64)
                found = self._table[numbers]
                found[np.r_[part[0] == before, numbers[1:] == numbers[:-1]]] = REPEAT
                before = part[-1]
                row += np.bincount(found.ravel(), minlength=FEATURES + 1)[:FEATURES].astype(np.float32)
        return out

    def _number(self, token: str) -> int:
        if (n := self._known.get(token)) is None:
            n = self._known[token] = len(self._known)
            self._table[n] = token_features(token)
        return n


class Quality:
    """``idf`` (FEATURES), ``axes`` (FEATURES x RANK), ``vectors`` (n x RANK, unit length), ``labels`` (n)."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels = idf.astype(np.float64), axes.astype(np.float64), vectors.astype(np.float64), labels
        share = np.bincount(labels, minlength=2) if len(labels) else np.ones(2)
        self.weight = np.where(labels == 1, 1 / max(share[1], 1), 1 / max(share[0], 1)) if len(labels) else np.empty(0)
        self.fitted = len(set(labels.tolist())) == 2

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts.astype(np.float64)) * self.idf) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), PRIOR)
        if not self.fitted:
            return out
        for at in range(0, len(counts), BLOCK):
            x = self.project(counts[at : at + BLOCK])
            # 64-bit products, rounded, are the same in blocks of any size, so that equal texts score alike
            similar = np.round(x @ self.vectors.T, 9)
            k = min(K, similar.shape[1])
            # ties of similarity at the K-th place: the lower row of the sample, as the order is that of the ids
            near = np.argsort(-similar, axis=1, kind="stable")[:, :k]
            s = np.maximum(np.take_along_axis(similar, near, 1), 0) ** SHARPNESS * self.weight[near]
            total = s.sum(1)
            out[at : at + BLOCK] = np.where(total > 1e-12, (s * self.labels[near]).sum(1) / np.maximum(total, 1e-12), PRIOR)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1).astype(x.dtype)


def fit(sample: list[tuple[np.ndarray, int]]) -> Quality:
    """Of (feature numbers, counts) and labels: idf, latent axes by randomised SVD, and the labelled vectors."""
    labels = np.array([y for _, y in sample], np.int64)
    counts = np.zeros((len(sample), FEATURES), np.float32)
    for row, ((where, n), _) in zip(counts, sample, strict=True):
        row[where] = n
    if not len(sample):
        return Quality(np.ones(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
    idf = np.log((1 + len(sample)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.3
    x = _unit((np.log1p(counts) * idf).astype(np.float32))
    rng = np.random.default_rng(SEED)
    q = x.T @ rng.normal(size=(len(x), min(RANK + 12, FEATURES))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :RANK].astype(np.float32)
    model = Quality(idf, axes, np.zeros((len(x), axes.shape[1]), np.float32), labels)
    model.vectors = _unit(x.astype(np.float64) @ axes)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Quality:
    tokens = Tokens()

    def keep(text: str) -> tuple[np.ndarray, np.ndarray]:
        row = tokens.counts([text])[0]
        where = np.flatnonzero(row)
        return where, row[where]

    return fit(labelled_sample(docs, labels, "quality", per_class, keep))


def score(docs: DataFrame, model: Quality, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score; with ``keep_text`` all columns of docs and a last one, the score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels))
    at = docs.columns.index("text") if keep_text else 1
    (last,) = fresh(docs, "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = Quality(*shared.value), Tokens()
        for batch in slices(batches):
            scores = np.concatenate([own.scores(tokens.counts(texts)) for i in range(0, batch.num_rows, BLOCK) if (texts := as_text(batch.column(at).slice(i, BLOCK)))] or [np.empty(0)])
            scores = pa.array(np.clip(scores, 0, 1), pa.float64())
            if keep_text:
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, last])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    if keep_text:
        return docs.mapInArrow(run, docs.select("*").schema.add(last, "double"))
    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def accept(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below ``threshold``."""
    scored = score(docs, model, keep_text=True)
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)

"""Training and inference: skip-gram with negative sampling on any (word, context) pairs, relation weights, pair
encoders.

Pairs are trained on where they lie: each task starts from the parameters that were broadcast, runs mini-batches over
its rows and gives its parameters' changes, row by row; these are averaged by word with partial aggregation. So an
epoch is one pass. Vocabularies are bounded (MOST_PARAMETERS), as the parameters go to every worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.vectors import attention_pool

#: Numbers that a model may have to be sent to the workers.
MOST_PARAMETERS = 200_000_000
#: Rows among which negatives are shuffled.
ROWS_SHUFFLED = 100_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Embeddings:
    words: list[str]
    contexts: list[str]
    vectors: np.ndarray
    context_vectors: np.ndarray
    losses: list[float] = field(default_factory=list)

    def vector(self, word: str) -> np.ndarray | None:
        return self.vectors[self.words.index(word)] if word in self.words else None


def initial(n_words: int, n_contexts: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words uniform within half a unit divided by the width, contexts zero."""
    rng = np.random.default_rng(seed)
    return ((rng.random((n_words, width)) - 0.5) / width).astype(np.float32), np.zeros((n_contexts, width), np.float32)


def _move(rows: np.ndarray, ids: np.ndarray, gradients: np.ndarray, rate: float) -> None:
    """Add a batch's gradients; what one row gets is divided by the root of how often it gets some, and no step is
    longer than 1, so that frequent rows don't overshoot."""
    own, place, n = np.unique(ids, return_inverse=True, return_counts=True)
    total = np.zeros((len(own), rows.shape[1]))
    np.add.at(total, place, gradients)
    total *= rate / np.sqrt(n)[:, None]
    rows[own] += total / np.maximum(1, np.linalg.norm(total, axis=1, keepdims=True))


def sgns_batch(w: np.ndarray, c: np.ndarray, wi: np.ndarray, ci: np.ndarray, weight: np.ndarray, upto: np.ndarray, negatives: int, rate: float, rng: np.random.Generator) -> float:
    """One mini-batch in place: positives, and negatives drawn from running probabilities; a negative that is the
    positive itself doesn't count. Gives the summed loss."""
    drawn = np.searchsorted(upto, rng.random((len(wi), negatives)) * upto[-1]).clip(0, len(upto) - 1)
    x, pos, neg = w[wi], c[ci], c[drawn]
    gp = (1 - _sigmoid((x * pos).sum(1))) * weight
    live = (drawn != ci[:, None]) * weight[:, None]
    sn = _sigmoid(np.einsum("bd,bnd->bn", x, neg))
    gn = -sn * live
    dx = gp[:, None] * pos + np.einsum("bn,bnd->bd", gn, neg)
    _move(c, np.r_[ci, drawn.ravel()], np.concatenate([gp[:, None] * x, (gn[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1])]), rate)
    _move(w, wi, dx, rate)
    return float(-(weight * np.log(_sigmoid((x * pos).sum(1)) + 1e-9)).sum() - (live * np.log(1 - sn + 1e-9)).sum())


def train_sgns(pairs: DataFrame, width: int = 50, epochs: int = 3, negatives: int = 5, rate: float = 0.025, least: int = 1, batch: int = 256, seed: int = 45, weights: dict[str, float] | None = None, other: float = 0.0) -> Embeddings:
    """pairs (word, context) -> embeddings of words and contexts that occur so often.

    The rate falls linearly over the epochs, to no less than 1e-4 of itself. With ``weights`` a pair counts by its
    context's relation (the part that relation_prefix gives), relations without a weight by ``other``.
    """
    spark = pairs.sparkSession
    counts = {}
    for kind in ("word", "context"):
        rows = pairs.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), kind)
        counts[kind] = rows.limit(MOST_PARAMETERS // (2 * width) + 1).collect()  # as many as may be broadcast
    words, contexts = ([r[0] for r in counts[k]] for k in ("word", "context"))
    if max(len(words), len(contexts)) * width * 2 > MOST_PARAMETERS:
        raise ValueError("the vocabulary is too large to be sent to the workers; raise `least`")
    w, c = initial(len(words), len(contexts), width, seed)
    model = Embeddings(words, contexts, w, c)
    if not words or not contexts:
        return model
    upto = np.cumsum(np.array([r["n"] for r in counts["context"]], np.float64) ** 0.75)
    scale = np.ones(len(contexts)) if weights is None else np.array([weights.get(_relation(x), other) for x in contexts])
    rows = pairs.select("word", "context")
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((w, c))
        names = spark.sparkContext.broadcast(({x: i for i, x in enumerate(words)}, {x: i for i, x in enumerate(contexts)}, upto, scale))
        now = max(rate * (1 - epoch / epochs), rate * 1e-4)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names, epoch=epoch, now=now) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            w0, c0 = shared.value
            w, c = w0.copy(), c0.copy()
            by_word, by_context, upto, scale = names.value
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            loss, n = 0.0, 0
            for part in batches:
                wi = np.array([by_word.get(x, -1) for x in part.column(0).to_pylist()], np.int64)
                ci = np.array([by_context.get(x, -1) for x in part.column(1).to_pylist()], np.int64)
                known = (wi >= 0) & (ci >= 0)
                wi, ci = wi[known], ci[known]
                for at in range(0, len(wi), batch):
                    loss += sgns_batch(w, c, wi[at : at + batch], ci[at : at + batch], scale[ci[at : at + batch]], upto, negatives, now, rng)
                n += len(wi)
            for kind, new, old in ((0, w, w0), (1, c, c0)):
                moved = np.flatnonzero((new != old).any(1))
                for at in range(0, len(moved), 4096):
                    some = moved[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()), pa.array(list((new - old)[some].astype(np.float64)), pa.list_(pa.float64()))], ["kind", "id", "d"])
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.array([[loss, float(n)]], pa.list_(pa.float64()))], ["kind", "id", "d"])

        # a row a word or context and task, added up as it is; a task for each core, as each sends its own changes
        flat = rows.coalesce(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(run, "kind int, id int, d array<double>")
        parts = [F.sum(F.get("d", F.lit(i))).alias(f"_{i}") for i in range(max(width, 2))]
        sums = flat.groupBy("kind", "id").agg(F.count("*").alias("n"), *parts)
        merged = sums.select("kind", "id", F.array(*[F.when(F.col("kind") == 2, F.col(f"_{i}")).otherwise(F.col(f"_{i}") / F.col("n")) for i in range(max(width, 2))]).alias("d"))
        loss, n = 0.0, 1.0
        w, c = w.copy(), c.copy()
        for r in merged.toLocalIterator():  # a row a word or context that moved
            if r["kind"] == 2:
                loss, n = r["d"][:2]
            else:
                (w, c)[r["kind"]][r["id"]] += np.array(r["d"][:width])
        model.losses.append(loss / max(n, 1.0))
    model.vectors, model.context_vectors = w, c
    return model


def _relation(context: str) -> str:
    import re

    return re.match("(prep_[^_]*|[^_]*)", context)[1]


def learn_relation_weights(pairs: DataFrame, classes: dict[str, int] | Callable[[str], int | None], rounds: int = 3, step: float = 1.0, **how) -> dict[str, float]:
    """Weights of relations that make word vectors tell two classes of words apart: 0 and 1, of labelled words by a
    dictionary, or of all words by a rule.

    In turns: embeddings are trained with the weights so far, a logistic classifier is fitted on the labelled words,
    and each relation's weight moves by how well what its pairs teach a word's vector agrees with what the classifier
    wants of it. Weights stay between 0 and 2, their mean 1.
    """
    relations = [r[0] for r in pairs.select(T.relation_prefix("context").alias("r")).distinct().orderBy("r").collect()]  # relations are few
    weights = dict.fromkeys(relations, 1.0)
    label = classes if callable(classes) else classes.get
    spark = pairs.sparkSession
    for _ in range(rounds):
        model = train_sgns(pairs, weights=weights, other=1.0, **how)
        mine = [(i, y) for i, x in enumerate(model.words) if (y := label(x)) is not None]
        if len({y for _, y in mine}) < 2:
            break
        a, b, wants = fit_logistic(model.vectors[[i for i, _ in mine]], np.array([y for _, y in mine]))
        wanted = {model.words[i]: wants[j] for j, (i, _) in enumerate(mine)}
        shared = spark.sparkContext.broadcast((wanted, dict(zip(model.contexts, model.context_vectors, strict=True))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, contexts = shared.value
            sums: dict[str, list[float]] = {}
            for part in batches:
                for word, context in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if word in wanted and context in contexts:
                        s = sums.setdefault(_relation(context), [0.0, 0.0])
                        s[0] += float(wanted[word] @ contexts[context])
                        s[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.float64()), pa.array([x[1] for x in sums.values()], pa.float64())], ["r", "s", "n"])

        got = pairs.select("word", "context").mapInArrow(run, "r string, s double, n double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        gain = {r["r"]: r["s"] / max(r["n"], 1) for r in got}
        size = max(map(abs, gain.values()), default=0.0) or 1.0
        weights = {r: float(np.clip(x + step * gain.get(r, 0.0) / size, 0, 2)) for r, x in weights.items()}
        mean = sum(weights.values()) / max(len(weights), 1) or 1.0
        weights = {r: min(2.0, x / mean) for r, x in weights.items()}
    return weights


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and bias, and what the classifier wants each row to move by (the gradient of its log likelihood)."""
    a, b = np.zeros(x.shape[1]), 0.0
    scale = 1 / max(np.linalg.norm(x, axis=1).mean(), 1e-9)
    for _ in range(steps):
        g = y - _sigmoid(x @ a * scale + b)
        a += rate * (g @ x) * scale / len(x)
        b += rate * g.mean()
    return a * scale, b, (y - _sigmoid(x @ a * scale + b))[:, None] * a[None, :] * scale


# pair encoders


@dataclass
class PairModel:
    """``args`` V x d; ``mlp``: layers (weights, bias) over [s, o, s * o]; ``cells``: forward and backward LSTM
    (input, hidden, bias); ``attention``: scores of hidden states; ``out``: hidden states to d."""

    args: np.ndarray
    mlp: list[tuple[np.ndarray, np.ndarray]]
    words: np.ndarray
    cells: tuple
    attention: np.ndarray
    out: np.ndarray

    @classmethod
    def random(cls, n_args: int, n_words: int, width: int, hidden: int, layers: int, seed: int = 45) -> PairModel:
        rng = np.random.default_rng(seed)
        m = lambda *s: rng.normal(0, s[-1] ** -0.5, s)
        sizes = [3 * width, *[width] * layers]
        cell = lambda: (m(width, 4 * hidden), m(hidden, 4 * hidden), np.zeros(4 * hidden))
        return cls(m(n_args, width), [(m(a, b), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], m(n_words, width), (cell(), cell()), m(2 * hidden), m(2 * hidden, width))

    def predict(self, s: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The relation vector that two arguments suggest."""
        x = np.concatenate([s, o, s * o], 1)
        for i, (w, b) in enumerate(self.mlp):
            x = x @ w + b
            if i < len(self.mlp) - 1:
                x = np.maximum(x, 0)
        return x

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Relation vectors of padded word ids: both directions of the LSTM, attention over their states."""
        x = self.words[ids]
        both = np.concatenate([lstm(x, mask, self.cells[0]), lstm(x[:, ::-1], mask[:, ::-1], self.cells[1])[:, ::-1]], 2)
        return attention_pool(both, self.attention, mask) @ self.out


def lstm(x: np.ndarray, mask: np.ndarray, cell: tuple) -> np.ndarray:
    """Hidden states, rows x places x hidden; masked places pass the state on."""
    wx, wh, b = cell
    n, places, _ = x.shape
    h = np.zeros((n, wh.shape[0]))
    c = np.zeros_like(h)
    out = np.zeros((n, places, wh.shape[0]))
    for t in range(places):
        i, f, g, o = np.split(x[:, t] @ wx + h @ wh + b, 4, axis=1)
        c1 = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h1 = _sigmoid(o) * np.tanh(c1)
        live = mask[:, t][:, None]
        h, c = np.where(live, h1, h), np.where(live, c1, c)
        out[:, t] = h
    return out


def score_pairs(rows: DataFrame, model: PairModel, cosine: bool = False) -> DataFrame:
    """rows (key, x, y, ctx array of word ids, 1 is padding) -> key, score of the pair's and the context's vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in batches:
            if not part.num_rows:
                continue
            x, y = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            lists = part.column(3).to_pylist()
            ids = np.ones((len(lists), max(1, max(map(len, lists)))), np.int64)
            for row, own in zip(ids, lists, strict=True):
                row[: len(own)] = own
            p, r = m.predict(m.args[x], m.args[y]), m.encode(ids, ids != 1)
            s = (p * r).sum(1)
            if cosine:
                s = s / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(r, axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["key", "score"])

    return rows.select("key", "x", "y", "ctx").mapInArrow(run, rows.select("key").schema.add("score", "double"))


def pair_loss(positive: Column, *negatives: Column) -> Column:
    """-log sigmoid(positive) - sum of log sigmoid(-negative), without overflow."""
    softplus = lambda x: F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))
    out = softplus(-positive)
    for n in negatives:
        out = out + softplus(n)
    return out


def shuffled(df: DataFrame, key: str, columns: Sequence[str], seed: int = 45) -> DataFrame:
    """df with neg_... columns from other rows: rows are dealt to blocks by hash, and each takes those of the next row
    in an order by hash within its block, so that no global order is needed. A block has about ROWS_SHUFFLED rows."""
    from pyspark.sql import Window

    dealt = df.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    blocks = max(1, -(-df.count() // ROWS_SHUFFLED))
    block = Window.partitionBy(F.pmod("_h", F.lit(blocks))).orderBy("_h", key)
    first = {c: F.first(c).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in columns}
    return dealt.select(*df.columns, *[F.coalesce(F.lead(c).over(block), first[c]).alias(f"neg_{c}") for c in columns])


def train_loop(step: Callable[[float], float], develop: Callable[[], float], rounds: int, rate: float, factor: float = 0.9, patience: int = 10, keep: Callable[[], None] = lambda: None) -> tuple[float, list[float]]:
    """Steps with a learning rate that falls by ``factor`` when the development loss hasn't improved for ``patience``
    rounds; ``keep`` is called at each best one. Gives the best loss and the rates."""
    best, waited, rates = float("inf"), 0, []
    for _ in range(rounds):
        rates.append(rate)
        step(rate)
        now = develop()
        if now < best:
            best, waited = now, 0
            keep()
        else:
            waited += 1
            if waited > patience:
                rate, waited = rate * factor, 0
    return best, rates


def clip(gradients: list[np.ndarray], most: float = 10.0) -> list[np.ndarray]:
    """Scaled together so that their norm is at most ``most``."""
    n = float(np.sqrt(sum((g**2).sum() for g in gradients)))
    return [g * min(1.0, most / max(n, 1e-12)) for g in gradients]


def word2vec(sentences: DataFrame, column: str = "words", width: int = 300, least: int = 10, window: int = 7, seed: int = 45):
    """Spark's own Word2Vec with the usual settings."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=width, minCount=least, windowSize=window, seed=seed, inputCol=column, outputCol="vector").fit(sentences)



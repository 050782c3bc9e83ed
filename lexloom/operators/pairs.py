"""Training the pair model: relation vectors that two arguments suggest, against those that their contexts encode.

A step takes pairs with an observed context. The observed relation should score high with the pair's prediction; a
sampled relation with the same pair, and the observed one with a sampled subject or object, should score low (each
-log sigmoid). Gradients go back through the perceptron and through both directions of the recurrent encoder.

Pairs are trained on where they lie: a task starts from the broadcast parameters, runs mini-batches over its rows with
clipped gradients, and gives its changes row by row of each matrix; rows are averaged over the tasks that changed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.training import MOST_PARAMETERS, PairModel, _sigmoid, clip, train_loop
from lexloom.operators.vectors import masked_softmax

#: What each kind of negative counts in the loss: the relation, the subject, the object, and arguments of the same type.
WEIGHTS = {"positive": 1.0, "relation": 1.0, "subject": 1.0, "object": 1.0, "type": 0.3}
PAD = 1


def parameters(m: PairModel) -> dict[str, np.ndarray]:
    """All weights by name; the arrays themselves, not copies."""
    out = {"args": m.args, "words": m.words, "attention": m.attention, "out": m.out}
    for i, (w, b) in enumerate(m.mlp):
        out |= {f"mlp{i}": w, f"mlp{i}_bias": b}
    for side, cell in zip(("forward", "backward"), m.cells, strict=True):
        out |= dict(zip((f"{side}_input", f"{side}_hidden", f"{side}_bias"), cell, strict=True))
    return out


def model_of(arrays: dict[str, np.ndarray]) -> PairModel:
    layers = sum(1 for k in arrays if k.startswith("mlp") and not k.endswith("_bias"))
    cells = tuple(tuple(arrays[f"{side}_{part}"] for part in ("input", "hidden", "bias")) for side in ("forward", "backward"))
    return PairModel(arrays["args"], [(arrays[f"mlp{i}"], arrays[f"mlp{i}_bias"]) for i in range(layers)], arrays["words"], cells, arrays["attention"], arrays["out"])


def _predicted(m: PairModel, s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Predictions, and what each layer read."""
    x, read = np.concatenate([s, o, s * o], 1), []
    for i, (w, b) in enumerate(m.mlp):
        read.append(x)
        x = x @ w + b
        if i < len(m.mlp) - 1:
            x = np.maximum(x, 0)
    return x, read


def _back_predicted(m: PairModel, read: list[np.ndarray], d: np.ndarray, grads: dict) -> np.ndarray:
    """Gradients of the layers; gives that of [s, o, s * o]."""
    for i in range(len(m.mlp) - 1, -1, -1):
        grads[f"mlp{i}"] = read[i].T @ d
        grads[f"mlp{i}_bias"] = d.sum(0)
        d = d @ m.mlp[i][0].T
        if i:
            d = d * (read[i] > 0)
    return d


def _run(x: np.ndarray, mask: np.ndarray, cell: tuple) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, and what each place needs to go back."""
    wx, wh, b = cell
    h = np.zeros((len(x), wh.shape[0]))
    c, out, kept = np.zeros_like(h), np.zeros((*x.shape[:2], wh.shape[0])), []
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ wx + h @ wh + b, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        new = f * c + i * g
        squashed = np.tanh(new)
        live = mask[:, t][:, None]
        kept.append((h, c, i, f, g, o, squashed, live))
        h, c = np.where(live, o * squashed, h), np.where(live, new, c)
        out[:, t] = h
    return out, kept


def _back_run(x: np.ndarray, kept: list, cell: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the cell's weights, from those of the hidden states."""
    wx, wh, b = cell
    dx, dwx, dwh, db = np.zeros_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(b)
    dh, dc = np.zeros((len(x), wh.shape[0])), np.zeros((len(x), wh.shape[0]))
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, g, o, squashed, live = kept[t]
        dh = dh + d[:, t]
        here, cell_here = np.where(live, dh, 0), np.where(live, dc, 0)
        cell_here = cell_here + here * o * (1 - squashed**2)
        z = np.concatenate([cell_here * g * i * (1 - i), cell_here * c * f * (1 - f), cell_here * i * (1 - g**2), here * squashed * o * (1 - o)], 1)
        dx[:, t] = z @ wx.T
        dwx += x[:, t].T @ z
        dwh += h.T @ z
        db += z.sum(0)
        dh = z @ wh.T + np.where(live, 0, dh)
        dc = cell_here * f + np.where(live, 0, dc)
    return dx, dwx, dwh, db


def _encoded(m: PairModel, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    mask, x = ids != PAD, m.words[ids]
    a, kept_a = _run(x, mask, m.cells[0])
    b, kept_b = _run(x[:, ::-1], mask[:, ::-1], m.cells[1])
    states = np.concatenate([a, b[:, ::-1]], 2)
    share = masked_softmax(states @ m.attention, mask)
    pooled = np.einsum("rp,rpd->rd", share, states)
    return pooled @ m.out, (ids, x, states, share, pooled, kept_a, kept_b)


def _back_encoded(m: PairModel, cache: tuple, d: np.ndarray, grads: dict) -> None:
    ids, x, states, share, pooled, kept_a, kept_b = cache
    grads["out"] = pooled.T @ d
    dp = d @ m.out.T
    dshare = np.einsum("rd,rpd->rp", dp, states)
    dscore = share * (dshare - (dshare * share).sum(1, keepdims=True))
    grads["attention"] = np.einsum("rp,rpd->d", dscore, states)
    ds = share[:, :, None] * dp[:, None, :] + dscore[:, :, None] * m.attention
    half = ds.shape[2] // 2
    dx, *cell = _back_run(x, kept_a, m.cells[0], ds[:, :, :half])
    grads |= dict(zip(("forward_input", "forward_hidden", "forward_bias"), cell, strict=True))
    dy, *cell = _back_run(x[:, ::-1], kept_b, m.cells[1], ds[:, ::-1, half:])
    grads |= dict(zip(("backward_input", "backward_hidden", "backward_bias"), cell, strict=True))
    grads["words"] = np.zeros_like(m.words)
    np.add.at(grads["words"], ids, dx + dy[:, ::-1])
    grads["words"][PAD] = 0


@dataclass
class Batch:
    """Pairs x, y with their contexts' word ids, a sampled context, and (subjects, objects, weight) of fake pairs."""

    x: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    other: np.ndarray
    fakes: list[tuple[np.ndarray, np.ndarray, float]]


def loss_of(m: PairModel, batch: Batch, weights: dict[str, float] = WEIGHTS, learn: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """The summed loss of a batch, and the gradients of all parameters."""
    n = len(batch.x)
    s, o = np.concatenate([batch.x, *(f[0] for f in batch.fakes)]), np.concatenate([batch.y, *(f[1] for f in batch.fakes)])
    p, read = _predicted(m, m.args[s], m.args[o])
    r, cache = _encoded(m, np.concatenate([batch.ids, batch.other]))
    terms = [(0, 0, 1.0, weights["positive"]), (0, n, -1.0, weights["relation"]), *((n * (k + 1), 0, -1.0, f[2]) for k, f in enumerate(batch.fakes))]
    total, dp, dr = 0.0, np.zeros_like(p), np.zeros_like(r)
    for a, b, sign, weight in terms:
        score = sign * (p[a : a + n] * r[b : b + n]).sum(1)
        total += weight * float(np.logaddexp(0, -score).sum())
        g = (-sign * weight * _sigmoid(-score))[:, None]
        dp[a : a + n] += g * r[b : b + n]
        dr[b : b + n] += g * p[a : a + n]
    if not learn:
        return total, {}
    grads: dict[str, np.ndarray] = {}
    d = _back_predicted(m, read, dp, grads)
    _back_encoded(m, cache, dr, grads)
    width = m.args.shape[1]
    grads["args"] = np.zeros_like(m.args)
    np.add.at(grads["args"], s, d[:, :width] + d[:, 2 * width :] * m.args[o])
    np.add.at(grads["args"], o, d[:, width : 2 * width] + d[:, 2 * width :] * m.args[s])
    return total, grads


@dataclass
class Sampler:
    """Fake arguments: ``upto``, running probabilities in proportion to count ** 0.75, and optionally ``alike``, of each
    argument others of its type (V x k), drawn uniformly, or by ``chance`` (V x k, rows that add up to 1)."""

    upto: np.ndarray
    alike: np.ndarray | None = None
    chance: np.ndarray | None = None

    @classmethod
    def of(cls, counts: np.ndarray, **types) -> Sampler:
        return cls(np.cumsum(np.asarray(counts, np.float64) ** 0.75), **types)

    def smoothed(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return np.minimum(np.searchsorted(self.upto, rng.random(n) * self.upto[-1], "right"), len(self.upto) - 1)

    def typed(self, of: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if self.chance is None:
            at = rng.integers(0, self.alike.shape[1], len(of))
        else:
            at = np.minimum((np.cumsum(self.chance[of], 1) < rng.random((len(of), 1))).sum(1), self.alike.shape[1] - 1)
        return self.alike[of, at]

    def batch(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, rng: np.random.Generator, weights: dict[str, float] = WEIGHTS) -> Batch:
        """The sampled relations are those of other rows of the batch."""
        n = len(x)
        fakes = [(self.smoothed(n, rng), y, weights["subject"]), (x, self.smoothed(n, rng), weights["object"])]
        if self.alike is not None:
            fakes += [(self.typed(x, rng), y, weights["type"]), (x, self.typed(y, rng), weights["type"])]
        return Batch(x, y, ids, np.roll(ids, 1 + rng.integers(0, max(1, n - 1)), 0), fakes)


def _padded(lists: list[list[int]]) -> np.ndarray:
    ids = np.full((len(lists), max(1, max(map(len, lists), default=1))), PAD, np.int64)
    for row, own in zip(ids, lists, strict=True):
        row[: len(own)] = own
    return ids


@dataclass
class Trained:
    model: PairModel
    losses: list[float] = field(default_factory=list)
    developed: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)


def _batches(part: pa.RecordBatch, sampler: Sampler, rng: np.random.Generator, size: int) -> Iterator[Batch]:
    x, y = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    lists = part.column(2).to_pylist()
    for at in range(0, len(x), size):
        yield sampler.batch(x[at : at + size], y[at : at + size], _padded(lists[at : at + size]), rng)


def _epoch(rows: DataFrame, m: PairModel, sampler: Sampler, rate: float, size: int, norm: float, seed: int) -> float:
    """One pass over rows (x, y, ctx), the model's arrays changed in place; gives the mean loss."""
    shared = rows.sparkSession.sparkContext.broadcast((parameters(m), sampler))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        old, sampler = shared.value
        new = {k: v.copy() for k, v in old.items()}
        own, rng, loss, n = model_of(new), np.random.default_rng([seed, TaskContext.get().partitionId()]), 0.0, 0
        for part in batches:
            for batch in _batches(part, sampler, rng, size):
                now, grads = loss_of(own, batch)
                names = [*grads]
                for k, g in zip(names, clip([grads[k] for k in names], norm), strict=True):
                    new[k] -= rate * g
                loss, n = loss + now, n + len(batch.x)
        if n:
            for k, v in new.items():
                change = np.atleast_2d(v - old[k]).astype(np.float64)
                for i in np.flatnonzero(change.any(1)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int64()), pa.array([change[i].tolist()], pa.list_(pa.float64()))], ["name", "row", "d"])
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int64()), pa.array([[loss, float(n)]], pa.list_(pa.float64()))], ["name", "row", "d"])

    flat = rows.select("x", "y", "ctx").mapInArrow(run, "name string, row long, d array<double>").select("name", "row", F.posexplode("d").alias("i", "v"))
    means = flat.groupBy("name", "row", "i").agg(F.avg("v").alias("v")).groupBy("name", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("d"))
    arrays, mean = parameters(m), 0.0
    for r in means.toLocalIterator():  # a row a changed row of a matrix
        d = np.array(r["d"])
        if r["name"]:
            target = arrays[r["name"]]
            (target[None, :] if target.ndim == 1 else target)[r["row"]] += d
        else:
            mean = d[0] / max(d[1], 1e-12)
    shared.unpersist()
    return float(mean)


def mean_loss(rows: DataFrame, m: PairModel, sampler: Sampler, size: int = 1000, seed: int = 7) -> float:
    shared = rows.sparkSession.sparkContext.broadcast((m, sampler))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sampler = shared.value
        loss, n, rng = 0.0, 0, np.random.default_rng(seed)
        for part in batches:
            for batch in _batches(part, sampler, rng, size):
                loss, n = loss + loss_of(own, batch, learn=False)[0], n + len(batch.x)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64())], ["loss", "n"])

    r = rows.select("x", "y", "ctx").mapInArrow(run, "loss double, n long").agg(F.sum("loss").alias("l"), F.sum("n").alias("n")).first()
    return float(r["l"] or 0.0) / max(r["n"] or 0, 1)


def train(rows: DataFrame, develop: DataFrame, m: PairModel, sampler: Sampler, epochs: int = 12, rate: float = 0.01, size: int = 600, norm: float = 10.0, patience: int = 10, seed: int = 45, keep=None) -> Trained:
    """rows and develop (x, y, ctx array of word ids) -> the model, trained, with its losses. The rate falls as
    train_loop() has it; ``keep`` (a model) is called at each best one. The arrays of ``m`` change."""
    if sum(v.size for v in parameters(m).values()) > MOST_PARAMETERS:
        raise ValueError("the model is too large to be sent to the workers")
    out = Trained(m)

    def step(now: float) -> float:
        out.losses.append(_epoch(rows, m, sampler, now, size, norm, seed + len(out.losses)))
        return out.losses[-1]

    def look() -> float:
        out.developed.append(mean_loss(develop, m, sampler))
        return out.developed[-1]

    _, out.rates = train_loop(step, look, epochs, rate, patience=patience, keep=(lambda: keep(m)) if keep else (lambda: None))
    return out

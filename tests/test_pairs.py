"""The pair model: gradients against differences, and planted relations that must rank first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import pairs as P
from lexloom.operators.training import PairModel
from lexloom.sources.files import load_model, save_model, shared_dir


def small_batch(rng, n=5, v=7, words=9, places=4):
    ids = rng.integers(2, words, (2 * n, places))
    for row in ids:
        row[rng.integers(1, places + 1) :] = P.PAD
    x, y = rng.integers(0, v, n), rng.integers(0, v, n)
    return P.Batch(x, y, ids[:n], ids[n:], [(rng.integers(0, v, n), y, 1.0), (x, rng.integers(0, v, n), 0.3)])


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    m, batch = PairModel.random(7, 9, 5, 3, 3), small_batch(rng)
    for _, b in m.mlp:
        b += rng.normal(0, 0.3, b.shape)  # a layer that is zero throughout has no derivative
    loss, grads = P.loss_of(m, batch)
    arrays = P.parameters(m)
    assert set(grads) == set(arrays)
    for name, a in arrays.items():
        flat, g = a.reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[i]
            if name == "words" and i // a.shape[1] == P.PAD:
                continue
            flat[i] = was + 1e-5
            up = P.loss_of(m, batch, learn=False)[0]
            flat[i] = was - 1e-5
            down = P.loss_of(m, batch, learn=False)[0]
            flat[i] = was
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i])), name
    assert loss == pytest.approx(P.loss_of(m, batch, learn=False)[0])


def test_forward_is_the_models_own():
    rng = np.random.default_rng(4)
    m, batch = PairModel.random(7, 9, 5, 3, 2), small_batch(rng)
    assert np.allclose(P._encoded(m, batch.ids)[0], m.encode(batch.ids, batch.ids != P.PAD))
    assert np.allclose(P._predicted(m, m.args[batch.x], m.args[batch.y])[0], m.predict(m.args[batch.x], m.args[batch.y]))


def test_samplers():
    rng = np.random.default_rng(5)
    s = P.Sampler.of(np.array([16.0, 1.0, 0.0]), alike=np.array([[1, 2], [0, 0], [1, 1]]), chance=np.array([[0.0, 1.0], [0.5, 0.5], [1.0, 0.0]]))
    drawn = np.bincount(s.smoothed(9000, rng), minlength=3) / 9000
    assert abs(drawn[0] - 8 / 9) < 0.02 and drawn[2] == 0
    assert s.typed(np.array([0, 0, 2]), rng).tolist() == [2, 2, 1]
    s.chance = None
    assert set(s.typed(np.zeros(50, np.int64), rng).tolist()) == {1, 2}


def test_planted_relations_rank_first(spark):
    """Arguments of two kinds; the kinds of a pair decide its context's words. Training finds that out, also for pairs
    that it hasn't seen, and the stored model is the same."""
    rng = np.random.default_rng(6)
    context = {(0, 0): [2, 3, 4], (0, 1): [5, 6], (1, 0): [7, 8, 9], (1, 1): [10, 11]}
    rows = []
    for k in range(2400):
        x, y = (int(v) for v in rng.integers(0, 24, 2))
        rows.append((k, x, y, [*context[x % 2, y % 2], int(rng.integers(12, 15))]))
    df = spark.createDataFrame(rows, "key long, x long, y long, ctx array<int>").repartition(2).cache()
    unseen = F.pmod(F.col("x") * 7 + F.col("y"), F.lit(5)) == 0
    path = shared_dir(spark, "pairs")
    m = PairModel.random(24, 15, 10, 6, 2)
    before = P.mean_loss(df.where(unseen), m, P.Sampler.of(np.ones(24)))
    out = P.train(df.where(~unseen), df.where(unseen), m, P.Sampler.of(np.ones(24)), epochs=14, rate=0.05, size=40, keep=lambda best: save_model(spark, path, {"kind": "pairs"}, P.parameters(best)))
    assert min(out.developed) < 0.8 * before and len(out.losses) == 14
    best = P.model_of(load_model(spark, path)[1])
    r = best.encode(P._padded([c + [12] for c in context.values()]), np.array([[True] * (len(c) + 1) + [False] * (3 - len(c)) for c in context.values()]))
    right = total = 0
    for x in range(24):
        for y in range(24):
            if (7 * x + y) % 5 == 0:
                p = best.predict(best.args[[x]], best.args[[y]])
                right += list(context)[int((r @ p[0]).argmax())] == (x % 2, y % 2)
                total += 1
    assert right >= 0.9 * total

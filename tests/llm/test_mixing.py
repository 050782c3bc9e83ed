import random
import re

import numpy as np

from lexloom.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, 1000, 10**6]) for s in rng.sample(["a", "b", "B", "é", "z", None, "aa"], rng.randint(1, 7))}
        got, want = mixing.targets(sizes), slow_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in got)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * (1 + sum(sizes.values())) or all(got[s] == 3 * sizes[s] for s in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 700):
        p, rows = rng.random(n), np.stack([rng.integers(1, 500, n) / 250, np.ones(n)], 1)
        out = mixing.flight(p, rows, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert np.allclose(out @ rows, p @ rows, atol=1e-6)


def test_flight_is_fair():
    """Over many runs every unit is taken as often as its probability says."""
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.7, 0.25])
    rows = np.stack([np.array([1.0, 4, 2, 8, 5, 3]), np.ones(6)], 1)
    mean = sum(mixing.flight(p, rows, np.random.default_rng(k)) for k in range(3000)) / 3000
    assert np.abs(mean - p).max() < 0.05


def test_totals(odd, clashing, nothing):
    rows = mixing.totals(clashing).collect()
    assert sorted(r["size"] for r in rows) == sorted(size(r["text"]) for r in odd.collect())
    by = {}
    for r in odd.collect():
        by[r["source"]] = by.get(r["source"], 0) + size(r["text"])
    goal = slow_targets(by)
    assert {(r["source_size"], round(r["target"], 6)) for r in rows} == {(by[s], round(goal[s], 6)) for s in by}
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in rows if r["size"])
    assert all(r["taken"] == 0 for r in rows if not r["size"])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.totals(clashing).collect()))
    assert mixing.totals(nothing).collect() == [] and mixing.repeat(nothing).collect() == []


def test_near_the_targets_in_many_blocks(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), ["hot", "b", "c", "d"][min(3, i % 6)], i) for i in range(3000)], "doc_id long, text string, source string, x long")
    rows = mixing.totals(docs, block=128).collect()
    taken, goal = {}, {}
    for r in rows:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        goal[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal)


def test_repeat(odd, clashing):
    want, got = {}, {}
    for r in mixing.totals(odd).collect():
        want[str(r["doc_id"])] = want.get(str(r["doc_id"]), 0) + r["taken"]
    out = mixing.repeat(clashing)
    assert out.columns == clashing.columns
    for r in out.collect():
        got[str(r["doc_id"])] = got.get(str(r["doc_id"]), 0) + size(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_rows_all_alike_are_dealt_to_blocks_too(spark, monkeypatch):
    """However many rows agree in id, source and size, no block gets them all."""
    from pyspark.sql import functions as F

    balance = mixing._balance

    def spy(last):
        run = balance(last)

        def counted(key, part):
            assert len(part) < 3 * 64
            return run(key, part)

        return counted

    monkeypatch.setattr(mixing, "_balance", spy)
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "s").alias("source"))
    rows = mixing.totals(docs, block=64).collect()
    assert len(rows) == 3000
    for source in ("s", None):
        mine = [r for r in rows if r["target"] == {r["source_size"]: r["target"] for r in rows}[{"s": 6000, None: 3000}[source]]]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 6

"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words; target / size is how often, on average, each of its documents is taken.
The whole part of that rate is taken outright. The fraction is an inclusion probability, and the cube method turns
the probabilities into zeros and ones: a vector from the null space of the constraints (words and documents) moves
a few probabilities at a time, without changing either total, until one of them is 0 or 1. Within a block of
documents at most as many probabilities as constraints stay fractional. These leftovers of all blocks are dealt
into new blocks, level by level, until one block of each source is left; only its last few are landed by rounding.

So a hot source is many blocks of about BLOCK documents each. All choices come from hashes of what the rows hold, so
that reruns agree; rows that are alike in id, source and size, where they are more than an eighth of a block, are dealt by
their numbers too, as they would else all come to one block. There is a row a source in the driver and in the joins, which
are broadcasts only as long as Spark's own threshold allows.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are
kept or dropped like others and take no words; a repeated row is a document of its own; an empty table gives an
empty result; a source without any words has target 0 and its documents are taken 0 times; very long texts are like others,
their size may exceed a source's target, which is then met as nearly as whole documents allow. Only doc_id, source and text
are read, so that other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import as_bytes, fresh, materialize, numbered, slices

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents of one source that a task balances together, and the seed of the random directions.
BLOCK, SEED = 4096, 11
#: Kinds of rows alike that are told apart one by one.
CROWDS = 1000


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, the columns to keep, size (words between ASCII white space); one row per row of docs."""
    names = ["doc_id", "source", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x.split()) for x in as_bytes(batch.column(len(names)))], pa.int64())], [*names, "size"])

    return docs.select(*names, "text").mapInArrow(run, docs.select(*names).schema.add("size", "long"))


def targets(source_sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words that the mix should take of each source: the total by weight, at most ``most`` times the source's size,
    with what a source can't use dealt again by weight until none is above."""
    order = sorted((s for s in source_sizes if s is not None)) + [None] * (None in source_sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = float(sum(source_sizes.values())), {}, list(order)
    left = total
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * source_sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = most * source_sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def flight(p: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The cube method's flight: probabilities to 0 or 1 but for at most as many as ``rows`` has columns."""
    p, k, eps = p.copy(), rows.shape[1], 1e-9
    waiting = [int(i) for i in np.flatnonzero((p > eps) & (p < 1 - eps))[::-1]]
    active = [waiting.pop() for _ in range(min(k + 1, len(waiting)))]
    while len(active) > k:
        a = rows[active].T  # k constraints of k + 1 units
        u = np.linalg.svd(a)[2][-1]
        x = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - x) / u, np.where(u < -1e-12, -x / u, np.inf)).min()
            down = np.where(u > 1e-12, x / u, np.where(u < -1e-12, (x - 1) / u, np.inf)).min()
        x = x + up * u if rng.random() * (up + down) < down else x - down * u
        x[x < eps], x[x > 1 - eps] = 0.0, 1.0
        p[active] = x
        active = [i for i in active if 0 < p[i] < 1]
        while waiting and len(active) <= k:
            active.append(waiting.pop())
    return p


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the last few so that the words taken come as near as they can to what was left to take."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        want = float((p[at] * size[at]).sum())
        tried = [(abs(float(sum(size[i] for j, i in enumerate(at) if m >> j & 1)) - want), rng.random(), m) for m in range(1 << len(at))]
        m = min(tried)[2]
        p = p.copy()
        for j, i in enumerate(at):
            p[i] = m >> j & 1
    return p


def _balance(last: bool):
    def run(key, part):
        part = part.sort_values(["h", "rid"], kind="stable")
        size = part["size"].to_numpy(np.float64)
        p = part["p"].to_numpy(np.float64)
        rng = np.random.default_rng([SEED, len(part), int(part["h"].iloc[0]) & 0x7FFFFFFF])
        scale = max(size.mean(), 1.0)
        p = flight(p, np.stack([size / scale, np.ones(len(p))], 1), rng)
        if last:
            p = land(p, size, rng)
        return part.assign(p=p)[["rid", "source", "size", "h", "p"]]

    return run


def choose(sized: DataFrame, rates: dict[str | None, float], block: int = BLOCK) -> DataFrame:
    """sized (rid, source, size, h) -> rid, copies: how often each document is taken.

    ``h`` orders and deals documents; it must come from what the rows hold. ``rates`` has one number a source.
    """
    spark = sized.sparkSession
    schema = sized.select("rid", "source", "size", "h").schema.add("p", "double")
    known = spark.createDataFrame([(s, float(r)) for s, r in rates.items()], "source string, rate double")
    base = materialize(sized.join(known, sized["source"].eqNullSafe(known["source"])).select("rid", sized["source"], "size", "h", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")), "rates")
    done = base.where((F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)).select("rid", F.round("p").alias("p"))
    rest = base.where((F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)).select("rid", "source", "size", "h", "p")
    level = 0
    crowds = [r["h"] for r in rest.groupBy("h").count().where(F.col("count") > max(1, block // 8)).limit(CROWDS + 1).collect()]
    # by its number too, where so many rows are alike; where more kinds are than the list holds, all rows
    crowded = F.lit(True) if len(crowds) > CROWDS else F.col("h").isin(crowds) if crowds else F.lit(False)
    while True:
        counts = {r["source"]: r["n"] for r in rest.groupBy("source").agg(F.count("*").alias("n")).collect()}
        blocks = -(-max(counts.values(), default=0) // block)
        if not blocks:
            break
        cut = spark.createDataFrame([(s, -(-n // block)) for s, n in counts.items()], "_s string, blocks long")
        mine = F.when(crowded, F.xxhash64("h", F.lit(level), "rid")).otherwise(F.xxhash64("h", F.lit(level)))
        dealt = rest.join(cut, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.pmod(mine, F.col("blocks")))
        moved = materialize(dealt.groupBy("source", "block").applyInPandas(_balance(blocks <= 1), schema), "flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done = done.unionByName(moved.where(~open_).select("rid", "p"))
        rest = moved.where(open_)
        level += 1
    return base.select("rid", "whole").join(done, "rid").select("rid", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> tuple[DataFrame, dict, dict]:
    """(rid, doc_id, source, size, copies) for each row of docs, with the sizes and the targets by source."""
    return _mix(sizes(docs).withColumn("rid", F.monotonically_increasing_id()), weights, most, block)


def _mix(sized: DataFrame, weights: tuple[float, ...], most: float, block: int) -> tuple[DataFrame, dict, dict]:
    sized = materialize(sized.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "source", "size")), "sizes")
    by_source = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(by_source, weights, most)
    rates = {s: min(most, goal[s] / n) if n else 0.0 for s, n in by_source.items()}
    copies = choose(sized, rates, block)
    return sized.join(copies, "rid").select("rid", "doc_id", "source", "size", "copies"), by_source, goal


def totals(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    mixed, by_source, goal = mix(docs, weights, most, block)
    known = docs.sparkSession.createDataFrame([(s, n, float(goal[s])) for s, n in by_source.items()], "_s string, source_size long, target double")
    return mixed.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """docs with each row as often as the mix takes it, rows that it leaves out gone."""
    keyed, rid = numbered(docs, "docs")
    taken, times = fresh(keyed, "_taken", "_times")
    mixed, _, _ = _mix(sizes(keyed.select("doc_id", "source", "text", F.col(rid).alias("rid")), "rid"), weights, most, block)
    joined = keyed.join(mixed.where("copies > 0").select(mixed["rid"].alias(taken), mixed["copies"].alias(times)), F.col(rid) == F.col(taken))
    return joined.select(*[joined[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))).alias(taken)).select(*docs.columns)

"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its 3-word shingles, repeats included; words
lie between ASCII white space, A-Z are lower-cased; fewer than three words are one shingle, none give fingerprint 0.
Fingerprints link at DISTANCE or fewer differing bits, and documents fall into the components of these links.

Bits are grouped into partitions, correlated bits together. If partition i has threshold t_i and the thresholds sum
to DISTANCE - parts + 1, then two linked fingerprints differ in at most t_i bits in at least one partition (t_i = -1
leaves a partition out). A dynamic program picks the thresholds, and the number of partitions, that cost the fewest
candidates and probes, as estimated from counts over all fingerprints. Threshold t is probed by masking each choice
of t bits, so that equal keys meet. What meets is verified by the Hamming distance.

A key shared by more than BUCKET fingerprints isn't gathered: its fingerprints meet again by key and four partitions
of the other bits (one must be equal, as three differ at most), and where that is still too many, by pairs of blocks:
there, n fingerprints that share a key and a quarter of all their bits cost 2n / BUCKET meetings each. No pairs are emitted from a bucket: a task walks it breadth first and gives a spanning forest of its links.

Null texts are empty; empty texts have fingerprint 0 and link like others. Repeated rows and copies share one
fingerprint. A document without an id links like others, but gives no component its number. An empty table gives an
empty result. Very long texts are like others. Only doc_id and text are read, so that other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import as_bytes, components, fresh, join_skewed, materialize, numbered, slices

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Fingerprints of one key that a task takes at once.
BUCKET = 8192
#: What a probe row costs against a candidate pair.
PROBE_COST = 4.0

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Of each byte, its 8 bits as bytes of one number: eight counters that are added at once.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], np.uint64)


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: len(words) - SHINGLE]].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bit k is set if more than half of the numbers have it."""
    counts = np.zeros(64, np.int64)
    lanes = h.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), 255):  # a counter of one byte holds 255
        packed = _SPREAD[lanes[at : at + 255]].sum(0, dtype=np.uint64)
        counts += packed.astype("<u8").view(np.uint8).astype(np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(h)).tolist())


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """docs -> doc_id, the columns to keep, fp (the 64 bits as a signed long)."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in as_bytes(batch.column(len(names)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*names, "fp"])

    return docs.select(*names, "text").mapInArrow(run, docs.select(*names).schema.add("fp", "long"))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: their number, and how many have bits i and j set. The driver gets 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 8192):
                x = np.unpackbits(fp[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.int64)
            total += len(fp)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1], pa.int32()), pa.array(np.r_[j, -1], pa.int32()), pa.array(np.r_[both.ravel(), total], pa.int64())], ["i", "j", "n"])

    n, out = 0, np.zeros((BITS, BITS), np.float64)
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            out[r["i"], r["j"]] = r["n"]
    return n, out


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width: each opens with the bit least tied to those dealt, and takes the bits most
    correlated with its own."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        dealt = [b for part in out for b in part]
        first = min(left, key=lambda b: (round(float(corr[b, dealt].sum()), 9) if dealt else 0.0, b))
        part = [first]
        left.remove(first)
        while len(part) < width:
            b = max(left, key=lambda x: (round(float(corr[x, part].mean()), 9), -x))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _near(p: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Probability that two random fingerprints differ in exactly k of the bits, k = 0 .. most, bits taken as independent."""
    d = np.zeros(most + 1)
    d[0] = 1
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return d


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, that sum to ``total`` at the least cost; costs[i][t + 1] is that of threshold t."""
    best = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, x in enumerate(cost, -1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*chosen, t])
        best = new
    return best[total]


def plan(fps: DataFrame, choices: tuple[int, ...] = (2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest set of partitions; equal-key pairs are counted over all fingerprints."""
    n, both = bit_counts(fps)
    if n == 0:
        return []
    p = np.diag(both) / n
    tried = {m: group_bits(n, both, m) for m in choices}
    flat = [(m, i, bits) for m, ps in tried.items() for i, bits in enumerate(ps)]
    keys = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("k")) for j, (_, _, bits) in enumerate(flat)]))
    counted = fps.select(keys.alias("x")).groupBy("x.j", "x.k").agg(F.count("*").cast("double").alias("c")).groupBy("j").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    pairs = {r["j"]: r["s"] for r in counted.collect()}  # a row a partition of the bits
    same = {(m, i): pairs.get(j, 0.0) / 2 for j, (m, i, _) in enumerate(flat)}
    found = []
    for m, ps in tried.items():
        costs = []
        for i, bits in enumerate(ps):
            d = _near(p, bits, DISTANCE)
            ratio = np.cumsum(d) / max(d[0], 1e-30)
            costs.append([0.0] + [same[m, i] * min(ratio[t], n * n / 2 / max(same[m, i], 1.0)) + PROBE_COST * n * comb(len(bits), t) for t in range(DISTANCE + 1)])
        total = DISTANCE - m + 1
        cost, thresholds = allocate(costs, total)
        found.append((cost, m, thresholds))
    _, m, thresholds = min(found)
    return [(bits, t) for bits, t in zip(tried[m], thresholds, strict=True) if t >= 0]


def _probes(parts: list[tuple[list[int], int]]):
    masks = [(i, j, _mask([b for b in bits if b not in out])) for i, (bits, t) in enumerate(parts) for j, out in enumerate(combinations(bits, t))]
    which, codes = np.array([(i << 20) | j for i, j, _ in masks], np.int64), np.array([m for _, _, m in masks], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, 200_000 // len(codes))
            for at in range(0, len(fp), step):
                f = fp[at : at + step]
                keys = (f[:, None] & codes[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(which, len(f)), pa.int64()), pa.array(keys, pa.int64()), pa.array(np.repeat(f, len(codes)), pa.int64())], ["part", "key", "fp"])

    return run


def walk(fp: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among a bucket's fingerprints: breadth first, against those not yet reached."""
    fp = fp.view(np.uint64)
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= most
            if near.any():
                new = left[near]
                out += [(int(x), int(y)) for y in new]
                queue += new.tolist()
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key): small buckets all at once by shifted comparison, larger ones by walk()."""
    carry: list[np.ndarray] | None = None

    def solve(part, key, fp):
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
        edge = np.r_[0, new, len(part)]
        size = np.diff(edge)
        a, b = [], []
        for s, e in zip(edge[:-1][size > 24].tolist(), edge[1:][size > 24].tolist(), strict=True):
            pairs = walk(fp[s:e])
            a += [fp[s + x] for x, _ in pairs]
            b += [fp[s + y] for _, y in pairs]
        group = np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= 24, size)
        group, fp = group[small], fp[small]
        bits = fp.view(np.uint64)
        for k in range(1, 24):
            if k >= len(fp):
                break
            hit = (group[k:] == group[:-k]) & (np.bitwise_count(bits[k:] ^ bits[:-k]) <= DISTANCE)
            if not (group[k:] == group[:-k]).any():
                break
            a += fp[:-k][hit].tolist()
            b += fp[k:][hit].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        if carry is not None:
            now = [np.concatenate(x) for x in zip(carry, now, strict=True)]
        part, key = now[0], now[1]
        if not len(part):
            continue
        last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        carry = [x[cut:] for x in now]
        if cut:
            yield solve(*(x[:cut] for x in now))
    if carry is not None and len(carry[0]):
        yield solve(*carry)


def _meet(rows: DataFrame) -> DataFrame:
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "part", "key").sortWithinPartitions("part", "key").mapInArrow(_links, "a long, b long")


def links(fps: DataFrame, parts: list[tuple[list[int], int]], bucket: int = BUCKET) -> DataFrame:
    """fps (fp distinct) -> verified links (a, b) of fingerprints that connect all that the distance connects."""
    rows = fps.select("fp").mapInArrow(_probes(parts), "part long, key long, fp long")
    found = None
    for level in range(3):
        hot = materialize(rows.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key", "count"), "hot")
        calm = rows.join(hot, ["part", "key"], "left_anti")
        got = _meet(calm)
        found = got if found is None else found.unionByName(got)
        if hot.isEmpty():
            return found
        crowd = rows.join(hot, ["part", "key"])
        if level == 0:
            rest = F.array(*[F.struct(F.xxhash64("part", "key", F.lit(j)).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(list(range(16 * j, 16 * j + 16))))).alias("key")) for j in range(4)])
            # of four parts of all the bits, one at least is equal; the parts cover the bits that the key holds too
            rows = materialize(crowd.withColumn("x", F.explode(rest)).select("x.part", "x.key", "fp"), "crowd")
        else:
            blocks = F.ceil(2 * F.col("count") / bucket).cast("int")
            mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
            pair = F.explode(F.sequence(F.lit(0), blocks - 1))
            rows = crowd.select("part", "key", "fp", mine.alias("m"), pair.alias("o")).select(F.xxhash64("part", "key", F.least("m", "o")).alias("part"), F.xxhash64("part", "key", F.greatest("m", "o"), F.lit(1)).alias("key"), "fp")
            return found.unionByName(_meet(rows))
    return found


def components_of(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows (fp, ...) -> fp, root: the smallest fingerprint of the component of each distinct one."""
    distinct = materialize(rows.select("fp").distinct(), "distinct")
    parts = plan(distinct)
    if not parts:
        return distinct.select("fp", F.col("fp").alias("root"))
    roots = components(links(distinct, parts, bucket))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, a document's own included; null where none has one)."""
    rows = materialize(fingerprints(docs), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("d"))
    roots = materialize(components_of(rows, bucket).join(least, "fp"), "roots")
    names = roots.groupBy("root").agg(F.min("d").alias("component_id"))
    named = materialize(roots.join(names, "root").select("fp", "component_id"), "names")
    return join_skewed(rows, named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (null last), then the first row."""
    keyed, rid = numbered(docs, "docs")
    rows = materialize(fingerprints(keyed.select("doc_id", "text", F.col(rid).alias("rid")), "rid"), "fingerprints")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "rid")).alias("f"))
    kept = components_of(rows, bucket).join(first, "fp").groupBy("root").agg(F.min("f").alias("f"))
    (mine,) = fresh(keyed, "_kept")
    return keyed.join(kept.select(F.col("f.rid").alias(mine)), F.col(rid) == F.col(mine), "left_semi").select(*docs.columns)

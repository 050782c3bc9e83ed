import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lexloom.llm import simhash

BLANK = " \t\n\x0b\x0c\r"


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute(rows):
    """doc_id, fingerprint, component by comparing all pairs."""
    fps = [slow_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), r["doc_id"])
    return sorted((str(r["doc_id"]), f"{fps[i]:016x}", str(least.get(find(i)))) for i, r in enumerate(rows))


def plain(rows):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows)


@pytest.mark.parametrize("text", ["", "One", "one TWO", "a b c", "a b c d a b c d", "É x y z"] + [" ".join(random.Random(n).choices("abcdefgh", k=n)) for n in (5, 254, 255, 256, 257, 258, 600)])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_against_all_pairs(odd, clashing):
    assert plain(simhash.report(clashing).collect()) == brute(odd.collect())


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plain(simhash.report(docs).collect()) == brute(docs.collect())


def planted(rng, n, chains):
    """Random fingerprints, and chains in which neighbours differ in 3 bits."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(chains):
        x = rng.getrandbits(64)
        for _ in range(12):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("bucket,low", [(8192, 0), (16, 0), (16, 1)])
def test_links_find_all(spark, bucket, low):
    """Also where buckets overflow, as most bits are equal in all."""
    rng = random.Random(9)
    fps = planted(rng, 300, 20)
    if low:
        fps = sorted({x & 0x000F_00F0_0F00_F00F for x in fps})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r["fp"] & (1 << 64) - 1: r["root"] for r in simhash.components_of(df, bucket).collect()}
    assert len(got) == len(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    for a, b in combinations(fps, 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


def test_plan_keeps_the_pigeonhole(spark):
    rng = random.Random(4)
    fps = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)], "fp long")
    parts = simhash.plan(fps)
    used = [b for bits, _ in parts for b in bits]
    assert len(used) == len(set(used)) and all(t >= 0 for _, t in parts)
    masks = [(sum(1 << b for b in bits), t) for bits, t in parts]
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any((x & m).bit_count() <= t for m, t in masks)


def test_allocation_is_the_cheapest():
    rng = random.Random(2)
    costs = [[0.0] + [rng.random() * 10**k for k in range(4)] for _ in range(4)]
    best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in __import__("itertools").product(range(-1, 4), repeat=4) if sum(ts) == 0)
    cost, chosen = simhash.allocate(costs, 0)
    assert abs(cost - best) < 1e-9 and sum(chosen) == 0


def test_majority_of_many():
    h = np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.int64).astype("<u8")
    assert simhash.majority(h) == sum(1 << k for k in range(64) if 2 * int(((h >> np.uint64(k)) & np.uint64(1)).sum()) > len(h))


def test_dedup(odd, clashing, nothing):
    out = simhash.dedup(clashing)
    assert out.columns == clashing.columns
    rows = odd.collect()
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(slow_fingerprint(r["text"]), []).append(r)
    kept = out.collect()
    assert len(kept) == len(groups)  # here no two fingerprints are near but equal ones
    assert {r["doc_id"] for r in kept if r["text"] == rows[0]["text"]} <= {1}
    assert simhash.dedup(nothing).collect() == [] and simhash.report(nothing).collect() == []

import random

import numpy as np
import pytest

from lexloom.llm import substring_dedup as sd

from .conftest import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_gear_by_hand():
    raw = random.Random(1).randbytes(100)
    got = sd.gear(np.frombuffer(raw, np.uint8))
    for i in range(100):
        assert int(got[i]) == sum(int(sd._GEAR[raw[i - k]]) << k for k in range(min(16, i + 1))) & 0xFFFF


def test_cuts_resist_shifts():
    raw = words(random.Random(2), 3000).encode()
    a, b = sd.cuts(raw), sd.cuts(b"inserted at the front " + raw)
    assert len(set(a.tolist()) & set((b - 22).tolist())) > 0.98 * len(a)
    assert sd.cuts(b"").tolist() == [0] and sd.cuts(b"a").tolist() == [0, 1]
    assert np.diff(sd.cuts(b"a" * 5000)).max() <= sd.LONGEST
    assert 15 < len(raw) / len(a) < 70


def brute(rows):
    """(doc, start, end) by walking the documents in order with one dictionary of digests."""
    seen, out = {}, []
    for doc, text in rows:
        edge, count, digests = sd.units((text or "").encode())
        hits = []
        for i, d in enumerate(digests):
            if d in seen:
                hits.append(i)
            else:
                seen[d] = doc
        out += [(doc, s, e) for s, e, *_ in sd.spans_of(edge, count, np.array(hits, int), [None] * len(hits), sd.WIDTH, sd.MIN_WORDS)]
    return sorted(out)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    passages = [words(rng, 51 + 10 * k) for k in range(4)]
    docs = []
    for d in range(80):
        parts = [words(rng, rng.randint(5, 90))]
        if d % 2:
            parts += [passages[d % 4], words(rng, rng.randint(0, 40))]
        docs.append((d, " ".join(parts) if d != 7 else None, "en", "s", d))
    return spark.createDataFrame(docs, SCHEMA).repartition(5).cache(), passages


def test_against_one_dictionary(planted):
    docs, _ = planted
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in sd.report(docs).collect())
    assert got == brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_finds_planted_passages_and_leaves_the_rest(planted):
    docs, passages = planted
    found = {}
    for r in sd.report(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    first = {}
    for d, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        mine = [p for p in passages if text and p in text]
        again = [p for p in mine if p in first]
        assert bool(found.get(d)) == bool(again), d
        for p in again:
            at = text.encode().find(p.encode())
            assert any(r["start"] < at + len(p) and r["end"] > at and first[p] in r["first_docs"] for r in found[d])
            covered = sum(max(0, min(r["end"], at + len(p)) - max(r["start"], at)) for r in found[d])
            assert covered > 0.5 * len(p)
        for p in mine:
            first.setdefault(p, d)


def test_dedup_cuts_them_out(planted):
    docs, passages = planted
    out = {r["doc_id"]: r["text"] for r in sd.dedup(docs).collect()}
    assert len(out) == docs.count() and out[7] is None
    assert [sum(p in (t or "") for t in out.values()) for p in passages] == [0, 1, 0, 1]  # only odd documents hold any


def test_odd_rows(odd, clashing, nothing):
    spans = sd.report(clashing).collect()
    assert {str(r["doc_id"]) for r in spans} == {"1", "2", "None"}  # copies of the first row
    out = sd.dedup(clashing)
    assert out.columns == clashing.columns and out.count() == odd.count()
    assert sd.report(nothing).collect() == [] and sd.dedup(nothing).collect() == []


def test_cuts_move_to_whole_characters():
    raw = "aé漢😀b".encode()
    for start in range(len(raw) + 1):
        for end in range(start, len(raw) + 1):
            s, e = sd.whole_characters(raw, start, end)
            assert start <= s <= e <= end
            assert (raw[:s] + raw[e:]).decode() is not None


def test_a_unit_that_many_places_share(spark):
    """A passage in every document is found in all but the first, also where its digests are joined apart."""
    import random

    from .conftest import words

    rng = random.Random(8)
    passage = words(rng, 60)
    docs = [(i, words(rng, 5) + " " + passage + " " + words(rng, 5)) for i in range(1500)]
    found = sd.report(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in found} == set(range(1, 1500))


def test_places_are_shuffled_once(spark, planted, monkeypatch):
    """A place is a digest of 16 bytes and some, of which a corpus has one every 32 bytes: two shuffles of them are over the limit of disk."""
    import re

    plans, write = [], sd.materialize

    def spy(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what)

    monkeypatch.setattr(sd, "materialize", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(sd.report(planted[0])._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(len(re.findall(r"Exchange hashpartitioning\(d1", p)) for p in plans) == 1
